"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_extract, language_id, mixing, near_dedup, periodic_runs, pitman_yor, prefix_trie, substring_dedup, token_counts, token_ids, toxicity

#: Parameters of the queries.
WORD_BPE, WORD_BPE_IDS = "word_bpe_49k.json", 49_408
BYTE_BPE = "byte_bpe_50k.tiktoken"
WEIGHTS, SHARE, CAP, SEED, SHARDS = [3, 1, 2], 1.5, 2.0, 17, 16
REPEAT_WORDS = 35


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_ids.token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), WORD_BPE_IDS, end_id=1)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, SHARE, CAP, SEED, SHARDS)
    draws = F.array_join(F.col("draws").cast("array<string>"), ",").alias("draws")
    return out.select("doc_id", "size", "source_size", "target", "taken", draws)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), REPEAT_WORDS, texts=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"), held_out)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents")), texts=False)
    return out.drop("n_words", "runs", "collapsed")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_ids, op2_toxicity, op3_decontaminate, op4_near_duplicates, op5_mix,
        op6_token_counts, op7_exact_dedup, op8_substring_dedup, op9_extract_html, op10_language_id,
        op11_language_model, op12_periodic_runs, op13_prefix_trie,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
),
runs AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM dw
  WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
),
short AS (
  SELECT s, n, string_split(s, ' ') AS w FROM (SELECT DISTINCT s, n FROM win WHERE n < 13)
),
sw AS (SELECT s, n, unnest(w) AS word, unnest(range(0, n)) AS j FROM short),
hits AS (
  SELECT r.doc_id, r.pos, 13 AS n, r.s FROM runs r WHERE r.n = 13 AND r.s IN (SELECT s FROM win WHERE n = 13)
  UNION ALL
  SELECT dw.doc_id, dw.pos - sw.j AS pos, any_value(sw.n) AS n, sw.s FROM dw JOIN sw ON dw.word = sw.word
  GROUP BY dw.doc_id, dw.pos - sw.j, sw.s HAVING count(*) = any_value(sw.n)
),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT h.doc_id, CAST(win.item_id AS VARCHAR) AS item FROM hits h JOIN win ON h.s = win.s) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPLIT}) AS w FROM documents),
dw AS (SELECT doc_id, len(w) AS total, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
runs AS (
  SELECT doc_id, pos, total, string_agg(word, ' ') OVER f AS s FROM dw
  WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
),
sh AS (SELECT DISTINCT doc_id, s FROM runs WHERE pos <= greatest(1, total - 4)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))
),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT e.v, r.root FROM reach r JOIN both_ways e ON e.u = r.doc_id
),
comp AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN n USING (doc_id)
"""


def _hash(*parts: str) -> str:
    return "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8) AS BIGINT)"


_ROUND = """
r{k} AS (
  SELECT * EXCLUDE (taken_in, gap, one), taken_in OR one AS taken_in,
    gap - sum(CASE WHEN one THEN size ELSE 0 END) OVER (PARTITION BY source, block) AS gap
  FROM (SELECT *, NOT taken_in AND size < 2 * gap AND row_number() OVER (
    PARTITION BY source, block, taken_in ORDER BY abs(size - gap), h, doc_id, size) = 1 AS one FROM r{j})
)"""

#: One level of the splitting tree: the sources of a node take their share of its left half one after another.
_LEVEL = """
n{t} AS (
  SELECT low, m, source, quota, {u} AS u, row_number() OVER (PARTITION BY low ORDER BY source NULLS LAST) AS k,
    CAST(sum(quota) OVER (PARTITION BY low) AS BIGINT) AS total FROM q{t}
),
d{t}(low, m, k, source, quota, total, want, x) AS (
  SELECT low, m, k, source, quota, total, total * (m // 2) // m, {first} FROM n{t} WHERE k = 1
  UNION ALL
  SELECT n.low, n.m, n.k, n.source, n.quota, p.total - p.quota, p.want - p.x, {next}
  FROM d{t} p JOIN n{t} n ON n.low = p.low AND n.k = p.k + 1
),
q{j} AS (
  SELECT low, m // 2 AS m, source, x AS quota FROM d{t} UNION ALL SELECT low + m // 2, m - m // 2, source, quota - x FROM d{t}
)"""


def _share(good: str, total: str, want: str, u: str) -> str:
    """The hypergeometric quantile at u, as DuckDB adds it up."""
    low = f"greatest(0, {want} + {good} - {total})"
    ways = lambda *n: " + ".join(f"lgamma(({x}) + 1.0)" for x in n)
    above = ways(good, f"{total} - {good}", want, f"{total} - {want}")
    p = f"exp({above} - ({ways(total, 'y', f'{good} - y', f'{want} - y', f'{total} - {good} - {want} + y')}))"
    return (
        f"list_reduce(list_transform(range({low}, least({good}, {want}) + 1), lambda y: {{'s': {p}, 'x': y}}), "
        f"lambda a, b: {{'s': a.s + b.s, 'x': CASE WHEN a.s < {u} THEN b.x ELSE a.x END}}, {{'s': CAST(0 AS DOUBLE), 'x': {low}}}).x"
    )


def _tree(shards: int) -> str:
    out = []
    for t in range((shards - 1).bit_length()):
        u = f"({_hash(f"'{SEED}'", f"'{t}'", 'CAST(low AS VARCHAR)', r"coalesce(source, '\N')")} + 0.5) / 4294967296.0"
        first = _share("quota", "total", "(total * (m // 2) // m)", "u")
        out.append(_LEVEL.format(t=t, j=t + 1, u=u, first=first, next=_share("n.quota", "(p.total - p.quota)", "(p.want - p.x)", "n.u")))
    return ",".join(out)


_OP5 = rf"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_SPLIT})) AS BIGINT) AS size,
    {_hash(f"'{SEED}'", "'doc'", "coalesce(CAST(doc_id AS VARCHAR), md5(text))")} AS h FROM documents
),
p AS (
  SELECT source, sum(size) AS source_size,
    [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM s GROUP BY source
),
q AS (SELECT *, {CAP} * source_size AS most, sum(source_size) OVER () AS total FROM p),
l AS (
  SELECT *, ({SHARE} * total - coalesce(sum(most) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM q WINDOW f AS (ORDER BY most / weight, source NULLS LAST)
),
t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least(most, round((max(rate) OVER ()) * weight, 6)) AS target,
    CAST(greatest(1, ceil(source_size / greatest({mixing.BLOCK_WORDS}.0, total / {mixing.MOST_BLOCKS}))) AS BIGINT) AS n_blocks FROM l
),
v AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
placed AS (
  SELECT s.*, source_size, target, passes, target - passes * source_size AS rest, h % n_blocks AS block
  FROM s JOIN v ON s.source IS NOT DISTINCT FROM v.source
),
blocks AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY block_h, block) AS upto FROM (
    SELECT source, block, passes, rest, sum(size) AS words, any_value({_hash(f"'{SEED}'", "'block'", r"coalesce(source, '\N')", "CAST(block AS VARCHAR)")}) AS block_h
    FROM placed GROUP BY source, block, passes, rest
  )
),
line AS (
  SELECT source AS bs, block AS bb, words, rest - upto + words AS rest_left, passes + CAST(rest - upto + words > 0 AS INT) AS draws,
    row_number() OVER (PARTITION BY source ORDER BY block_h, block) AS place, count(*) OVER (PARTITION BY source) AS line_length FROM blocks
),
q0 AS (SELECT 0 AS low, {SHARDS} AS m, bs AS source, CAST(sum(draws) AS BIGINT) AS quota FROM line GROUP BY bs),{_tree(SHARDS)},
ranges AS (
  SELECT source AS r_source, list({{'upto': upto, 'shard': low}} ORDER BY upto, low) AS ranges
  FROM (SELECT source, low, sum(quota) OVER (PARTITION BY source ORDER BY low) AS upto FROM q{(SHARDS - 1).bit_length()}) GROUP BY source
),
rows_in AS (
  SELECT placed.*, rest_left, rest_left >= words AS full_block, rest_left > 0 AND rest_left < words AS cut, place, line_length
  FROM placed JOIN line ON source IS NOT DISTINCT FROM bs AND block = bb
),
ordered AS (
  SELECT *, sum(size) OVER (PARTITION BY source, block ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM rows_in WHERE cut
),
r0 AS (
  SELECT *, upto <= rest_left AS taken_in,
    rest_left - coalesce(max(CASE WHEN upto <= rest_left THEN upto END) OVER (PARTITION BY source, block), 0) AS gap FROM ordered
),{",".join(_ROUND.format(j=k, k=k + 1) for k in range(3))},
every AS (
  SELECT doc_id, source, size, source_size, target, passes + CAST(full_block AS INT) AS copies, place, line_length FROM rows_in WHERE NOT cut
  UNION ALL SELECT doc_id, source, size, source_size, target, passes + CAST(taken_in AS INT), place, line_length FROM r3
),
drawn AS (
  SELECT *, list_transform(range(1, copies + 1), lambda p: list_filter(ranges, lambda r: r.upto >= (p - 1) * line_length + place)[1].shard) AS draws
  FROM every JOIN ranges ON source IS NOT DISTINCT FROM r_source
)
SELECT doc_id, size, source_size, target, CAST(size * len(draws) AS BIGINT) AS taken, array_to_string(draws, ',') AS draws FROM drawn
"""

_OP7 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
),
g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

_OP8 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPLIT}) AS w FROM documents),
dw AS (SELECT doc_id, len(w) AS total, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
runs AS (
  SELECT doc_id, pos, total, word, string_agg(word, ' ') OVER f AS s FROM dw
  WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {REPEAT_WORDS - 1} FOLLOWING)
),
again AS (
  SELECT doc_id, pos, word, pos <= total - {REPEAT_WORDS - 1}
    AND count(*) FILTER (pos <= total - {REPEAT_WORDS - 1}) OVER (PARTITION BY s) > 1 AS repeated FROM runs
),
covered AS (
  SELECT doc_id, pos, word, coalesce(bool_or(repeated) OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {REPEAT_WORDS - 1} PRECEDING AND CURRENT ROW), false) AS gone FROM again
),
k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM covered GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_CRC_OF_C = (
    "xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda s, x: list_reduce(range(8), "
    "lambda k, i: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END, xor(s, x)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
)

_OP13 = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS r, strlen(coalesce(text, '')) AS bytes,
    sha256(concat(length(coalesce(role, '')), ':', role, text)) AS turn_key
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT c, n, c - c % 5 AS b, {_CRC_OF_C} % 9 AS h FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
sized AS (SELECT a.*, least(a.h, coalesce(o.n, 0)) AS m FROM convs a LEFT JOIN convs o ON o.c = a.b),
rebuilt AS (
  SELECT s.c, t.r + 1 AS d, turn_key, bytes FROM sized s JOIN t ON t.c = s.b AND t.r < s.h
  UNION ALL SELECT s.c, s.m + t.r - s.h + 1, turn_key, bytes FROM sized s JOIN t ON t.c = s.c AND t.r >= s.h
),
lists AS (SELECT c, list(turn_key ORDER BY d) AS keys, list(bytes ORDER BY d) AS sizes FROM rebuilt GROUP BY c),
whole AS (SELECT c, coalesce(keys, []) AS keys, coalesce(sizes, []) AS sizes, coalesce(len(keys), 0) AS total FROM convs LEFT JOIN lists USING (c)),
member AS (
  SELECT c, total, d, array_to_string(keys[1 : d], '/') AS path, array_to_string(keys[1 : d - 1], '/') AS above, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes, keys
  FROM (SELECT *, unnest(range(0, total + 1)) AS d FROM whole)
),
node AS (
  SELECT path, d, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, any_value(keys[1 : d]) AS keys,
    string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (total = d) AS ends
  FROM member GROUP BY path, d
),
born AS (SELECT above AS path, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
sub AS (
  SELECT a AS d, array_to_string(keys[1 : a], '/') AS path, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
  FROM (SELECT node.*, n_children, unnest(range(0, node.d + 1)) AS a FROM node LEFT JOIN born USING (path, d)) GROUP BY 1, 2
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM node n JOIN sub USING (path, d) LEFT JOIN born USING (path, d) LEFT JOIN node p ON n.d > 0 AND p.path = n.above AND p.d = n.d - 1
"""

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": _OP3, "op4_near_duplicates": _OP4, "op5_mix": _OP5, "op7_exact_dedup": _OP7, "op8_substring_dedup": _OP8,
    "op13_prefix_trie": _OP13,
}
