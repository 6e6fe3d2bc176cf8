"""Comparison of tables, scoring of extractions, sampling, text documents and nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.columns import draw, ratio, wilson
from tramline.functions.rank import global_rank
from tramline.session import importable


# ---- reconciliation -------------------------------------------------------------------------------------------------
def reconcile(a: DataFrame, b: DataFrame, key: list[str], tolerance: dict[str, float], explained: Column | None = None) -> DataFrame:
    """One row per column: compared, equal within tolerance, mismatched, explained, and the largest difference.

    A full outer join and one aggregate for all columns; keys on one side only are counted as missing and added.
    """
    left = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in tolerance], F.lit(1).alias("_a"))
    right = b.select(*key, *[F.col(c).alias(f"b_{c}") for c in tolerance], F.lit(1).alias("_b"))
    d = left.join(right, key, "full")
    ok = {c: (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= t) | (F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull()) for c, t in tolerance.items()}
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    why = explained if explained is not None else F.lit(False)
    one = d.agg(
        F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("added"), F.count_if(both).alias("compared"),
        *[F.count_if(both & ~F.coalesce(ok[c], F.lit(False))).alias(f"{c}__bad") for c in tolerance],
        *[F.count_if(both & ~F.coalesce(ok[c], F.lit(False)) & why).alias(f"{c}__why") for c in tolerance],
        *[F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).cast("double").alias(f"{c}__most") for c in tolerance],
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__bad").alias("mismatched"), F.col(f"{c}__why").alias("explained"), F.col(f"{c}__most").alias("most")) for c in tolerance]
    return one.select("missing", "added", "compared", F.explode(F.array(*rows)).alias("e")).select("e.column", "missing", "added", "compared", "e.mismatched", "e.explained", "e.most")


def metric_diff(old: DataFrame, new: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(metric, state): changed, missing or added metrics of two snapshots (metric, value)."""
    d = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), "metric", "full")
    state = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "added").when(F.abs(F.col("old") - F.col("new")) > tolerance, "changed")
    return d.withColumn("state", state).where("state is not null")


def frozen(metrics: DataFrame, files: DataFrame) -> DataFrame:
    """A snapshot to be kept: metrics (metric, value, source) with the hash of the file that each comes from (files: file, sha256).

    A source without a file has a null hash.
    """
    return metrics.join(files.select(F.col("file").alias("source"), "sha256"), "source", "left").select("metric", "value", "source", "sha256")


def moved_since(snapshot: DataFrame, metrics: DataFrame, files: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(kind, name, state, source) of what moved since a snapshot: metrics that changed, are missing or were added, metrics whose
    file is gone (unreadable), and files whose bytes were rewritten.

    A file can be rewritten without any metric moving, and a metric can change without its file: they are separate rows,
    and only the metrics' make a snapshot unclean.  Two null values are equal.
    """
    now = frozen(metrics, files)
    old = snapshot.select("metric", F.col("value").alias("was"), F.col("source").alias("old_source"), F.lit(True).alias("there"))
    new = now.select("metric", F.col("value").alias("is"), "source", F.col("sha256").isNull().alias("gone"), F.lit(True).alias("here"))
    d = old.join(new, "metric", "full")
    differs = ~F.coalesce(F.abs(F.col("was") - F.col("is")) <= tolerance, F.col("was").isNull() & F.col("is").isNull())
    state = F.when(F.col("here").isNull(), "missing").when(F.col("gone"), "unreadable").when(F.col("there").isNull(), "added").when(differs, "changed")
    moved = d.select(F.lit("metric").alias("kind"), F.col("metric").alias("name"), state.alias("state"), F.coalesce("source", "old_source").alias("source"))
    kept = snapshot.where("sha256 is not null").select("source", "sha256").distinct()
    touched = kept.join(files.select(F.col("file").alias("source"), F.col("sha256").alias("now")), "source", "left").where(~F.col("sha256").eqNullSafe(F.col("now")))
    return moved.where("state is not null").unionByName(touched.select(F.lit("file").alias("kind"), F.col("source").alias("name"), F.lit("rewritten").alias("state"), "source"))


def same_alerts(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: alerts in both sets, in either only, and the largest difference of the value."""
    d = a.select("alert_id", F.col(value).alias("x")).join(b.select("alert_id", F.col(value).alias("y")), "alert_id", "full")
    return d.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"), F.count_if(F.col("y").isNull()).alias("only_first"), F.count_if(F.col("x").isNull()).alias("only_second"), F.max(F.abs(F.col("x") - F.col("y"))).alias("most"))


# ---- scoring --------------------------------------------------------------------------------------------------------
def extraction_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per field over long (doc, field, value) tables: right, wrong, missed and invented values, precision, recall, F1."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    t = truth.select("doc", "field", norm(F.col("value")).alias("t"))
    p = predicted.select("doc", "field", norm(F.col("value")).alias("p"))
    d = t.join(p, ["doc", "field"], "full")
    right = F.col("t") == F.col("p")
    s = d.groupBy("field").agg(
        F.count_if(right).alias("right"), F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull() & ~right).alias("wrong"),
        F.count_if(F.col("t").isNotNull() & F.col("p").isNull()).alias("missed"), F.count_if(F.col("t").isNull() & F.col("p").isNotNull()).alias("invented"),
    )
    fp, fn = F.col("wrong") + F.col("invented"), F.col("wrong") + F.col("missed")
    s = s.withColumn("precision", ratio(F.col("right"), F.col("right") + fp)).withColumn("recall", ratio(F.col("right"), F.col("right") + fn))
    return s.withColumn("f1", ratio(2 * F.col("right"), 2 * F.col("right") + fp + fn))


def path_coverage(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, n, state): how often each path was taken; expected ones never taken and taken ones not expected are marked."""
    d = runs.groupBy("path").agg(F.count("*").alias("n")).join(expected.select("path", F.lit(1).alias("e")), "path", "full")
    state = F.when(F.col("n").isNull(), "never taken").when(F.col("e").isNull(), "not expected").otherwise("covered")
    return d.select("path", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def question_scores(answers: DataFrame, key: DataFrame) -> DataFrame:
    """Per question set: share of answers by the right route and from the right source, with intervals."""
    d = key.join(answers, "question", "left")
    right = F.coalesce(F.col("route") == F.col("right_route"), F.lit(False))
    s = d.groupBy("question_set").agg(F.count("*").alias("n"), F.count_if(right).alias("hits"), F.count_if(right & (F.col("source") == F.col("right_source"))).alias("both"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return s.withColumn("low", low).withColumn("high", high)


def unsupported_numbers(answers: DataFrame) -> DataFrame:
    """Per answer (id, answer, context): numbers that the context has neither as such nor rounded to fewer digits."""
    numbers = lambda c: F.transform(F.regexp_extract_all(F.regexp_replace(c, r"(?<=\d),(?=\d{3})", ""), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    had = F.flatten(F.transform(numbers(F.col("context")), lambda x: F.array(x, F.round(x, 0), F.round(x, 1), F.round(x, 2))))
    out = F.array_except(numbers(F.col("answer")), had)
    return answers.select("id", F.array_sort(out).alias("unsupported"), F.size(out).alias("n"))


# ---- sampling -------------------------------------------------------------------------------------------------------
def spread_sample(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """n rows evenly spaced in the order: the row at the end of each of n equal runs."""
    r = global_rank(df, order, "_pos")
    size = df.agg(F.count("*").alias("_all"))
    slot = lambda p: F.floor(p * n / F.col("_all"))
    return r.join(F.broadcast(size)).where(slot(F.col("_pos")) > slot(F.col("_pos") - 1)).drop("_pos", "_all")  # one row


def stratified_sample(df: DataFrame, stratum: str, unit: str, n: int, seed: int = 1) -> DataFrame:
    """n rows of every stratum, by hash."""
    w = Window.partitionBy(stratum).orderBy(draw(seed, F.col(unit)), unit)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def round_robin(df: DataFrame, stratum: str, unit: str, n: int, seed: int = 1) -> DataFrame:
    """n rows in all, one stratum after another, so that small strata are full before large ones take more."""
    w = Window.partitionBy(stratum).orderBy(draw(seed, F.col(unit)), unit)
    return df.withColumn("_n", F.row_number().over(w)).orderBy("_n", stratum).limit(n).drop("_n")


# ---- documents ------------------------------------------------------------------------------------------------------
def hub_sentences(hubs: DataFrame) -> DataFrame:
    """Supported hubs as documents: id, a sentence on dwell, handoffs and rank, and a map of metadata (values as texts)."""
    d = hubs.where("has_support")
    minutes, share = F.round("median_dwell_min_out", 0).cast("int"), F.round(F.col("median_dwell_share_out") * 100, 0).cast("int")
    text = F.format_string("Hub %s holds a leg for %d minutes in the middle, %d %% of its time, over %d legs; it ranks %d by friction.", F.col("centre_code"), minutes, share, F.col("n_legs_out"), F.col("friction_rank"))
    keys = ["kind", "hub", "route", "legs", "friction_rank"]
    values = [F.lit("hub"), F.col("centre_code"), F.col("main_route"), F.col("n_legs_out").cast("string"), F.col("friction_rank").cast("string")]
    meta = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*values))
    return d.select(F.concat(F.lit("hub:"), "centre_code").alias("doc_id"), text.alias("text"), meta.alias("metadata"))


def sentences(corridors: DataFrame) -> DataFrame:
    """Corridor rows as documents: id, a sentence, and a map of metadata."""
    text = F.format_string("Corridor %s has %s legs and runs at %s times the network's ratio.", "corridor_id", "n_legs", F.round("excess_ratio", 2).cast("string"))
    meta = F.map_from_arrays(F.array(F.lit("kind"), F.lit("corridor")), F.array(F.lit("corridor"), F.col("corridor_id")))
    return corridors.select(F.concat(F.lit("corridor:"), "corridor_id").alias("doc_id"), text.alias("text"), meta.alias("metadata"))


def sections(docs: DataFrame, least: int = 200) -> DataFrame:
    """Markdown documents cut before headings (of any depth); a section under ``least`` characters is put before the next one."""
    parts = F.filter(F.split("text", r"(?m)(?=^#{1,6} )"), lambda p: F.length(F.trim(p)) > 0)
    start = F.struct(F.lit("").alias("held"), F.expr("cast(array() as array<string>)").alias("done"))

    def add(acc: Column, p: Column) -> Column:
        now = F.concat(acc["held"], p)
        full = F.length(now) >= least
        return F.struct(F.when(full, "").otherwise(now).alias("held"), F.when(full, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"))

    def close(acc: Column) -> Column:
        short = F.length(acc["held"]) > 0
        return F.when(short, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])

    return docs.select("doc_id", F.posexplode(F.aggregate(parts, start, add, close)).alias("section", "text"))


#: Queries and base vectors of a block (2 and 4 MB of 64-dimensional vectors); a pair of blocks is the work of one task at a time.
QUERY_BLOCK, BASE_BLOCK = 4_096, 8_192
#: Queries of a block that are compared with its base vectors at once.
_TILE = 128
#: Similarities are compared at nine digits; what lies further than this below the k-th can't tie with it.
_SLACK = 2e-9


def _similar(u: np.ndarray, w: np.ndarray, ids: np.ndarray, b_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base vector, similarity) of a superset of each query's k nearest; ``b_ids`` ascend.

    A matrix product finds the candidates; their similarities are summed in order, as Spark's aggregate does.  Of
    candidates that are exactly as similar, the first k by b_id can be among the k nearest.
    """
    s = u @ w.T
    s[np.isnan(s)] = np.inf
    own = np.searchsorted(b_ids, ids, "left"), np.searchsorted(b_ids, ids, "right")
    for i, (a, z) in enumerate(zip(*own, strict=True)):
        s[i, a:z] = -np.inf
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - _SLACK if s.shape[1] > k else np.full(len(s), -np.inf)
    q, b = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    exact = np.zeros(len(q))
    for j in range(w.shape[1]):
        exact += w[b, j] * u[q, j]
    order = np.lexsort((b, np.where(np.isnan(exact), -np.inf, -exact), q))
    q, b, exact = q[order], b[order], exact[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | ~((exact[1:] == exact[:-1]) | (np.isnan(exact[1:]) & np.isnan(exact[:-1])))
    place = np.arange(len(q))
    keep = place - np.maximum.accumulate(np.where(new, place, 0)) < k
    return q[keep], b[keep], exact[keep]


def _block(q: pd.DataFrame, b: pd.DataFrame, k: int, nulls: bool) -> Iterator[pd.DataFrame]:
    """Candidates of a block of queries (vec_id, u, size, same) among a block of base vectors (b_id, w, size, same).

    Vectors of different sizes, null ones and those with null elements (size null) have no similarity: with ``nulls``,
    such pairs are answers after all others.
    """
    b = b.sort_values("b_id", kind="stable")
    for same, qs in q.groupby("same"):
        bs = b[b["same"] == same]
        for size, of_size in qs.groupby("size", dropna=False):
            fit = (bs["size"] == size).to_numpy()
            ids = of_size["vec_id"].to_numpy()
            if fit.any():
                w, b_ids = np.stack(bs["w"][fit].to_list()), bs["b_id"][fit].to_numpy()
                for at in range(0, len(ids), _TILE):
                    tile = of_size.iloc[at : at + _TILE]
                    i, j, s = _similar(np.stack(tile["u"].to_list()), w, ids[at : at + _TILE], b_ids, k)
                    yield pd.DataFrame({"vec_id": ids[at + i], "b_id": b_ids[j], "similarity": s, "known": True})
            rest = bs["b_id"][~fit].to_numpy()
            for x in ids if nulls and len(rest) else ():
                b_ids = rest[: k + np.count_nonzero(rest == x)]
                b_ids = b_ids[b_ids != x][:k]
                yield pd.DataFrame({"vec_id": np.full(len(b_ids), x), "b_id": b_ids, "similarity": 0.0, "known": False})


def nearest(base: DataFrame, queries: DataFrame, k: int, least: float | None = None, same: str | None = None) -> DataFrame:
    """The k most similar base vectors of every query by cosine, from (vec_id, embedding [, same]).

    A stated query set runs against all rows: every block of queries meets every block of the base in a task, which keeps little more
    than k rows per query before they meet.  ``same`` restricts to equal values; ``least`` refuses answers below a
    similarity.  All pairs are compared, so the work is the product of both numbers of rows; a task's memory is bounded.
    """
    importable(base.sparkSession)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y.cast("double") * y))
    unit = lambda v: F.transform(F.array(length(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]  # noqa: E731 (one length a vector)
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.size(c)).alias("size")
    group = (F.col(same) if same else F.lit(0)).alias("same")
    n_q, n_b = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-base.count() // BASE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.where("vec_id is not null").select("vec_id", unit(F.col("embedding")).alias("u"), whole(F.col("embedding")), group, block(n_q).alias("q_block"))
    b = base.where("vec_id is not null").select(F.col("vec_id").alias("b_id"), unit(F.col("embedding")).alias("w"), whole(F.col("embedding")), group, block(n_b).alias("b_block"))
    q, b = q.select("*", every(n_b).alias("b_block")), b.select("*", every(n_q).alias("q_block"))
    id_type = {n: d.schema["vec_id"].dataType.simpleString() for n, d in (("q", queries), ("b", base))}
    nulls = least is None

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(_block(left, right, k, nulls))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"vec_id": [], "b_id": [], "similarity": [], "known": []})

    d = q.groupBy("q_block", "b_block").cogroup(b.groupBy("q_block", "b_block")).applyInPandas(meet, f"vec_id {id_type['q']}, b_id {id_type['b']}, similarity double, known boolean")
    d = d.select("vec_id", "b_id", F.when(F.col("known"), F.round("similarity", 9)).alias("similarity"))
    if least is not None:
        d = d.where(F.col("similarity") >= least)
    w = Window.partitionBy("vec_id").orderBy(F.col("similarity").desc(), "b_id")
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
