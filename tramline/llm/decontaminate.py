"""Benchmark decontamination with one Aho-Corasick automaton over the windows of all benchmark texts.

Texts are normalised to words separated by single spaces, so that the automaton finds whole-word windows, overlapping ones
too, in one scan of the text; match positions are then mapped to words, and words to offsets in the original.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import arrow_map, column_of, kept, set_aside, text_buffer, written

WINDOW = 13
#: One automaton holds items of at most so many words; a larger benchmark is scanned for in several blocks of items.
BLOCK_WORDS = 400_000

#: A-Z to a-z; digits, letters and all bytes of characters beyond ASCII stay; everything else becomes a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def windows(item: list[bytes]) -> set[bytes]:
    """All runs of WINDOW words; an item of fewer words is one window, an item without words none."""
    if not item:
        return set()
    return {b" ".join(item[i : i + WINDOW]) for i in range(max(1, len(item) - WINDOW + 1))}


def _automaton(items: list[tuple[str, str]]):
    """Automaton over the windows, and for each window its length in words and the items that have it; one per worker."""

    def build():
        import ahocorasick

        having: dict[bytes, list[int]] = {}
        for k, (_, text) in enumerate(items):
            for w in windows(words((text or "").encode())):
                having.setdefault(w, []).append(k)
        auto = ahocorasick.Automaton()
        for w, ks in having.items():
            spaced = " " + w.decode("latin-1") + " "
            auto.add_word(spaced, (len(spaced), w.count(b" ") + 1, ks))
        if having:
            auto.make_automaton()
        return auto if having else None

    return kept(hashlib.sha256(repr(items).encode()).hexdigest(), build)


def hit_words(text: bytes, auto) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, the merged ranges of hit words, and the items found."""
    own = words(text)
    if auto is None or not own:
        return len(own), [], set()
    line = (b" " + b" ".join(own) + b" ").decode("latin-1")
    ranges: list[list[int]] = []
    items: set[int] = set()
    at = count = 0
    for end, (chars, n, ks) in auto.iter(line):
        begin = end - chars + 1
        count += line.count(" ", at, begin) if begin >= at else -line.count(" ", begin, at)
        at = begin
        if ranges and count <= ranges[-1][1]:
            ranges[-1][0], ranges[-1][1] = min(ranges[-1][0], count), max(ranges[-1][1], count + n)
        else:
            ranges.append([count, count + n])
        items.update(ks)
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return len(own), [(a, b) for a, b in merged], items


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of ranges of words."""
    if not ranges:
        return []
    raw = np.frombuffer(text.translate(_WORD_BYTES), np.uint8) != 32
    edge = np.diff(raw.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    head = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(head[starts[a]]), int(head[ends[b - 1]])) for a, b in ranges]


_LISTS = pa.list_(pa.list_(pa.int64()))
_FOUND = {"n_words": pa.int64(), "ranges": _LISTS, "spans": _LISTS, "items": pa.list_(pa.string())}
_DDL = "n_words long, ranges array<array<long>>, spans array<array<long>>, items array<string>"


def item_blocks(benchmark: DataFrame) -> tuple[int, Callable[[int], list[tuple[str, str]]]]:
    """Number of blocks of bounded size, and what reads one: its items as (id as text, text); a null item_id is read as \\N."""
    size = F.length(F.coalesce("text", F.lit(""))) / 2 + 1
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    n = int(total // BLOCK_WORDS) + 1
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("\\N")).alias("id"), "text")
    if n > 1:
        rows = written(rows.distinct().withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")), "items", "block")

    def block(k: int) -> list[tuple[str, str]]:
        own = rows.where(F.col("block") == k) if n > 1 else rows
        return sorted((r["id"], r["text"] or "") for r in own.select("id", "text").collect())

    return n, block


def scan(docs: DataFrame, held: Broadcast, keep: list[str]) -> DataFrame:
    """Per row of ``docs``: the columns ``keep``, n_words, hit word ranges, their spans in the original text, and the items
    found.  One scan, no exchange."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, ids = _automaton(held.value), [i for i, _ in held.value]
        for batch in batches:
            data, off = text_buffer(column_of(batch, "text"))
            n_words, ranges, spans, found = [], [], [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                text = data[a:b].tobytes()
                n, own, ks = hit_words(text, auto)
                n_words.append(n)
                ranges.append(own)
                spans.append(original_spans(text, own))
                found.append(sorted({ids[k] for k in ks}))
            made = [pa.array(c, t) for c, t in zip([n_words, ranges, spans, found], _FOUND.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[column_of(batch, c) for c in keep], *made], [*keep, *_FOUND])

    return arrow_map(docs, find, StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(_DDL).fields]))


def judged(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and beside them n_words, n_hit, n_items, items, spans, contaminated."""
    spark = docs.sparkSession
    n, block = item_blocks(benchmark)
    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    if n == 1:
        found = scan(docs, spark.sparkContext.broadcast(block(0)), keep)
    else:
        keyed = written(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
        parts = []
        for k in range(n):
            held = spark.sparkContext.broadcast(block(k))
            own = scan(keyed.select("_row", "text"), held, ["_row"])
            # All rows come from the first block's scan; of the others only those with hits are needed.
            parts.append(written(own.where(F.size("ranges") > 0) if k else own, "hits"))
            held.destroy()
        found = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"),
            F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
        found = keyed.select("_row", *keep).join(found, "_row")
    # Ranges of one scan are disjoint; those of several may overlap, so words are counted as a running union.
    start = F.expr("struct(cast(0 as bigint) as n, cast(0 as bigint) as upto)")
    add = lambda acc, r: F.struct(
        (acc["n"] + F.greatest(F.lit(0), r[1] - F.greatest(r[0], acc["upto"]))).alias("n"), F.greatest(acc["upto"], r[1]).alias("upto")
    )
    n_hit = F.aggregate(F.sort_array("ranges"), start, add)["n"]
    return found.select(
        *keep, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sort_array("items").alias("items"), F.sort_array("spans").alias("spans"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items, spans, contaminated.

    Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII.  A word is hit if it lies in an
    occurrence of a benchmark window of 13 words; contaminated: at least one hit, and 20 * n_hit >= n_words.  spans: hit
    ranges as code-point offsets in the original text.  Null and empty texts have no words and are clean; an empty
    benchmark hits nothing; items that repeat an id count once.  Rows with a null or repeated doc_id are judged each.
    Other columns are ignored.  A benchmark over BLOCK_WORDS is scanned for block by block, one in memory at a time, and
    the hits of a row are united by a key of its own, written once.
    """
    return judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, ["doc_id"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all columns, whatever their names.  Each is judged by itself, whatever its
    doc_id; null and empty texts stay; texts of any length are scanned whole."""
    own, back = set_aside(docs, "text")
    return back(judged(own, benchmark, own.columns).where("not contaminated"))
