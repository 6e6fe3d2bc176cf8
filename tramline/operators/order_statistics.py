"""Exact running quantiles of keyed facts, where one key may hold any share of the rows.

Keys of up to WHOLE rows are dealt by key, and a task selects for all queries of some keys at once.  Hotter keys are ranged by (key,
time), so that each is cut into pieces by time.  A piece with m facts only needs those
order statistics of all earlier facts that its own facts can push a quantile to: a band of 2 m + 3 ranks.  The band is found
without sorting the key:

1. a histogram of the key's values by piece and value bin (bins from an approximate percentile, which only balances them);
2. prefix sums over pieces: how many earlier facts lie in each bin when a piece begins; sums over bins turn ranks into bins;
3. facts of just those bins, with equal values counted together, go to the pieces that asked for them;
4. a piece selects each rank among its band and its own facts so far, all queries at once, by descending the bits of the values'
   ranks (a wavelet matrix).

What travels is about five times the rows of cut keys, however hot; no piece holds more than a range of rows and its bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.session import importable
from tramline.sources.shared import written

#: Value bins of a key: two for each of its pieces, at most as many.
MOST_BINS = 4096
#: Rows of a key that one task may hold; keys with more are cut.  Rows of whole keys that are worked on together.
WHOLE, TOGETHER = 2_000_000, 200_000
#: Rows of a piece of cut keys.
PIECE = 500_000
#: Bounds of a key up to which a value is compared with each of them.
FEW_BOUNDS = 64
_ORDER = ["k", "t", "kind", "leg_id"]


def selected(values: np.ndarray, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For every question the k-th smallest (from 0) of values[left:right]."""
    distinct, code = np.unique(values, return_inverse=True)
    found = np.zeros(len(k), np.int64)
    for b in reversed(range(max(1, int(len(distinct) - 1).bit_length()))):
        one = (code >> b & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        zl, zr = zeros[left], zeros[right]
        up = k >= zr - zl
        k = np.where(up, k - (zr - zl), k)
        left, right = np.where(up, zeros[-1] + left - zl, zl), np.where(up, zeros[-1] + right - zr, zr)
        found |= up.astype(np.int64) << b
        code = np.concatenate([code[~one], code[one]])
    return distinct[found]


def quantiles_of(values: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray, below: int, q: float) -> np.ndarray:
    """Interpolated quantile q of n values each, of which the least ``below`` are left out of values[left:right]; nan for none."""
    some = np.flatnonzero(n > 0)
    at = q * (n[some] - 1)
    low = at.astype(np.int64)
    high = np.minimum(low + 1, n[some] - 1)
    out = np.full(len(n), np.nan)
    if len(some):
        l2, r2 = np.tile(left[some], 2), np.tile(right[some], 2)
        a, b = selected(values, l2, r2, np.concatenate([low, high]) - below).reshape(2, -1)
        out[some] = a + (b - a) * (at - low)
    return out


def _band(q: float, n0: int, m: int) -> tuple[int, int]:
    """Ranks of n0 earlier facts that the quantile can reach while m more facts come."""
    return max(0, int(np.floor(q * (n0 - 1))) - m), min(n0 - 1, int(np.floor(q * (n0 + m - 1))) + 1)


def pieces(ranged: DataFrame) -> DataFrame:
    """(part, k, m, n0, group, count): ranges and keys that are cut, with own facts, earlier facts and the key's first range."""
    by_key = Window.partitionBy("k")
    earlier = by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    m = ranged.groupBy("part", "k").agg(F.count("v").alias("m"))
    return m.select(
        "part", "k", "m", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("n0"), F.min("part").over(by_key).alias("group"),
        F.count("*").over(by_key).alias("count"),
    ).where("count > 1")


def _binned(facts: DataFrame, bounds: dict[int, np.ndarray]) -> DataFrame:
    """The bin of each value: how many of its group's bounds lie below.  Few bounds are compared in the JVM, many searched in Python."""
    spark = facts.sparkSession
    if max(map(len, bounds.values()), default=0) <= FEW_BOUNDS:
        rows = spark.createDataFrame([(g, b.tolist()) for g, b in bounds.items()], "group int, at array<double>")
        found = facts.join(F.broadcast(rows), "group")  # two numbers for each piece
        return found.select("group", "part", "v", F.size(F.filter("at", lambda x: x < F.col("v"))).alias("bin"))
    held = spark.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, v = b.column("group").to_numpy(), b.column("v").to_numpy()
            bins = np.zeros(len(v), np.int32)
            for g in np.unique(group).tolist():
                at = group == g
                bins[at] = np.searchsorted(held.value[g], v[at], side="left")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bins)], names=["group", "part", "v", "bin"])

    return facts.mapInArrow(run, "group int, part int, v double, bin int")


def _bands(ranged: DataFrame, cut: DataFrame, quantiles: list[float], n: int) -> DataFrame:
    """(part, qi, v, c): for cut keys, earlier facts that a piece needs, counted; v null: facts below them; qi -1: all earlier facts."""
    # At most two pieces for each range, whatever the data: they come to the driver once, instead of being counted again below.
    cut = ranged.sparkSession.createDataFrame(cut.collect(), cut.schema)
    own = cut.select(F.col("part").alias("p"), F.col("k").alias("key"), "group", "count")
    facts = ranged.where("v is not null").join(F.broadcast(own), (F.col("part") == F.col("p")) & F.col("k").eqNullSafe(F.col("key")))
    most = min(2 * n, MOST_BINS)
    at = F.percentile_approx("v", [i / most for i in range(1, most)], 1000)
    step = F.greatest(F.lit(1), F.floor(F.lit(most) / (2 * F.col("count"))))
    bounds = facts.groupBy("group", "count").agg(at.alias("at")).select("group", F.array_distinct(F.filter("at", lambda x, i: i % step == 0)).alias("at"))
    bounds = {r["group"]: np.array(r["at"]) for r in bounds.collect()}  # two numbers for each piece
    binned = _binned(facts.select("group", "part", "v"), bounds)

    spark = ranged.sparkSession
    bins = spark.createDataFrame([(g, len(b)) for g, b in bounds.items()], "group int, last int")
    grid = cut.select("group", "part", "m", "n0").join(F.broadcast(bins), "group").withColumn("bin", F.explode(F.sequence(F.lit(0), "last")))
    counts = binned.groupBy("group", "part", "bin").agg(F.count("*").alias("own"))
    before = Window.partitionBy("group", "bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy("group", "part").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.join(counts, ["group", "part", "bin"], "left").withColumn("c", F.coalesce(F.sum("own").over(before), F.lit(0))).where("n0 > 0")
    grid = grid.withColumn("below", F.coalesce(F.sum("c").over(lower), F.lit(0)))
    q = F.explode(F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(x)).alias("q")) for i, x in enumerate(quantiles)]))
    low = F.greatest(F.lit(0), F.floor(F.col("z.q") * (F.col("n0") - 1)) - F.col("m"))
    high = F.least(F.col("n0") - 1, F.floor(F.col("z.q") * (F.col("n0") + F.col("m") - 1)) + 1)
    asked = grid.withColumn("z", q).where((F.col("c") > 0) & (F.col("below") + F.col("c") > low) & (F.col("below") <= high))
    asked = written(asked.select("group", "part", "bin", "below", "n0", "z.qi"), "asked")

    heads = asked.groupBy("part", "qi").agg(F.min("below").alias("c"))
    totals = cut.where("n0 > 0").select("part", F.lit(-1).alias("qi"), F.col("n0").alias("c"))
    heads = heads.unionByName(totals).select("part", "qi", F.lit(None).cast("double").alias("v"), "c")
    # A few bins for each piece and quantile, whatever the data.
    to = asked.groupBy("group", "bin").agg(F.collect_list(F.struct(F.col("part").alias("to"), "qi")).alias("to"))
    sent = binned.join(F.broadcast(to), ["group", "bin"]).withColumn("to", F.explode("to")).where("part < to.to")
    return sent.groupBy(F.col("to.to").alias("part"), F.col("to.qi").alias("qi"), "v").agg(F.count("*").alias("c")).unionByName(heads)


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches come sorted by part: one table for each part."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        part = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if x == y:
                continue
            if held and held[-1].column(0)[0].as_py() != part[x]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _part_quantiles(part: pa.Table, quantiles: list[float]) -> tuple[pa.Array, pa.Array, np.ndarray, list[np.ndarray]]:
    """Keys, legs, counts and quantiles of the queries of one range of rows, its bands at the top."""
    fore = int((part.column("ord").to_numpy() == 0).sum()) if "ord" in part.column_names else 0
    qi, band_v, band_c = (part.column(c).slice(0, fore).to_numpy() for c in ("qi", "v", "c")) if fore else (None, None, None)
    rows = part.slice(fore)
    kind, v = rows.column("kind").to_numpy(), rows.column("v").to_numpy()
    code = rows.column("k").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    begins = np.ones(len(code), bool)
    begins[1:] = code[1:] != code[:-1]
    known = (kind == 0) & ~np.isnan(v)
    upto = np.cumsum(known)
    first = np.flatnonzero(begins)
    left = (upto - known)[first][np.cumsum(begins) - 1]
    asks = np.flatnonzero(kind == 1)
    left, right, values = left[asks], upto[asks], v[known]
    n = right - left
    out = [quantiles_of(values, left, right, n, 0, q) for q in quantiles]
    if fore:  # the first key has earlier pieces
        end = first[1] if len(first) > 1 else len(code)
        mine = asks < end
        own = values[: int(known[:end].sum())]
        n0 = int(band_c[qi == -1][0])
        n[mine] += n0
        for i, q in enumerate(quantiles):
            at = (qi == i) & ~np.isnan(band_v)
            low, high = _band(q, n0, len(own))
            upto_c = int(band_c[(qi == i) & np.isnan(band_v)][0]) + np.cumsum(band_c[at])
            times = np.minimum(upto_c, high + 1) - np.maximum(upto_c - band_c[at], low)
            band = np.repeat(band_v[at], np.maximum(times, 0))
            out[i][mine] = quantiles_of(np.concatenate([band, own]), np.zeros(mine.sum(), np.int64), len(band) + right[mine], n[mine], low, q)
    return rows.column("k").take(pa.array(asks)), rows.column("leg_id").take(pa.array(asks)), n, out


def by_whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches come sorted by key: tables of whole keys, of TOGETHER rows or more but for the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < TOGETHER:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        code = table.column("k").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        change = np.flatnonzero(code[1:] != code[:-1]) + 1
        if len(change):
            yield table.slice(0, int(change[-1]))
            held = table.slice(int(change[-1])).combine_chunks().to_batches()
            rows = table.num_rows - int(change[-1])
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _found(tables: Iterator[pa.Table], names: list[str], qs: list[float]) -> Iterator[pa.RecordBatch]:
    for t in tables:
        k, leg, counts, found = _part_quantiles(t, qs)
        flat = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        columns = [flat(k), flat(leg), pa.array(counts, pa.int64()), *(pa.array(x, mask=np.isnan(x)) for x in found)]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "leg_id", "n", *names])


def running_quantiles(rows: DataFrame, value: str, quantiles: dict[str, float], partitions: int | None = None) -> DataFrame:
    """Exact interpolated quantiles of a key's facts known at each of its queries: k, leg_id, n, and one column per quantile.

    ``rows`` is a timeline (k, t, kind, leg_id, ``value``): facts (kind 0) count for queries (kind 1) from their place in (t,
    kind, leg_id) order on.  Null and nan values don't count; without facts quantiles are null; a null key is a key.
    """
    spark = rows.sparkSession
    importable(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(value).cast("double")
    d = rows.select(F.col("k").cast("string").alias("k"), "t", "kind", "leg_id", F.when((F.col("kind") == 0) & ~F.isnan(v), v).alias("v"))
    names, qs = list(quantiles), list(quantiles.values())
    ddl = f"k string, leg_id {d.schema['leg_id'].dataType.simpleString()}, n long, " + ", ".join(f"{c} double" for c in names)
    hot = d.groupBy("k").agg(F.count("*").alias("rows")).where(F.col("rows") > WHOLE).select(F.col("k").alias("key"), "rows")
    hot = written(hot, "hot")
    cool = d
    if hot.take(1):
        is_hot = F.col("k").eqNullSafe(F.col("key"))
        cool = d.join(hot.select("key"), is_hot, "left_anti")
    dealt = cool.repartition(n, "k").sortWithinPartitions(*_ORDER)
    out = dealt.mapInArrow(lambda b: _found(by_whole_keys(b), names, qs), ddl)
    if cool is d:
        return out
    # As many pieces as keep each at about PIECE rows, however many rows hot keys have.
    n = max(n, -(-hot.agg(F.sum("rows")).first()[0] // PIECE))
    return out.unionByName(_cut_quantiles(d.join(hot.select("key"), is_hot, "left_semi"), names, qs, n, ddl))


def _cut_quantiles(d: DataFrame, names: list[str], qs: list[float], n: int, ddl: str) -> DataFrame:
    """The quantiles of hot keys, each cut into pieces by ranges of (key, time)."""
    # Written once: ranges come from a sample, and two evaluations could differ.
    ranged = written(d.repartitionByRange(n, *_ORDER).withColumn("part", F.spark_partition_id()), "timeline")
    bands = _bands(ranged, pieces(ranged), qs, n).select(
        "part", F.lit(0).alias("ord"), *[F.lit(None).cast(ranged.schema[c].dataType).alias(c) for c in _ORDER], "v", "qi", "c"
    )
    own = ranged.select("part", F.lit(1).alias("ord"), *_ORDER, "v", F.lit(None).cast("int").alias("qi"), F.lit(None).cast("long").alias("c"))
    dealt = own.unionByName(bands).repartition(n, "part").sortWithinPartitions("part", "ord", *_ORDER, "qi", "v")
    return dealt.mapInArrow(lambda b: _found(_whole_parts(b), names, qs), ddl)
