"""Running statistics of keyed legs in arrays, whole keys at a time: one exchange, and no row meets another by its leg.

Facts of a table of whole keys are sorted by (key, finish); a leg's history is the stretch of its key's facts up to its creation.  Sums
and deviations of all stretches come from neighbouring spans merged, doubling the spans each round, so none is a
difference of larger ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.columns import micros
from tramline.session import importable

from .order_statistics import by_whole_keys, quantiles_of

#: Buckets of time into which a trailing span is cut.
SPAN_BUCKETS = 8
#: A missing time: before all others, as Spark sorts it.
_NEVER = -(2**62)


def _places(begins: np.ndarray) -> np.ndarray:
    """For every row, how many rows of its stretch lie before it."""
    at = np.arange(len(begins))
    return at - np.maximum.accumulate(np.where(begins, at, 0))


def running_sums(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sum of a stretch's rows up to each row."""
    x, place, step = x.copy(), _places(begins), 1
    while step <= place.max(initial=0):
        x[step:] += np.where(place[step:] >= step, x[:-step], 0.0)
        step *= 2
    return x


def running_deviations(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sample deviation of a stretch's rows up to each row; nan for the first."""
    n, mean, squares, place, step = np.ones(len(x)), x.copy(), np.zeros(len(x)), _places(begins), 1
    while step <= place.max(initial=0):
        b = np.flatnonzero(place >= step)
        a = b - step
        both, delta = n[a] + n[b], mean[b] - mean[a]
        squares[b] = squares[a] + squares[b] + delta * delta * (n[a] * n[b] / both)
        mean[b] = mean[a] + delta * (n[b] / both)
        n[b] = both
        step *= 2
    return np.sqrt(np.divide(squares, n - 1, out=np.full(len(x), np.nan), where=n > 1))


def _before(key: np.ndarray, t: np.ndarray, of: np.ndarray, at: np.ndarray, too: bool) -> np.ndarray:
    """For every (of, at), the number of (key, t) before it, those equal to it ``too`` or not."""
    side = np.concatenate([np.zeros(len(t), np.int8), np.full(len(at), 1 if too else -1, np.int8)])
    order = np.lexsort((side, np.concatenate([t, at]), np.concatenate([key, of])))
    fact = order < len(t)
    out = np.empty(len(at), np.int64)
    out[order[~fact] - len(t)] = np.cumsum(fact)[~fact]
    return out


def _trailing(key: np.ndarray, t: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Sums of x[left:right], the facts from ``at - span`` to ``at``: of the first and the last bucket a part, the seven between whole."""
    bucket, own = t // (span // SPAN_BUCKETS), at // (span // SPAN_BUCKETS)
    begins = np.ones(len(t), bool)
    begins[1:] = (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])
    ends = np.append(begins[1:], True)
    upto, onward = running_sums(x, begins), running_sums(x[::-1], ends[::-1])[::-1]
    stretch, whole = np.cumsum(begins) - 1, upto[ends]
    out, some = np.zeros(len(at)), np.flatnonzero(right > left)
    if len(some):
        first, last, own = left[some], right[some] - 1, own[some]
        cut_first, cut_last = bucket[first] == own - SPAN_BUCKETS, bucket[last] == own
        low, high = stretch[first] + cut_first, stretch[last] - cut_last
        total = np.where(cut_first, onward[first], 0.0) + np.where(cut_last, upto[last], 0.0)
        for i in range(SPAN_BUCKETS - 1):
            total += np.where(low + i <= high, whole[np.minimum(low + i, len(whole) - 1)], 0.0)
        out[some] = total
    return out


def _statistics(legs: pa.Table, quantiles: dict[str, float], span: int) -> pa.RecordBatch:
    of = legs.column("k").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    created, ended = (legs.column(c).combine_chunks().fill_null(_NEVER).to_numpy() for c in ("created", "ended"))
    g = legs.column("g").combine_chunks()
    facts = np.flatnonzero(g.is_valid().to_numpy(zero_copy_only=False))
    facts = facts[np.lexsort((ended[facts], of[facts]))]
    x, t, key = g.to_numpy(zero_copy_only=False)[facts], ended[facts], of[facts]
    first, left, right = np.searchsorted(key, of), _before(key, t, of, created - span, False), _before(key, t, of, created, True)
    n, recent = right - first, right - left
    begins = np.ones(len(key), bool)
    begins[1:] = key[1:] != key[:-1]
    std = np.full(len(of), np.nan)
    std[n > 1] = running_deviations(x, begins)[right[n > 1] - 1]
    mean = _trailing(key, t, x, left, right, created, span) / np.maximum(recent, 1)
    # Quantiles are of values that are numbers.
    number = ~np.isnan(x)
    upto = np.concatenate([[0], np.cumsum(number)])
    first, right = upto[first], upto[right]
    found = [quantiles_of(x[number], first, right, right - first, 0, q) for q in quantiles.values()]
    columns = [pa.array(n), pa.array(std, mask=n < 2), pa.array(recent), pa.array(mean, mask=recent == 0), *[pa.array(q, mask=right == first) for q in found]]
    return pa.RecordBatch.from_arrays([legs.column("leg_id").combine_chunks(), *columns], names=["leg_id", "n", "std", "recent", "mean", *quantiles])


def dispersed(legs: DataFrame, quantiles: dict[str, float], span: int) -> DataFrame:
    """Per leg: number (n) and sample deviation (std) of its key's earlier gaps, number (recent) and mean of those at most ``span`` old, and
    one column per quantile.

    ``legs``: k, leg_id, trip_creation_time, od_end_time, gap_min, no key with more rows than a task may hold.
    """
    spark = legs.sparkSession
    importable(spark)
    d = legs.select(F.col("k").cast("string").alias("k"), "leg_id", micros("trip_creation_time").alias("created"), micros("od_end_time").alias("ended"), F.col("gap_min").cast("double").alias("g"))
    ddl = f"leg_id {d.schema['leg_id'].dataType.simpleString()}, n long, std double, recent long, mean double, " + ", ".join(f"{c} double" for c in quantiles)
    return d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k").mapInArrow(
        lambda batches: (_statistics(t, quantiles, span) for t in by_whole_keys(batches)), ddl
    )
