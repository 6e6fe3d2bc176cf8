"""Stateful as-of history in Structured Streaming: facts update a key's state, queries read it at their own time.

The state of a key is bounded in what a batch touches: totals in one value; all gaps in a tree of small nodes (a map state), of which
a batch reads and writes those on the paths of its own values; the trailing week in buckets of time (a map state), which
event-time timers remove.  Nothing is rewritten because it is old.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tramline.session import importable

from .value_tree import NODE, Growing, ValueTree

OUTPUT = (
    "row_kind string, key_type string, key string, leg_id string, t long, corridor_id string, planned_min double, n_prior int, mean_log_ratio double, "
    "std_log_ratio double, mean_gap_min double, last_log_ratio double, hours_since_last double, median_gap_min double, p90_gap_min double, "
    "iqr_gap_min double, sd_gap_min double, mean_gap_7d double, n_prior_7d int, mean_dwell_min double, facts int, late_facts int"
)
TOTALS = (
    "n long, s double, ss double, g double, d double, last_s double, last_t long, m_mean double, m_squares double, newest long, late long"
)
RECENT = "n long, total double, t array<long>, g array<double>"
WEEK = 7 * 86_400_000_000
#: Microseconds of a bucket of the trailing week: a query reads 29 of them, two row by row.
BUCKET = 6 * 3_600_000_000
#: Key type with dispersion: quantiles, deviation and trailing week.
WITH_DISPERSION = "corridor"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
_TYPES = {c.split()[0]: {"long": "int64", "int": "Int32", "double": "float64"}[c.split()[1]] for c in OUTPUT.split(", ") if c.split()[1] != "string"}


class Trailing:
    """Facts of the last week by bucket of time, read from and written to a map state as far as touched."""

    def __init__(self, read):
        self._read, self._buckets, self.changed, self.new = read, {}, set(), set()

    def _bucket(self, b: int) -> list | None:
        if b not in self._buckets:
            stored = self._read(b)
            self._buckets[b] = [stored[0], stored[1], list(stored[2]), list(stored[3])] if stored else None
        return self._buckets[b]

    def bucket(self, b: int) -> tuple:
        return tuple(self._buckets[b])

    def add(self, t: int, g: float) -> None:
        b = t // BUCKET
        if self._bucket(b) is None:
            self._buckets[b] = [0, 0.0, [], []]
            self.new.add(b)
        own = self._buckets[b]
        own[0] += 1
        own[1] += g
        own[2].append(t)
        own[3].append(g)
        self.changed.add(b)

    def read(self, t: int) -> tuple[int, float]:
        """Number and sum of the facts from a week before t to t."""
        n, total = 0, 0.0
        first, last = (t - WEEK) // BUCKET, t // BUCKET
        for b in range(first, last + 1):
            own = self._bucket(b)
            if own is None:
                continue
            if first < b < last:
                n, total = n + own[0], total + own[1]
                continue
            for when, g in zip(own[2], own[3], strict=True):
                if t - WEEK <= when <= t:
                    n, total = n + 1, total + g
        return n, total

    def add_all(self, t: np.ndarray, g: np.ndarray) -> None:
        buckets = t // BUCKET
        for b in np.unique(buckets).tolist():
            own, here = self._bucket(b), buckets == b
            if own is None:
                own = self._buckets[b] = [0, 0.0, [], []]
                self.new.add(b)
            own[0] += int(here.sum())
            own[1] = float(np.cumsum(np.concatenate([[own[1]], g[here]]))[-1])
            own[2].extend(t[here].tolist())
            own[3].extend(g[here].tolist())
            self.changed.add(b)

    def read_all(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``read`` of many times: a bucket's facts are sorted and summed from both ends once, not gone through for every time."""
        n, total, buckets, sides = np.zeros(len(t), np.int64), np.zeros(len(t)), t // BUCKET, {}

        def side(b: int) -> tuple | None:
            if b not in sides:
                own = self._bucket(b)
                if own is None:
                    sides[b] = None
                else:
                    when, g = np.array(own[2], np.int64), np.array(own[3])
                    order = np.argsort(when, kind="stable")
                    sides[b] = when[order], np.concatenate([[0.0], np.cumsum(g[order])]), np.concatenate([np.cumsum(g[order][::-1])[::-1], [0.0]])
            return sides[b]

        for b in np.unique(buckets).tolist():
            here = buckets == b
            between = [own for own in map(self._bucket, range(b + 1 - WEEK // BUCKET, b)) if own]
            n[here], total[here] = sum(own[0] for own in between), sum(own[1] for own in between)
            if (first := side(b - WEEK // BUCKET)) is not None:
                at = np.searchsorted(first[0], t[here] - WEEK, "left")
                n[here] += len(first[0]) - at
                total[here] += first[2][at]
            if (last := side(b)) is not None:
                at = np.searchsorted(last[0], t[here], "right")
                n[here] += at
                total[here] += last[1][at]
        return n, total


#: All quantiles of a batch are found at once if there are at most so many stored facts for each of its rows, else path by path.
STORED_A_ROW = 32


def _quantiles(tree: ValueTree, n: int, gaps: np.ndarray, before: np.ndarray, qs: list[float]) -> list[np.ndarray]:
    """Quantiles at each query of a batch, which sees n stored facts and the first ``before`` of the batch's; adds these to the tree."""
    out = [np.full(len(before), np.nan) for _ in qs]
    seen = np.flatnonzero(n + before > 0)
    if n <= STORED_A_ROW * (len(gaps) + len(before)):
        pairs = list(tree.stored()) if len(seen) else []
        if len(seen):
            grown = Growing(np.array([v for v, _ in pairs], float), np.array([m for _, m in pairs], np.int64), gaps)
            for at in range(0, len(seen), 100_000):
                some = seen[at : at + 100_000]
                for o, q in zip(out, qs, strict=True):
                    o[some] = grown.quantile(q, before[some], n + before[some])
        for v, m in zip(*(x.tolist() for x in np.unique(gaps, return_counts=True)), strict=True):
            tree.add(v, m)
        return out
    added = 0
    for i, p in enumerate(before.tolist()):
        for v in gaps[added:p].tolist():
            tree.add(v)
        added = p
        for o, q in zip(out, qs, strict=True):
            o[i] = tree.quantile(q, n + p)
    for v in gaps[added:].tolist():
        tree.add(v)
    return out


class History(StatefulProcessor):
    """Events of one key in (time, facts first, leg) order within a batch.

    A fact older than an event already seen is applied and counted as late; rows older than the watermark are dropped by Spark,
    which counts them in the query's progress.  One row per query, and one per key and batch with facts applied.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)
        self.values = handle.getMapState("values", "node string", NODE)
        self.recent = handle.getMapState("recent", "bucket long", RECENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, s, ss, g, d, last_s, last_t, m_mean, m_squares, newest, late = self.totals.get() if self.totals.exists() else (0, 0.0, 0.0, 0.0, 0.0, None, None, 0.0, 0.0, None, 0)
        tree = ValueTree(lambda node: self.values.getValue((node,)))
        week = Trailing(lambda b: self.recent.getValue((b,)))
        batch = pd.concat(list(rows), ignore_index=True)
        batch["order"] = (batch["kind"] != "fact").astype(int)
        batch = batch.sort_values(["t", "order", "leg_id"], kind="stable")
        is_fact, t = (batch["order"] == 0).to_numpy(), batch["t"].to_numpy("int64")
        asked, fact_t, t = batch[~is_fact], t[is_fact], t[~is_fact]
        log, gap, dwell = (batch[c].to_numpy("float64")[is_fact] for c in ("log_gap_ratio", "gap_min", "dwell_min"))
        facts = len(fact_t)
        before = np.cumsum(is_fact)[~is_fact]  # the batch's facts that a query sees
        # Sums go on from the stored ones, fact by fact.
        upto = lambda start, x: np.cumsum(np.concatenate([[start], x]))
        sums, squares, gaps, dwells = upto(s, log), upto(ss, log * log), upto(g, gap), upto(d, dwell)
        # The batch is in order, so only the stored times make a fact late or not the last.
        latest = np.arange(facts) if last_t is None else np.where(fact_t >= last_t, np.arange(facts), -1)
        latest = np.maximum.accumulate(np.concatenate([[-1], latest]))
        late_now = int((fact_t < newest).sum()) if newest is not None else 0
        newest = max(int(x) for x in ([newest] if newest is not None else []) + [y[-1] for y in (fact_t, t) if len(y)])
        known = n + before
        some = lambda x, least=1: np.where(known >= least, x, np.nan)
        of_last = lambda new, old: np.where(latest[before] >= 0, new[latest[before]] if facts else 0, np.nan if old is None else old)
        since = np.where(latest[before] >= 0, t - (fact_t[latest[before]] if facts else 0), np.nan if last_t is None else t - (last_t or 0))
        with np.errstate(all="ignore"):
            mean = some(sums[before] / known)
            out = {
                "n_prior": known, "mean_log_ratio": mean, "std_log_ratio": some(np.sqrt(np.maximum(0.0, squares[before] / known - mean * mean)), 2),
                "mean_gap_min": some(gaps[before] / known), "last_log_ratio": of_last(log, last_s), "hours_since_last": since / 3.6e9,
                "mean_dwell_min": some(dwells[before] / known),
            }
            if key[0] == WITH_DISPERSION:
                spread = [m_squares]
                for i, x in enumerate(gap.tolist(), n + 1):
                    delta = x - m_mean
                    m_mean += delta / i
                    m_squares += delta * (x - m_mean)
                    spread.append(m_squares)
                median, p90, p75, p25 = _quantiles(tree, n, gap, before, [0.5, 0.9, 0.75, 0.25])
                # A query sees the facts up to its own time, which don't depend on the batch's order.
                week.add_all(fact_t, gap)
                n7, sum7 = week.read_all(t)
                out |= {
                    "median_gap_min": median, "p90_gap_min": p90, "iqr_gap_min": p75 - p25, "sd_gap_min": some(np.sqrt(np.array(spread)[before] / (known - 1)), 2),
                    "mean_gap_7d": np.where(n7 > 0, sum7 / n7, np.nan), "n_prior_7d": n7,
                }
        if facts and latest[-1] >= 0:
            last_s, last_t = float(log[latest[-1]]), int(fact_t[latest[-1]])
        n, late = n + facts, late + late_now
        s, ss, g, d = (float(x[-1]) for x in (sums, squares, gaps, dwells))
        self.totals.update((n, s, ss, g, d, last_s, last_t, m_mean, m_squares, newest, int(late)))
        for node in tree.changed:
            self.values.updateValue((node,), tree.node(node))
        for b in week.changed:
            self.recent.updateValue((b,), week.bucket(b))
        for b in week.new:
            # No query at or after the watermark reaches a bucket once it lies a week behind.
            self.handle.registerTimer(max(((b + 1) * BUCKET + WEEK) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        if len(asked):
            named = {"row_kind": "query", "key_type": key[0], "key": key[1], "leg_id": asked["leg_id"].to_numpy(), "t": t, "corridor_id": asked["corridor_id"].to_numpy(), "planned_min": asked["planned_min"].to_numpy("float64")}
            yield pd.DataFrame(named | out, columns=_COLUMNS, index=range(len(asked))).astype(_TYPES)
        yield pd.DataFrame([("summary", *key, None, newest, *[None] * 15, facts, late_now)], columns=_COLUMNS).astype(_TYPES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = expiredTimerInfo.getExpiryTimeInMs() * 1000 - WEEK
        for (b,) in [k for k in self.recent.keys() if (k[0] + 1) * BUCKET <= past]:
            self.recent.removeKey((b,))
        return iter([])


def history_stream(keyed: DataFrame) -> DataFrame:
    """Keyed events (with a watermark) to one row per query and key and one per key and batch; state per (key_type, key).

    Needs the RocksDB state store; ``job.drain`` and ``job.run_continuously`` name it for their queries.
    """
    importable(keyed.sparkSession)
    return keyed.groupBy("key_type", "key").transformWithStateInPandas(History(), OUTPUT, "append", "EventTime")
