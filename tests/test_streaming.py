from __future__ import annotations

import datetime as dt
import random
from bisect import insort

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF
from pyspark.sql import functions as F

from tramline.plans import tables
from tramline.sources.adapters import legs_from_events
from tramline.streaming import events as E
from tramline.streaming import job as J
from tramline.streaming import scoring as S
from tramline.streaming import state
from tramline.streaming import value_tree as V


# ---- the values' tree -----------------------------------------------------------------------------------------------
class Store:
    """A map state that counts what is read and written."""

    def __init__(self):
        self.kept, self.reads, self.writes = {}, 0, 0

    def read(self, key):
        self.reads += 1
        return self.kept.get(key)

    def write(self, tree):
        for name in tree.changed:
            self.kept[name] = tree.node(name)
            self.writes += 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(allow_nan=False, allow_infinity=False), max_size=300), min_size=1, max_size=4))
def test_tree_selects_as_a_sorted_list(batches):
    store, seen = Store(), []
    for batch in batches:
        tree = V.ValueTree(store.read)
        for v in batch:
            tree.add(v)
            insort(seen, v)
        store.write(tree)
        fresh = V.ValueTree(store.read)
        assert [fresh.select(k) for k in range(len(seen))] == seen
    with pytest.raises(IndexError):
        V.ValueTree(store.read).select(len(seen))


def test_tree_of_ties_and_neighbours():
    rng = random.Random(1)
    values = [0.0, -0.0, 5.0, -5.0] * 2000 + [1 + k * 2.0**-50 for k in range(1000)] + [rng.gauss(0, 30) for _ in range(3000)]
    rng.shuffle(values)
    tree = V.ValueTree(lambda name: None)
    for v in values:
        tree.add(v)
    ordered = sorted(values)
    assert all(tree.select(k) == ordered[k] for k in range(0, len(values), 37))
    assert tree.quantile(0.5, len(values)) == pytest.approx((ordered[(len(values) - 1) // 2] + ordered[len(values) // 2]) / 2)
    assert max(len(n[1]) for n in tree._nodes.values()) <= V.LEAF


def test_work_per_batch_does_not_grow_with_history():
    rng, store, cost = random.Random(2), Store(), []
    for _ in range(60):
        store.reads = store.writes = 0
        tree = V.ValueTree(store.read)
        for k in range(500):
            tree.add(rng.gauss(50, 20))
        tree.quantile(0.5, 500)
        store.write(tree)
        cost.append(sum(len(c) + 2 * len(v) for c, v, _ in (store.kept[n] for n in tree.changed)))
    # Entries written by a batch of 500 values: 30 times the history, at most the nodes on 500 paths.
    assert cost[-1] < 500 * (V.LEAF * 2 + 3 * 256) and cost[-1] < 6 * max(cost[1:6])
    assert max(len(v) for _, v, _ in store.kept.values()) <= V.LEAF


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([k / 4 for k in range(-20, 40)]), max_size=60), st.lists(st.tuples(st.booleans(), st.floats(-9, 9)), min_size=1, max_size=80))
def test_quantiles_of_a_batch_as_one_by_one(stored, batch):
    """At once and path by path, over stored values and those of the batch so far."""
    facts, qs = [v for is_fact, v in batch if is_fact], [0.5, 0.9, 0.75, 0.25]
    before = np.array([sum(f for f, _ in batch[:i]) for i, (is_fact, _) in enumerate(batch) if not is_fact], np.int64)
    got = []
    for stored_a_row in (0, 10**6):
        tree = V.ValueTree(lambda name: None)
        for v in stored:
            tree.add(v)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(state, "STORED_A_ROW", stored_a_row if stored else 10**6)
            got.append(state._quantiles(tree, len(stored), np.array(facts, float), before, qs))
        assert [v for v, n in tree.stored() for _ in range(n)] == sorted(stored + facts)
    for a, b, q in zip(*got, qs, strict=True):
        want = [np.quantile(stored + facts[:p], q) if stored or p else np.nan for p in before.tolist()]
        np.testing.assert_allclose(a, want, atol=1e-9)
        np.testing.assert_array_equal(a, b)


def test_trailing_week_of_many_times():
    rng = random.Random(5)
    facts = [(rng.randrange(30 * 86_400_000_000), float(k % 7)) for k in range(2000)]
    one, many = state.Trailing(lambda b: None), state.Trailing(lambda b: None)
    for k in range(0, len(facts), 400):
        for t, g in facts[k : k + 400]:
            one.add(t, g)
        many.add_all(np.array([t for t, _ in facts[k : k + 400]]), np.array([g for _, g in facts[k : k + 400]]))
        at = [rng.randrange(40 * 86_400_000_000) for _ in range(200)] + [facts[k][0], facts[k][0] + state.WEEK]
        n, total = many.read_all(np.array(at))
        assert list(zip(n.tolist(), total.tolist(), strict=True)) == [one.read(t) for t in at]
    assert one.changed == many.changed and one.new == many.new


def test_replay_is_dealt_in_one_pass_to_equal_numbers_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "LEAST_ROWS", 20)
    events = E.build_events(legs_from_events(spark, SF).where("cast(leg_id as int) < 150"))
    assert J.write_replay(events, str(tmp_path / "in"), 3, 2) == 2
    files = sorted((tmp_path / "in").glob("*.json"), key=lambda f: f.stat().st_mtime_ns)
    spans = [[min(x), max(x)] for x in ([r["event_time"] for r in spark.read.schema(E.SCHEMA).json(str(f)).collect()] for f in files)]
    assert len(files) == 6 and all(max(spans[k][1], spans[k + 1][1]) < min(spans[k + 2][0], spans[k + 3][0]) for k in (0, 2))
    assert spark.read.schema(E.SCHEMA).json(str(tmp_path / "in")).count() == 300


def test_trailing_week_by_buckets():
    rng = random.Random(3)
    facts = sorted((rng.randrange(30 * 86_400_000_000), float(k)) for k in range(3000))
    week = state.Trailing(lambda b: None)
    seen = []
    for t, g in facts:
        week.add(t, g)
        seen.append((t, g))
        at = t + rng.randrange(86_400_000_000)
        want = [x for s, x in seen if at - state.WEEK <= s <= at]
        n, total = week.read(at)
        assert n == len(want) and total == pytest.approx(sum(want))


# ---- the stream -----------------------------------------------------------------------------------------------------
def replayed(spark, base, parts, legs=150):
    J.write_replay(E.build_events(legs_from_events(spark, SF).where(f"cast(leg_id as int) < {legs}")), base, parts)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_restart_equals_one_run(spark, tmp_path):
    out = []
    replayed(spark, str(tmp_path / "in"), 2)
    for name, runs in (("one", 1), ("two", 2)):
        base = str(tmp_path / name)
        for _ in range(runs):
            rows = J.histories(J.read_files(spark, str(tmp_path / "in"), 1))
            J.drain(rows, f"{base}/c", lambda d, i, base=base: J.write_batch(d, i, f"{base}/o"))
        out.append(rows_of(spark.read.parquet(f"{base}/o").where("row_kind = 'query'").drop("batch_id")))
    assert out[0] == out[1] and len(out[0]) == 150 * 5
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != J.ROCKSDB


def event(kind, leg, minute, gap=None):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    return (f"{kind}{leg}", kind, leg, at, "k", "s", "d", at.hour, 10.0, gap, gap and gap / 100, gap and 1.0)


def test_late_facts_are_applied_and_counted_and_old_buckets_go(spark, tmp_path):
    day = 24 * 60
    batches = [
        [event("fact", "a", 100, 1.0)],
        [event("fact", "b", 50, 3.0), event("query", "q1", 200)],  # a fact older than one already seen, within the watermark
        [event("fact", "c", 20 * day, 5.0)],
        [event("query", "q2", 20 * day + 10)],
        [event("query", "q3", 21 * day)],
    ]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, E.SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        rows = J.histories(J.read_files(spark, str(tmp_path / "in"), 1))
        J.drain(rows, str(tmp_path / "c"), lambda d, i: J.write_batch(d, i, str(tmp_path / "o")))
    got = spark.read.parquet(str(tmp_path / "o")).where("key_type = 'corridor'")
    q = {r["leg_id"]: r for r in got.where("row_kind = 'query'").collect()}
    assert (q["q1"]["n_prior"], q["q1"]["median_gap_min"], q["q1"]["n_prior_7d"]) == (2, 2.0, 2)
    assert (q["q2"]["n_prior"], q["q2"]["median_gap_min"], q["q2"]["n_prior_7d"], q["q2"]["mean_gap_7d"]) == (3, 3.0, 1, 5.0)
    totals = got.where("row_kind = 'summary'").agg(F.sum("facts").alias("f"), F.sum("late_facts").alias("l")).first()
    assert (totals["f"], totals["l"]) == (3, 1)
    # The watermark has passed the first week: timers have removed its buckets from the state.
    kept = spark.read.format("statestore").option("stateVarName", "recent").option("path", str(tmp_path / "c")).load()
    buckets = {r["bucket"] for r in kept.where("key.key_type = 'corridor'").select("user_map_key.bucket").collect()}
    micro = lambda m: int((dt.datetime(2024, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) + m * 60_000_000
    assert buckets == {micro(20 * day) // state.BUCKET}


def test_killed_batches_are_neither_lost_nor_doubled(spark, tmp_path):
    """The sink dies once after each of its writes, and once before booking; in the end all is as in one run."""

    class Dying(S.ScoringSink):
        left = ["history", "scored", "alerts", "ledger"]

        def _write(self, df, what, batch_id):
            if what == "ledger" and self.left == ["ledger"]:
                self.left.pop()
                raise RuntimeError("killed before booking")
            super()._write(df, what, batch_id)
            if self.left and self.left[0] == what and what != "ledger":
                self.left.pop(0)
                raise RuntimeError(f"killed after {what}")

    replayed(spark, str(tmp_path / "in"), 3)
    result = {}
    for name, sink in (("one", S.ScoringSink(str(tmp_path / "one"))), ("killed", Dying(str(tmp_path / "killed")))):
        deaths = 0
        while True:
            rows = J.histories(J.read_files(spark, str(tmp_path / "in"), 1))
            try:
                J.drain(rows, str(tmp_path / f"{name}-c"), sink)
                break
            except Exception as e:  # noqa: BLE001
                assert "killed" in str(e)
                deaths += 1
        booked = S.ledger(spark, str(tmp_path / name)).drop("seconds")
        result[name] = (rows_of(booked), *(rows_of(S.finished(spark, str(tmp_path / name), w).drop("batch_id")) for w in ("scored", "alerts")))
        assert deaths == (0 if name == "one" else 4)
    assert result["one"] == result["killed"]
    assert sum(r[1] for r in result["one"][0]) == 150 and sum(r[2] for r in result["one"][0]) == 150


def test_unbooked_batches_are_not_read(spark, tmp_path):
    path = str(tmp_path)
    for batch in (0, 1):
        spark.range(3).write.parquet(f"{path}/scored/batch_id={batch}")
    spark.createDataFrame([(3, 3, 0, 0, 0.1)], "queries long, facts long, late_facts long, alerts long, seconds double").write.parquet(f"{path}/ledger/batch_id=0")
    assert S.finished(spark, path, "scored").count() == 3


def test_json_leaves_out_nulls(spark):
    v = E.as_json(E.build_events(legs_from_events(spark, SF)).where("kind = 'query'").limit(1)).first()["value"]
    assert "gap_min" not in v and "event_id" in v


def test_events_keep_their_microseconds(spark, tmp_path):
    """A query 300 microseconds before a fact doesn't see it, though both lie in one millisecond."""
    at = dt.datetime(2024, 1, 1, 12)
    rows = [("q", "query", "q", at.replace(microsecond=5100), "k", "s", "d", 12, 10.0, None, None, None), ("f", "fact", "a", at.replace(microsecond=5400), "k", "s", "d", 12, 10.0, 1.0, 0.1, 1.0)]
    events = spark.createDataFrame(rows, E.SCHEMA)
    J.write_replay(events, str(tmp_path / "in"), 1)
    assert {r["event_time"] for r in spark.read.schema(E.SCHEMA).json(str(tmp_path / "in")).collect()} == {r[3] for r in rows}
    assert all(".0051" in r["value"] or ".0054" in r["value"] for r in E.as_json(events).collect())
    J.drain(J.histories(J.read_files(spark, str(tmp_path / "in"))), str(tmp_path / "c"), lambda d, i: J.write_batch(d, i, str(tmp_path / "o")))
    got = spark.read.parquet(str(tmp_path / "o")).where("row_kind = 'query' and key_type = 'corridor'")
    assert [r["n_prior"] for r in got.collect()] == [0]


def test_query_registered(spark):
    assert "stream_history" in tables.QUERIES
    assert E.violations(E.build_events(legs_from_events(spark, SF))).where(F.size("violations") > 0).count() == 0
