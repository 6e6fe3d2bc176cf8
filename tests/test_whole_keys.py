from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from tramline.operators import history as H
from tramline.operators import order_statistics as S
from tramline.operators import whole_keys as W
from tramline.sources import shared as R
from tramline.sources.adapters import legs_from_events, legs_from_orders

DAY = 86_400_000_000


def quantile(values, q):
    at = q * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def plain(rows, days):
    """By the definition: (median, p90, range, deviation, recent mean, recent number) of each leg."""
    out = {}
    for i, k, created, _, _ in rows:
        known = [(e, g) for _, k2, _, e, g in rows if k2 == k and e <= created and g is not None]
        v = sorted(g for _, g in known)
        recent = [g for e, g in known if e >= created - days * DAY]
        q = [quantile(v, x) if v else None for x in (0.5, 0.9, 0.75, 0.25)]
        out[i] = (q[0], q[1], q[2] - q[3] if v else None, statistics.stdev(v) if len(v) > 1 else None, math.fsum(recent) / len(recent) if recent else None, len(recent))
    return out


def legs(spark, rows):
    at = lambda c: F.expr(f"cast(timestamp_micros({c}) as timestamp_ntz)")
    d = spark.createDataFrame(rows, "leg_id string, corridor_id string, a long, b long, gap_min double")
    return d.select("leg_id", "corridor_id", at("a").alias("trip_creation_time"), at("b").alias("od_end_time"), "gap_min")


def random_legs(rng, n):
    rows = []
    for i in range(n):
        created = rng.randrange(40) * DAY // 2 + rng.choice([0, 0, rng.randrange(DAY)])
        gap = rng.choice([None, 7.0, 1e9 + rng.random(), rng.gauss(0, 1), float(rng.randrange(5))])
        rows.append((str(i), rng.choice(["k", "k", "m", None, "z|1"]), created, created + rng.choice([0, DAY, 7 * DAY, rng.randrange(9 * DAY)]), gap))
    return rows


@pytest.mark.parametrize("whole", [S.WHOLE, 100, 0])
def test_dispersion_by_its_definition(spark, monkeypatch, whole):
    """Ties, nulls, large offsets and facts at the ends of the span; with keys whole, with some cut, and with all cut."""
    monkeypatch.setattr(S, "WHOLE", whole)
    monkeypatch.setattr(S, "TOGETHER", 50)
    rows = random_legs(random.Random(5), 300)
    got = {r["leg_id"]: tuple(r)[1:] for r in H.dispersion(legs(spark, rows)).collect()}
    want = plain(rows, 7)
    assert got.keys() == want.keys()
    for i in want:
        assert [x is None for x in got[i]] == [x is None for x in want[i]], i
        assert [x or 0 for x in got[i]] == pytest.approx([x or 0 for x in want[i]], rel=1e-9, abs=1e-5), i


def test_dispersion_is_one_exchange_over_legs_written_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(H, "written", lambda df, name, real=H.written, **lean: names.append((name, lean)) or real(df, name, **lean))
    for made in (legs_from_events, legs_from_orders):
        p = H.dispersion(made(spark, SF))._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in p and p.count("Exchange") == 1 and "Window" not in p
    assert names == [("legs", {"lean": True}), ("hot", {})] * 2


def test_lean_rows_leave_the_session_as_it_was(spark):
    before = spark.conf.get(R._CLEANUP)
    d = R.written(spark.range(1000).repartition(3).withColumn("s", F.lit("x")), "lean", lean=True)
    assert spark.conf.get(R._CLEANUP) == before and d.count() == 1000 and d.select(F.sum("id")).first()[0] == 499500
    assert all(f.endswith(".zstd.parquet") for f in d.inputFiles())


def test_running_statistics_keep_their_digits():
    rng = np.random.default_rng(3)
    begins = np.zeros(500, bool)
    begins[[0, 1, 2, 40, 300]] = True
    x = np.where(np.arange(500) % 100 < 50, 1e-3 * rng.random(500), 1e9 + rng.random(500))
    sums, deviations = W.running_sums(x, begins), W.running_deviations(x, begins)
    first = np.maximum.accumulate(np.where(begins, np.arange(500), 0))
    for i in range(500):
        own = x[first[i] : i + 1].tolist()
        assert sums[i] == pytest.approx(math.fsum(own), rel=1e-13)
        assert math.isnan(deviations[i]) if len(own) == 1 else deviations[i] == pytest.approx(statistics.stdev(own), rel=1e-9)
    assert np.isnan(W.running_sums(np.array([1.0, np.nan, 1.0]), np.array([True, False, True]))).tolist() == [False, True, False]


def test_legs_without_gaps_or_facts(spark):
    d = legs(spark, [("a", "k", 0, DAY, None), ("b", "k", 2 * DAY, 3 * DAY, float("nan")), ("c", "k", 4 * DAY, 5 * DAY, 2.0), ("d", "k", 6 * DAY, 7 * DAY, 1.0)])
    got = {r["leg_id"]: tuple(r)[1:] for r in H.dispersion(d).collect()}
    assert got["a"] == got["b"] == (None, None, None, None, None, 0)
    assert got["c"][:4] == (None,) * 4 and math.isnan(got["c"][4]) and got["c"][5] == 1
    assert got["d"][:3] == (2.0, 2.0, 0.0) and math.isnan(got["d"][3]) and math.isnan(got["d"][4]) and got["d"][5] == 2
    assert H.dispersion(d.where("false")).count() == 0
