"""Running quantiles of hot and small keys against sorted lists."""

from __future__ import annotations

import random
from bisect import insort

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tramline.operators import order_statistics as O

QUANTILES = {"p05": 0.05, "median": 0.5, "p90": 0.9, "most": 1.0}


@pytest.fixture(autouse=True)
def cut_keys(monkeypatch):
    """Cut keys from some rows on, so that small tables have hot keys."""
    monkeypatch.setattr(O, "WHOLE", 50)


def by_lists(rows):
    """One sorted list for each key, as the definition has it."""
    seen, out = {}, {}
    for k, _, kind, leg, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2], r[3])):
        mine = seen.setdefault(k, [])
        if kind == 0:
            if v is not None and v == v:
                insort(mine, v)
            continue
        n = len(mine)
        qs = []
        for q in QUANTILES.values():
            at = q * (n - 1)
            low = int(at)
            qs.append(mine[low] + (mine[min(low + 1, n - 1)] - mine[low]) * (at - low) if n else None)
        out[k, leg] = (n, *qs)
    return out


def found(spark, rows, partitions):
    df = spark.createDataFrame(rows, "k string, t long, kind int, leg_id string, v double")
    return {(r["k"], r["leg_id"]): tuple(r[2:]) for r in O.running_quantiles(df, "v", QUANTILES, partitions).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert got[key][0] == w[0] and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got[key][1:], w[1:], strict=True)), (key, got[key], w)


def made(rng, keys, n, value):
    rows = []
    for k in keys:
        for i in range(n if k == "hot" else n // 40):
            rows.append((k, rng.randrange(n // 2), rng.choice((0, 0, 1)), f"{k}-{i}", value(i)))
    return rows


@pytest.mark.parametrize("partitions", [1, 7, 23])
@pytest.mark.parametrize("shape", ["spread", "ties", "rising", "falling"])
def test_equal_to_sorted_lists(spark, partitions, shape):
    rng = random.Random(7)
    value = {"spread": lambda i: rng.gauss(0, 1), "ties": lambda i: float(rng.choice((0, 0, 0, 1, 5))), "rising": float, "falling": lambda i: -float(i)}[shape]
    rows = made(rng, ["hot", "a", "b", "z"], 1500, value)
    if shape in ("rising", "falling"):
        rows = [(k, int(leg.split("-")[1]), kind, leg, v) for k, _, kind, leg, v in rows]
    same(found(spark, rows, partitions), by_lists(rows))


@pytest.mark.parametrize(("whole", "together"), [(10**9, 40), (10**9, 10**6), (0, 40), (200, 100)])
def test_whole_and_cut_keys_agree(spark, monkeypatch, whole, together):
    monkeypatch.setattr(O, "WHOLE", whole)
    monkeypatch.setattr(O, "TOGETHER", together)
    rows = made(random.Random(9), ["hot", "a", "b", "c", "d"], 1200, lambda i: float(i * 31 % 101))
    same(found(spark, rows, 5), by_lists(rows))


def test_many_bounds_are_searched_alike(spark, monkeypatch):
    monkeypatch.setattr(O, "FEW_BOUNDS", 0)
    rows = made(random.Random(8), ["hot", "a"], 900, lambda i: float(i % 97))
    same(found(spark, rows, 6), by_lists(rows))


def test_nulls_empty_and_keys_without_facts(spark):
    rows = [(None, 1, 0, "a", 2.0), (None, 2, 1, "b", None), ("k", 1, 1, "c", None), ("k", 1, 0, "d", None), ("k", 2, 0, "e", float("nan")), ("k", 3, 1, "f", None)]
    same(found(spark, rows, 3), by_lists(rows))
    assert found(spark, rows[:1], 3) == {} and found(spark, [], 3) == {}
    hot = [(None, i, i % 2, str(i), float(i % 7)) for i in range(300)]
    same(found(spark, hot, 6), by_lists(hot))


def test_one_key_is_cut_into_many_ranges(spark):
    """No task holds the key: its rows lie in as many pieces as there are ranges, and bands stay near twice a piece's facts."""
    n, parts = 8000, 16
    rows = spark.range(n).select(F.lit("all").alias("k"), F.col("id").alias("t"), (F.col("id") % 2).cast("int").alias("kind"), F.col("id").cast("string").alias("leg_id"), F.when(F.col("id") % 2 == 0, F.rand(3)).alias("v"))
    ranged = rows.repartitionByRange(parts, "k", "t", "kind", "leg_id").withColumn("part", F.spark_partition_id()).cache()
    cut = O.pieces(ranged).cache()
    sizes = [r["m"] for r in cut.collect()]
    assert len(sizes) == parts and max(sizes) < 3 * n / 2 / parts
    bands = O._bands(ranged, cut, [0.5], parts).where("v is not null").groupBy("part").agg(F.sum("c").alias("c")).collect()
    assert len(bands) == parts - 1 and max(r["c"] for r in bands) < 6 * max(sizes)
    plan = O.running_quantiles(rows, "v", {"median": 0.5}, parts)._jdf.queryExecution().executedPlan().toString()
    # Rows are dealt by range; only (range, key) pairs with counts are dealt by key.
    assert "LeftAnti" in plan and "LeftSemi" not in plan.split("LeftAnti")[0] and "hashpartitioning(part" in plan


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.data())
def test_selection_in_any_stretch(values, data):
    v = np.array(values, float)
    left = data.draw(st.integers(0, len(v) - 1))
    right = data.draw(st.integers(left + 1, len(v)))
    k = np.arange(right - left)
    assert O.selected(v, np.full(len(k), left), np.full(len(k), right), k).tolist() == sorted(values[left:right])
