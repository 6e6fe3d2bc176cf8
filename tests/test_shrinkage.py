"""Empirical-Bayes fits against a direct search, rankings by hand, and dependence against plain sums."""

from __future__ import annotations

import math

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from tramline.operators import audit as A
from tramline.operators import dependence as D
from tramline.operators import shrinkage as S
from tramline.sources.adapters import legs_from_events


def loss(tau2, y, v, reml):
    w = 1 / (v + tau2)
    mu = (w * y).sum() / w.sum()
    return np.log(v + tau2).sum() + (w * (y - mu) ** 2).sum() + (np.log(w.sum()) if reml else 0.0)


def best(y, v, reml):
    low, high = 0.0, max(4 * y.var(), 1e-6)
    for _ in range(200):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a, y, v, reml) < loss(b, y, v, reml) else (a, high)
    return low if loss(low, y, v, reml) < loss(0.0, y, v, reml) else 0.0


def test_variances_of_many_families_at_once(spark):
    rng = np.random.default_rng(4)
    families = {"wide": (0.4, 60), "narrow": (0.02, 25), "none": (0.0, 40), "two": (0.3, 2)}
    data = {}
    rows = []
    for name, (tau, n) in families.items():
        v = rng.uniform(0.005, 0.08, n)
        y = rng.normal(0.2, np.sqrt(v + tau**2))
        data[name] = (y, v)
        rows += [(name, float(a), float(b)) for a, b in zip(y, v, strict=True)]
    got = {r["f"]: r for r in S.between_variances(spark.createDataFrame(rows, "f string, y double, v double"), ["f"]).collect()}
    for name, (y, v) in data.items():
        w = 1 / v
        mu = (w * y).sum() / w.sum()
        dl = max(0.0, ((w * (y - mu) ** 2).sum() - (len(y) - 1)) / (w.sum() - (w**2).sum() / w.sum()))
        assert got[name]["k"] == len(y) and got[name]["dl"] == pytest.approx(dl, abs=1e-9)
        assert got[name]["reml"] == pytest.approx(best(y, v, True), abs=1e-7)
        assert got[name]["ml"] == pytest.approx(best(y, v, False), abs=1e-7)
    equal = spark.createDataFrame([("e", 1.0, 0.1)] * 5, "f string, y double, v double")
    assert S.between_variances(equal, ["f"]).first()["reml"] == pytest.approx(0.0, abs=1e-12)


def test_posteriors(spark):
    d = spark.createDataFrame([("f", "a", 0.5, 0.01, 0.04, 0.4), ("f", "b", 0.1, 0.09, 0.04, 0.4)], "fit string, id string, y double, v double, tau2 double, threshold double")
    got = {r["id"]: r for r in S.posteriors(d, ["fit"]).collect()}
    w = [1 / 0.05, 1 / 0.13]
    mu = (w[0] * 0.5 + w[1] * 0.1) / sum(w)
    b = 0.01 / 0.05
    mean, sd = (1 - b) * 0.5 + b * mu, math.sqrt((1 - b) * 0.01 + b * b / sum(w))
    assert got["a"]["post_mean"] == pytest.approx(mean) and got["a"]["post_sd"] == pytest.approx(sd)
    assert got["a"]["p_exceed"] == pytest.approx(0.5 * math.erfc(-(mean - 0.4) / sd / math.sqrt(2)), abs=1e-6)
    assert got["a"]["lo90"] < mean < got["a"]["hi90"]


def test_design_effects(spark):
    legs = spark.createDataFrame([("k", "s")] * 6 + [("k", "t")] * 2 + [("m", "s")], "corridor_id string, schedule string")
    got = {r["corridor_id"]: (r["cells"], r["design_effect"]) for r in S.design_effects(legs, 0.1).collect()}
    assert got == {"k": (2, pytest.approx(1.3)), "m": (1, pytest.approx(1.0))}


def test_rankings_of_all_fits(spark):
    legs = legs_from_events(spark, SF)
    corridors, baseline = A.corridor_aggregate(legs), A.network_baseline(legs)
    ranks = S.floor_rankings(corridors, baseline, S.design_effects(legs)).cache()
    assert {r["fit"] for r in ranks.select("fit").distinct().collect()} == {f[0] for f in S.FITS}
    groups = ranks.groupBy("fit", "floor", "ranking").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b")).collect()
    assert groups and all(g["n"] == g["d"] == g["b"] and g["a"] == 1 for g in groups)
    assert {g["floor"] for g in groups} <= set(S.FLOORS)
    # Another threshold moves only the order by probability; the mean's order is that of the data.
    pos = {(r["fit"], r["ranking"], r["corridor_id"]): r["pos"] for r in ranks.where("floor = 5").collect()}
    y = {r["corridor_id"]: r["sum_log"] / r["n_legs"] for r in corridors.where("n_legs >= 5").collect()}
    order = [c for _, c in sorted((p, c) for (f, k, c), p in pos.items() if f == "reml" and k == "raw_mean")]
    assert all(y[a] >= y[b] - 1e-9 for a, b in zip(order[:-1], order[1:], strict=True))
    assert all(pos["reml", k, c] == pos["reml_2", k, c] for c in order for k in ("raw_mean", "eb_postmean"))
    # Only confirmed slower corridors may be published, and they come first.
    tested = A.audit_floors(legs, [5]).where("floor = 5").collect()
    slow = {r["corridor_id"] for r in tested if r["is_significant"] and r["direction"] == "worse"}
    first = {r["corridor_id"] for r in ranks.where("floor = 5 and fit = 'reml' and ranking = 'raw_published' and eligible").collect()}
    assert first <= slow and all(pos["reml", "raw_published", c] <= len(first) for c in first)


def test_pair_stability(spark):
    ranks = [("f", 10, "m", k, i + 1, True) for i, k in enumerate("abcd")] + [("f", 20, "m", k, i + 1, True) for i, k in enumerate("db")]
    ranks += [("f", 10, "p", k, i + 1, k == "a") for i, k in enumerate("abcd")] + [("f", 20, "p", k, i + 1, False) for i, k in enumerate("db")]
    d = spark.createDataFrame(ranks, "fit string, floor int, ranking string, corridor_id string, pos long, eligible boolean")
    got = {r["ranking"]: r for r in S.pair_stability(d, 2).collect()}
    assert (got["m"]["jaccard"], got["m"]["common_jaccard"], got["m"]["rho"], got["m"]["corridors"]) == (1 / 3, 1.0, -1.0, 2)
    assert got["p"]["jaccard"] == 0.0 and got["p"]["common_jaccard"] is None
    assert [tuple(r) for r in S.mean_jaccard(S.pair_stability(d.where("ranking = 'm'"), 2)).collect()] == [("f", "m", pytest.approx(1 / 3), 1)]


def anova(values, groups):
    """Intraclass correlation by its definition."""
    names = sorted(set(groups))
    of = {g: np.array([v for v, h in zip(values, groups, strict=True) if h == g]) for g in names}
    n, k, grand = len(values), len(names), np.mean(values)
    between = sum(len(x) * (x.mean() - grand) ** 2 for x in of.values()) / (k - 1)
    within = sum(((x - x.mean()) ** 2).sum() for x in of.values()) / (n - k)
    n0 = (n - sum(len(x) ** 2 for x in of.values()) / n) / (k - 1)
    return (between - within) / (between + (n0 - 1) * within), n0


def test_iccs_of_demeaned_values(spark):
    legs = legs_from_events(spark, SF)
    rows, corridors = D.tested_legs(legs, 5)
    got = {r["what"]: r for r in D.cluster_iccs(rows).collect()}
    local = rows.select("corridor_id", "schedule", "day", "trip_uuid", "log_gap_ratio", "res").collect()
    mean = {}
    for r in local:
        mean.setdefault(r["corridor_id"], []).append(r["log_gap_ratio"])
    assert all(len(x) >= 5 for x in mean.values()) and len(mean) == corridors.count()
    assert all(abs(r["res"] - (r["log_gap_ratio"] - np.mean(mean[r["corridor_id"]]))) < 1e-9 for r in local)
    keys = {"corridor": lambda r: r["corridor_id"], "day": lambda r: str(r["day"]), "trip": lambda r: r["trip_uuid"], "cell": lambda r: r["corridor_id"] + "|" + r["schedule"]}
    for what, key in keys.items():
        groups = [key(r) for r in local]
        values = [r["log_gap_ratio"] if what == "corridor" else r["res"] for r in local]
        if what in ("trip", "cell"):
            many = {g for g in set(groups) if groups.count(g) > 1}
            values, groups = [v for v, g in zip(values, groups, strict=True) if g in many], [g for g in groups if g in many]
        rho, n0 = anova(values, groups)
        assert got[what]["rho"] == pytest.approx(rho, abs=1e-9) and got[what]["n0"] == pytest.approx(n0)


def test_diagnostics_table(spark):
    legs = legs_from_events(spark, SF)
    got = {r["what"]: r for r in D.diagnostics(legs, 5).collect()}
    assert len(got) == 11
    n, effect, left = got["legs per corridor"], got["design effect of days"], got["effective legs under days"]
    assert n["least"] >= 5 and effect["least"] >= 1 and left["most"] <= n["most"] + 1e-9
    one = D.repeats(legs, 5).first()
    assert one["tested_legs"] <= one["n_legs"] == legs.count() and one["trip_design_effect"] >= 1
