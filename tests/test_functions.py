from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.functions import tails
from tramline.functions.columns import wilson
from tramline.functions.rank import average_rank, global_rank
from tramline.operators import audit as A
from tramline.operators import statistics as S


def test_normal_tail():
    z = np.linspace(-6, 6, 49)
    want = [0.5 * math.erfc(x / math.sqrt(2)) for x in z]
    assert np.allclose(tails.normal_sf(z), want, rtol=1e-10, atol=1e-15)


def test_ln_gamma():
    x = np.array([0.5, 1, 2, 3.5, 10, 100, 1e4])
    assert np.allclose(tails.gammaln(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("t, dof, p", [(12.706, 1, 0.05), (2.228, 10, 0.05), (2.750, 30, 0.01), (0.0, 5, 1.0)])
def test_t_tail_by_table(spark, t, dof, p):
    got = spark.createDataFrame([(t, float(dof))], "t double, d double").select(tails.t_two_sided(F.col("t"), F.col("d"))).first()[0]
    assert abs(got - p) < 2e-5


def test_beta_symmetry():
    a, b, x = np.array([0.5, 2.0, 7.0]), np.array([3.0, 0.7, 7.0]), np.array([0.2, 0.9, 0.5])
    assert np.allclose(tails.betainc(a, b, x) + tails.betainc(b, a, 1 - x), 1)


def test_wilson_bounds(spark):
    d = spark.createDataFrame([(20, 20), (0, 20), (0, 0)], "x long, n long")
    low, high = wilson(F.col("x"), F.col("n"))
    got = [tuple(r) for r in d.select(low, high).collect()]
    assert got[0][1] == 1.0 and 0.83 < got[0][0] < 0.84
    assert got[1][0] == 0.0 and got[2] == (0.0, 0.0)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ranks_by_ranges(spark, parts):
    d = spark.range(200).select(((F.col("id") * 37) % 50).alias("v"), "id")
    got = {r["id"]: r["rank"] for r in global_rank(d, [F.col("v"), F.col("id")], partitions=parts).collect()}
    order = sorted(got, key=lambda i: ((i * 37) % 50, i))
    assert [got[i] for i in order] == list(range(1, 201))
    avg = {r["id"]: r["avg_rank"] for r in average_rank(d, "v", partitions=parts).collect()}
    assert avg[order[0]] == 2.5


def test_bh_by_holm(spark):
    p = [0.01, 0.04, 0.03, None, 0.5]
    d = spark.createDataFrame([(str(i), x) for i, x in enumerate(p)], "corridor_id string, p double")
    of = lambda k: {r["corridor_id"]: r["q_value"] for r in A.adjusted(d, "p", [], k).collect()}
    bh, by, holm = of("bh"), of("by"), of("holm")
    assert bh["0"] == pytest.approx(0.05) and bh["2"] == pytest.approx(0.2 / 3) and bh["3"] == 1
    assert by["0"] == pytest.approx(0.05 * (1 + 1 / 2 + 1 / 3 + 1 / 4 + 1 / 5))
    assert holm["0"] == pytest.approx(0.05) and holm["1"] == pytest.approx(0.12)


def test_permutation_finds_no_effect_in_noise_and_one_where_it_is(spark):
    rng = np.random.default_rng(0)
    rows = [(f"c{c}", f"s{s}", float(rng.normal() + (3 if c == 0 else 0))) for c in range(8) for s in range(12) for _ in range(2)]
    legs = spark.createDataFrame(rows, "corridor_id string, schedule string, log_gap_ratio double")
    got = {r["corridor_id"]: r["p_value"] for r in S.permutation_test(legs, 60, 3).collect()}
    assert got["c0"] < 0.05 and np.mean([v < 0.05 for k, v in got.items() if k != "c0"]) < 0.5
    chunks = {r["corridor_id"]: r["p_value"] for r in S.permutation_test(legs, 60, 3, chunk=25).collect()}
    assert got == chunks


def test_reml_agrees_with_a_search(spark):
    rng = np.random.default_rng(1)
    v = rng.uniform(0.1, 0.4, 80)
    y = rng.normal(1, np.sqrt(v + 0.5))
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, v, strict=True)], "y double, v double")

    def loss(t):
        w = 1 / (v + t)
        mu = (w * y).sum() / w.sum()
        return np.log(v + t).sum() + (w * (y - mu) ** 2).sum() + np.log(w.sum())

    grid = np.linspace(0, 3, 30001)
    best = grid[np.argmin([loss(t) for t in grid])]
    assert abs(S.tau2_reml(d) - best) < 2e-3
    assert abs(S.tau2_moments(d).first()["tau2"] - best) < 0.3


def test_wilcoxon_and_auc(spark):
    d = spark.createDataFrame([(float(x),) for x in range(-5, 16)], "d double")
    r = S.wilcoxon(d, "d").first()
    assert r["n"] == 20 and r["p_value"] < 0.05
    s = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)], "s double, y int")
    assert S.auc(s, "s", "y").first()["auc"] == 1.0


def test_hypergeometric_tail(spark):
    d = spark.createDataFrame([(2, 3, 4, 10)], "o int, a int, b int, n int")
    got = S.hypergeometric_tail(d, "o", "a", "b", "n").first()["p_overlap"]
    want = sum(math.comb(3, k) * math.comb(7, 4 - k) for k in (2, 3)) / math.comb(10, 4)
    assert got == pytest.approx(want)


def test_fleiss_kappa(spark):
    d = spark.createDataFrame([(i, x) for i, r in enumerate(["aab", "bbb", "aaa", "abb"]) for x in r], "subject int, label string")
    r = S.fleiss(d, "subject", "label").first()
    assert r["subjects"] == 4 and r["unanimous"] == 0.5 and r["kappa"] == pytest.approx((2 / 3 - 0.5) / 0.5)


def test_fisher_exact(spark):
    d = spark.createDataFrame([(3, 1, 1, 3), (8, 2, 1, 5)], "a int, b int, c int, d int")
    got = sorted(r["p_fisher"] for r in S.fisher(d, "a", "b", "c", "d").collect())
    assert got == pytest.approx([0.034965, 0.485714], abs=1e-5)


def test_permutations_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    size = [1, 1, 2, 2, 2, 5, 9, 11, 12, 30]
    rows = [(f"c{c}", f"s{s}", float(rng.normal() + (2 if c == 0 else 0))) for c in range(6) for s in range(len(size)) for _ in range(size[s])]
    legs = spark.createDataFrame(rows, "corridor_id string, schedule string, log_gap_ratio double")
    got = {r["corridor_id"]: r for r in S.permutation_blocks(legs, 2000, 3).collect()}
    # The same test from its definition, with other draws: two estimates of one probability.
    cell = {}
    for c, s, r in rows:
        cell.setdefault((c, s), []).append(r)
    keys, m = list(cell), np.array([len(v) for v in cell.values()])
    mean, owner = np.array([np.mean(v) for v in cell.values()]), np.array([k[0] for k in keys])

    def difference(means, c):
        own = owner == c
        return (m * means)[own].sum() / m[own].sum() - (m * means)[~own].sum() / m[~own].sum()

    hits = {f"c{c}": 0 for c in range(6)}
    for _ in range(2000):
        means = mean.copy()
        for low, high in [(k, k) for k in range(1, 9)] + [(9, 11), (12, 15), (16, 22), (23, 1 << 30)]:
            at = np.flatnonzero((m >= low) & (m <= high))
            means[at] = mean[rng.permutation(at)]
        for c in hits:
            hits[c] += abs(difference(means, c)) >= abs(difference(mean, c)) - 1e-12
    for c, n in hits.items():
        assert got[c]["observed"] == pytest.approx(difference(mean, c)) and abs(got[c]["p_value"] - (n + 1) / 2001) < 0.05
    again = {r["corridor_id"]: r["exceed"] for r in S.permutation_blocks(legs.repartition(5), 2000, 3, block=7).collect()}
    assert again == {c: r["exceed"] for c, r in got.items()}
    assert S.permutation_blocks(legs.where("false"), 10).count() == 0
    monkeypatch.setattr(S, "MOST_CELLS", 3)  # cells that are too many to send are permuted as rows
    assert {r["corridor_id"]: r["p_value"] for r in S.permutation_blocks(legs, 20, 3).collect()} == {
        r["corridor_id"]: r["p_value"] for r in S.permutation_test(legs, 20, 3).collect()
    }


def test_placebo_holds_its_size(spark):
    rng = np.random.default_rng(4)
    rows = [(f"c{c}", f"s{s}", float(rng.normal())) for c in range(20) for s in range(20) for _ in range(1)]
    legs = spark.createDataFrame(rows, "corridor_id string, schedule string, log_gap_ratio double")
    r = S.placebo_summary(S.placebo(legs, 40)).first()
    assert r["datasets"] == 40 and abs(r["rejection_rate"] - 0.05) < 0.03 and r["mean_discoveries"] < 0.5
    assert r["max_discoveries"] >= r["mean_discoveries"] and r["with_any"] <= 40


def test_headline_rule(spark):
    # By hand: every variant finds two slower ones; both permutation variants find no faster one, and BY is preferred.
    p = [("a", 1.4, 0.001, 0.001), ("b", 1.2, 0.012, 0.3), ("c", 0.8, 0.001, 0.04), ("d", 1.1, 0.9, 0.0005)]
    t = A.variants(spark.createDataFrame(p, "corridor_id string, excess_ratio double, p_welch double, p_perm double"))
    counts = {r["variant"]: (r["slower"], r["faster"]) for r in A.variant_counts(t).collect()}
    assert counts == {"by_perm": (2, 0), "bh_perm": (2, 0), "by_welch": (2, 1), "bh_welch": (2, 1)}
    got = {r["corridor_id"]: r for r in A.headline(t).collect()}
    assert {r["headline_variant"] for r in got.values()} == {"by_perm"}
    assert {k: r["status"] for k, r in got.items()} == {"a": "robust", "b": "fragile", "c": "fragile", "d": "headline_only"}
    assert got["c"]["q_by_perm"] == pytest.approx(0.04 * 4 * (1 + 1 / 2 + 1 / 3 + 1 / 4) / 3)


def test_severity_steps(spark):
    d = spark.createDataFrame([(1.2, "worse"), (1.21, "worse"), (1.5, "worse"), (2.5, "worse"), (2.51, "worse"), (0.6, "better"), (0.61, "better"), (0.9, "better"), (0.95, "better")], "e double, d string")
    got = [r[0] for r in d.select(A.severity(F.col("e"), F.col("d"))).collect()]
    assert got == ["mildly worse", "clearly worse", "clearly worse", "severe", "extreme", "extreme", "much better", "clearly better", "mildly better"]


def test_gain_bootstrap_has_the_multinomial_spread(spark):
    d = spark.createDataFrame([(300, 100, 200, 400)], "tp long, fp long, fn long, tn long")
    gain = np.array([r["gain"] for r in S.four_cell_bootstrap(d, 4000).collect()])
    rng = np.random.default_rng(1).multinomial(1000, [0.3, 0.1, 0.2, 0.4], 4000)
    want = rng[:, 0] / (rng[:, 0] + rng[:, 1]) - (rng[:, 0] + rng[:, 2]) / 1000
    assert abs(gain.mean() - want.mean()) < 0.002 and abs(gain.std() / want.std() - 1) < 0.06
