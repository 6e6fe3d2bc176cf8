"""Queries on statistical operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions.columns import draw
from tramline.operators import audit as A
from tramline.operators import statistics as S
from tramline.sources.adapters import legs_from_events, legs_from_orders, table
from tramline.sources.shared import written

from .history import _rounded
from .network import _AGG
from .sql import legs, trips


def icc_schedule(spark, sf_dir):
    return _rounded(S.icc(legs_from_orders(spark, sf_dir), "log_gap_ratio", "schedule"), 7)


def icc_by_corridor(spark, sf_dir):
    return _rounded(S.icc(legs_from_events(spark, sf_dir), "log_gap_ratio", "schedule", ["corridor_id"]), 5)


def permutation_cells(spark, sf_dir):
    return _rounded(S.cells(legs_from_orders(spark, sf_dir)))


#: Repetitions of permutation tests and bootstraps, and placebo data sets.
PERMUTATIONS, RESAMPLES, PLACEBOS = 100_000, 10_000, 200


def permutation_test(spark, sf_dir):
    return _rounded(S.permutation_blocks(legs_from_events(spark, sf_dir), PERMUTATIONS, 7))


def permutation_by_hash(spark, sf_dir):
    """The same test as rows, with draws that SQL can repeat; 20 repetitions check the arithmetic, not a corridor."""
    return _rounded(S.permutation_test(legs_from_events(spark, sf_dir), 20, 7))


def placebo_calibration(spark, sf_dir):
    return _rounded(S.placebo(legs_from_events(spark, sf_dir), PLACEBOS))


def audit_variants(spark, sf_dir):
    """The audit by Welch and by permutation, corrected by BH and BY, with the headline variant and each corridor's status."""
    rows = legs_from_orders(spark, sf_dir)
    tested = A.welch(A.corridor_aggregate(rows), A.network_baseline(rows)).select("corridor_id", "n_legs", "excess_ratio", F.col("p_value").alias("p_welch"))
    p = S.permutation_blocks(rows, RESAMPLES, 29).select("corridor_id", F.col("p_value").alias("p_perm"))
    return _rounded(A.headline(A.variants(tested.join(p, "corridor_id").where("n_legs >= 10"))))


def _yv(spark, sf_dir):
    c = A.corridor_aggregate(legs_from_orders(spark, sf_dir)).where("n_legs >= 10")
    n, y = F.col("n_legs"), F.col("sum_log") / F.col("n_legs")
    return c.select("corridor_id", "n_legs", y.alias("y"), ((F.col("sumsq_log") - n * y * y) / (n - 1) / n).alias("v"))


def eb_tau2(spark, sf_dir):
    return _rounded(S.tau2_moments(_yv(spark, sf_dir)), 7)


def eb_posterior(spark, sf_dir):
    return _rounded(S.posterior(_yv(spark, sf_dir), F.lit(0.01), 0.1, with_p=False).select("corridor_id", "mu", "shrink", "post_mean", "post_sd", "lo90", "hi90", "z"))


def eb_reml(spark, sf_dir):
    yv = written(_yv(spark, sf_dir), "yv")  # every round of the search reads it
    tau2 = S.tau2_reml(yv)
    return S.posterior(yv, F.lit(tau2), 0.1).select("corridor_id", F.lit(tau2).alias("tau2"), "post_mean", "p_exceed")


def eb_support_bins(spark, sf_dir):
    return _rounded(S.support_bins(_yv(spark, sf_dir), "n_legs", "y"))


def spearman_support(spark, sf_dir):
    return _rounded(S.spearman(_yv(spark, sf_dir), "n_legs", "y"))


def bootstrap_groups(spark, sf_dir):
    rows = legs_from_events(spark, sf_dir)
    return _rounded(S.group_bootstrap(rows, "schedule", "leg_id", "gap_min", 5))


def bootstrap_paired(spark, sf_dir):
    d = legs_from_events(spark, sf_dir).select("leg_id", (F.abs("gap_min") - 40).alias("d"))
    return _rounded(S.bootstrap_summary(S.paired_bootstrap(d, "leg_id", "d", 50)))


def bootstrap_blocks(spark, sf_dir):
    d = legs_from_events(spark, sf_dir).select(F.col("trip_creation_time").cast("date").cast("string").alias("day"), F.col("gap_min"))
    return _rounded(S.block_bootstrap(d, "day", "gap_min", RESAMPLES))


def bootstrap_blocks_summary(spark, sf_dir):
    return _rounded(S.bootstrap_summary(bootstrap_blocks(spark, sf_dir)))


def _four(spark, sf_dir):
    late, flag = F.col("is_delayed"), F.col("planned_min") < 40
    return legs_from_events(spark, sf_dir).agg(F.count_if(flag & late).alias("tp"), F.count_if(flag & ~late).alias("fp"), F.count_if(~flag & late).alias("fn"), F.count_if(~flag & ~late).alias("tn"))


def bootstrap_gain(spark, sf_dir):
    return _rounded(S.four_cell_bootstrap(_four(spark, sf_dir), RESAMPLES))


def wilcoxon_signed_rank(spark, sf_dir):
    return _rounded(S.wilcoxon(legs_from_events(spark, sf_dir), "gap_min", with_p=False))


def diebold_mariano(spark, sf_dir):
    return _rounded(S.long_run_variance(legs_from_events(spark, sf_dir), [F.col("trip_creation_time"), F.col("leg_id")], "gap_min", 5))


def trend_by_weekday(spark, sf_dir):
    t = legs_from_events(spark, sf_dir).groupBy(F.dayofweek("trip_creation_time").alias("s")).agg(F.count_if("is_delayed").alias("x"), F.count("*").alias("n"))
    return _rounded(S.trend(t, "s", "x", "n"))


def two_proportions(spark, sf_dir):
    return _rounded(S.two_proportions(_four(spark, sf_dir).select("tp", (F.col("tp") + F.col("fp")).alias("n1"), "fn", (F.col("fn") + F.col("tn")).alias("n2")), "tp", "n1", "fn", "n2"))


def agreement_fleiss(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("subject"), F.when(F.col("value") > 30, "a").otherwise("b").alias("label"))
    return _rounded(S.fleiss(e, "subject", "label"))


def agreement_cohen(spark, sf_dir):
    return _rounded(S.cohen(table(spark, sf_dir, "labels"), "quality", "toxic"))


def score_auc(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return _rounded(S.auc(d, "n_chars", "quality"))


def proportions_wilson(spark, sf_dir):
    return _rounded(S.proportions(legs_from_orders(spark, sf_dir), ["source_center"], F.col("is_delayed")))


def proportions_better(spark, sf_dir):
    return S.better(S.proportions(legs_from_orders(spark, sf_dir), ["source_center"], F.col("is_delayed")), "source_center")


def _parts(spark, sf_dir):
    p = S.calendar_parts(legs_from_orders(spark, sf_dir), 3)
    c = p.groupBy("part", "corridor_id").agg(F.count("*").alias("n"), F.avg("log_gap_ratio").alias("m"))
    return c.where("n >= 3").select("part", "corridor_id", (F.col("m") > 0.9).alias("slow"))


def stability_parts(spark, sf_dir):
    return _rounded(S.part_overlap(_parts(spark, sf_dir)))


def stability_chance(spark, sf_dir):
    t = S.part_overlap(_parts(spark, sf_dir)).select("a", "b", "both", "slow_a", "slow_b", "common")
    return _rounded(S.hypergeometric_tail(t, "both", "slow_a", "slow_b", "common"))


def hash_draws(spark, sf_dir):
    return legs_from_orders(spark, sf_dir).select("leg_id", draw(5, 0, F.col("leg_id")).alias("u"))


QUERIES = {f.__name__: f for f in (
    icc_schedule, icc_by_corridor, permutation_cells, permutation_test, permutation_by_hash, placebo_calibration, audit_variants, eb_tau2, eb_posterior, eb_reml, eb_support_bins,
    spearman_support, bootstrap_groups, bootstrap_paired, bootstrap_blocks, bootstrap_blocks_summary, bootstrap_gain,
    wilcoxon_signed_rank, diebold_mariano, trend_by_weekday, two_proportions, agreement_fleiss, agreement_cohen, score_auc,
    proportions_wilson, proportions_better, stability_parts, stability_chance, hash_draws,
)}


def _icc(by: str, digits: int) -> str:
    g, sel = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"""g AS (SELECT {sel}schedule, count(*) AS n, sum(log_gap_ratio) AS s, sum(log_gap_ratio ** 2) AS ss FROM legs GROUP BY ALL),
      t AS (SELECT {sel}count(*) AS groups, sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b, sum(n * n) AS n2 FROM g {g}),
      u AS (SELECT *, (b - s * s / n) / nullif(groups - 1, 0) AS msb, (ss - b) / nullif(n - groups, 0) AS msw, (n - n2 / n) / nullif(groups - 1, 0) AS n0 FROM t),
      v AS (SELECT *, (msb - msw) / nullif(msb + (n0 - 1) * msw, 0) AS rho FROM u)
      SELECT {sel}groups, CAST(n AS BIGINT) AS n, round(n0, {digits}) AS n0, round(rho, {digits}) AS rho, round(1 + (n2 / n - 1) * CASE WHEN rho > 0 THEN rho ELSE 0 END, {digits}) AS design_effect, round(n / (1 + (n2 / n - 1) * CASE WHEN rho > 0 THEN rho ELSE 0 END), {digits}) AS effective_n FROM v"""


_D = lambda *p: "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(p) + ")), 1, 8) AS BIGINT)"
_CELLS = """cell AS (SELECT corridor_id, schedule, count(*) AS m, avg(log_gap_ratio) AS ybar, var_pop(log_gap_ratio) * count(*) AS ss_dev, CAST(CASE WHEN count(*) >= 23 THEN 11 WHEN count(*) >= 16 THEN 10 WHEN count(*) >= 12 THEN 9 WHEN count(*) >= 9 THEN 8 ELSE count(*) - 1 END AS INT) AS stratum FROM legs GROUP BY 1, 2)"""


def _perm(reps: int, seed: int) -> str:
    return f"""rp AS (SELECT * FROM cell, range({reps}) t(rep)),
      ix AS (SELECT *, row_number() OVER (PARTITION BY rep, stratum ORDER BY corridor_id, schedule) AS i, row_number() OVER (PARTITION BY rep, stratum ORDER BY {_D(f"'{seed}'", 'CAST(rep AS VARCHAR)', 'corridor_id', 'schedule')}, corridor_id, schedule) AS j FROM rp),
      sh AS (SELECT a.rep, a.corridor_id, a.m, b.ybar AS shuffled FROM ix a JOIN ix b ON a.rep = b.rep AND a.stratum = b.stratum AND a.i = b.j),
      sc AS (SELECT rep, corridor_id, sum(m) AS n, sum(m * shuffled) AS s FROM sh GROUP BY 1, 2),
      pd AS (SELECT rep, corridor_id, s / n - (sum(s) OVER (PARTITION BY rep) - s) / (sum(n) OVER (PARTITION BY rep) - n) AS d FROM sc)"""


_YV = f"{_AGG}, yv AS (SELECT corridor_id, n_legs, s / n_legs AS y, (ss - s * s / n_legs) / (n_legs - 1) / n_legs AS v FROM agg WHERE n_legs >= 10)"
_FOUR = "four AS (SELECT count_if(planned_min < 40 AND is_delayed) AS tp, count_if(planned_min < 40 AND NOT is_delayed) AS fp, count_if(planned_min >= 40 AND is_delayed) AS fn, count_if(planned_min >= 40 AND NOT is_delayed) AS tn FROM legs)"
_BLOCKS = f"""b AS (SELECT CAST(CAST(trip_creation_time AS DATE) AS VARCHAR) AS day, sum(gap_min) AS s, count(*) AS n FROM legs GROUP BY 1), bp AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS blocks FROM b),
  dr AS (SELECT rep, {_D("'17'", 'CAST(rep AS VARCHAR)', 'CAST(pos AS VARCHAR)')} % blocks AS pos FROM bp, range(10000) t(rep)), bb AS (SELECT CAST(rep AS INT) AS rep, sum(s) / sum(n) AS mean FROM dr JOIN bp USING (pos) GROUP BY 1)"""
_SUMMARY = "SELECT count(mean) AS reps, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, round(least(1, 2 * least(count_if(mean <= 0) + 1, count_if(mean >= 0) + 1) / (count(mean) + 1)), 6) AS p_value"
_Z = 1.959963984540054
_WILSON = f"round(greatest(0, (p + {_Z}**2 / (2 * n)) / (1 + {_Z}**2 / n) - {_Z} * sqrt(p * (1 - p) / n + {_Z}**2 / (4.0 * n * n)) / (1 + {_Z}**2 / n)), 6) AS low, round(least(1, (p + {_Z}**2 / (2 * n)) / (1 + {_Z}**2 / n) + {_Z} * sqrt(p * (1 - p) / n + {_Z}**2 / (4.0 * n * n)) / (1 + {_Z}**2 / n)), 6) AS high"
_PROP = f"pr AS (SELECT source_center, hits, n, {_WILSON} FROM (SELECT *, hits / n AS p FROM (SELECT source_center, count_if(is_delayed) AS hits, count(*) AS n FROM legs GROUP BY 1)))"
_CUTS = []
_p, _t = 0.36787944117144233, 0.0
for _k in range(8):
    _t += _p
    _CUTS.append(_t)
    _p /= _k + 1

_CH = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma(greatest(0, {n} - ({k})) + 1))"

ORACLE_SQL = {
    "icc_schedule": legs(_icc("", 7)),
    "icc_by_corridor": trips(_icc("corridor_id", 5)),
    "permutation_cells": legs(f"{_CELLS} SELECT corridor_id, schedule, m, round(ybar, 6) AS ybar, round(ss_dev, 6) AS ss_dev, stratum FROM cell"),
    "permutation_by_hash": trips(f"""{_CELLS}, {_perm(20, 7)}, oc AS (SELECT corridor_id, sum(m) AS n, sum(m * ybar) AS s FROM cell GROUP BY 1),
      ob AS (SELECT corridor_id, n, s / n - (sum(s) OVER () - s) / (sum(n) OVER () - n) AS observed FROM oc)
      SELECT corridor_id, CAST(n AS BIGINT) AS n, round(observed, 6) AS observed, count_if(abs(d) >= abs(observed) - 1e-12) AS exceed, round((count_if(abs(d) >= abs(observed) - 1e-12) + 1) / 21, 6) AS p_value FROM ob JOIN pd USING (corridor_id) GROUP BY corridor_id, n, observed"""),
    "eb_tau2": legs(f"{_YV} SELECT count(*) AS k, round(sum(y / v) / sum(1 / v), 7) AS mu_fixed, round(greatest(0, (sum(y * y / v) - sum(y / v) ** 2 / sum(1 / v) - (count(*) - 1)) / (sum(1 / v) - sum(1 / v ** 2) / sum(1 / v))), 7) AS tau2 FROM yv"),
    "eb_posterior": legs(f"""{_YV}, c AS (SELECT sum(1 / (v + 0.01)) AS w, sum(y / (v + 0.01)) / sum(1 / (v + 0.01)) AS mu FROM yv), p AS (SELECT corridor_id, mu, v / (v + 0.01) AS b, (1 - v / (v + 0.01)) * y + v / (v + 0.01) * mu AS pm, sqrt((1 - v / (v + 0.01)) * v + (v / (v + 0.01)) ** 2 / w) AS sd FROM yv, c)
      SELECT corridor_id, round(mu, 6) AS mu, round(b, 6) AS shrink, round(pm, 6) AS post_mean, round(sd, 6) AS post_sd, round(pm - 1.6448536269514722 * sd, 6) AS lo90, round(pm + 1.6448536269514722 * sd, 6) AS hi90, round((pm - 0.1) / sd, 6) AS z FROM p"""),
    "eb_support_bins": legs(f"{_YV} SELECT CASE WHEN n_legs < 20 THEN '10-19' WHEN n_legs < 40 THEN '20-39' WHEN n_legs < 80 THEN '40-79' ELSE '80+' END AS bin, count(*) AS units, round(quantile_cont(y, 0.5), 6) AS median FROM yv GROUP BY 1"),
    "spearman_support": legs(f"{_YV}, r AS (SELECT rank() OVER (ORDER BY n_legs) + (count(*) OVER (PARTITION BY n_legs) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM yv) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r"),
    "bootstrap_groups": trips(f"""p AS (SELECT schedule, gap_min, row_number() OVER (PARTITION BY schedule ORDER BY leg_id) - 1 AS pos, count(*) OVER (PARTITION BY schedule) AS n FROM legs),
      d AS (SELECT schedule, rep, {_D("'11'", 'CAST(rep AS VARCHAR)', 'schedule', 'CAST(pos AS VARCHAR)')} % n AS pos FROM p, range(5) t(rep)) SELECT schedule, CAST(rep AS INT) AS rep, round(avg(gap_min), 6) AS mean FROM d JOIN p USING (schedule, pos) GROUP BY 1, 2"""),
    "bootstrap_paired": trips("d AS (SELECT leg_id, abs(gap_min) - 40 AS d FROM legs), w AS (SELECT rep, d, " + f"{_D(chr(39) + '13' + chr(39), 'CAST(rep AS VARCHAR)', 'leg_id')} / 4294967296.0::DOUBLE AS u FROM d, range(50) t(rep)), b AS (SELECT rep, sum(k * d) / sum(k) AS mean FROM (SELECT *, " + " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in _CUTS) + f" AS k FROM w) GROUP BY 1) {_SUMMARY} FROM b"),
    "bootstrap_blocks": trips(f"{_BLOCKS} SELECT rep, round(mean, 6) AS mean FROM bb"),
    "bootstrap_blocks_summary": trips(f"{_BLOCKS}, r AS (SELECT rep, round(mean, 6) AS mean FROM bb) {_SUMMARY} FROM r"),
    "wilcoxon_signed_rank": trips("""r AS (SELECT gap_min, rank() OVER (ORDER BY abs(gap_min)) + (count(*) OVER (PARTITION BY abs(gap_min)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(gap_min)) AS k FROM legs WHERE gap_min <> 0),
      t AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN gap_min > 0 THEN r ELSE 0 END) AS w, sum(k * k - 1) AS t FROM r) SELECT n, w AS w_plus, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48), 6) AS z FROM t"""),
    "diebold_mariano": trips("""p AS (SELECT gap_min - avg(gap_min) OVER () AS e, avg(gap_min) OVER () AS mu, count(*) OVER () AS n, row_number() OVER (ORDER BY trip_creation_time, leg_id) AS pos FROM legs),
      v AS (SELECT sum(CASE WHEN lag = 0 THEN 1 ELSE 2 * (1 - lag / 6) END * a.e * b.e) / any_value(a.n) AS variance, any_value(a.mu) AS mu, any_value(a.n) AS n FROM p a JOIN range(6) t(lag) ON true JOIN p b ON b.pos = a.pos + lag)
      SELECT n, round(mu, 6) AS mu, round(variance, 6) AS variance, round(mu / sqrt(variance / n), 6) AS dm FROM v"""),
    "trend_by_weekday": trips("""g AS (SELECT dayofweek(trip_creation_time) + 1 AS s, count_if(is_delayed) AS x, count(*) AS n FROM legs GROUP BY 1), t AS (SELECT sum(x) / sum(n) AS p, sum(s * x) AS sx, sum(s * n) AS sn, sum(s * s * n) AS ssn, sum(n) AS n FROM g),
      z AS (SELECT (sx - p * sn) / sqrt(p * (1 - p) * (ssn - sn * sn / n)) AS z FROM t) SELECT round(z, 6) AS z, CASE WHEN z > 0 THEN 'increasing' WHEN z < 0 THEN 'decreasing' ELSE 'flat' END AS direction FROM z"""),
    "two_proportions": trips(f"{_FOUR} SELECT tp, tp + fp AS n1, fn, fn + tn AS n2, round((tp / (tp + fp) - fn / (fn + tn)) / sqrt((tp + fn) / (tp + fp + fn + tn) * (1 - (tp + fn) / (tp + fp + fn + tn)) * (1 / (tp + fp) + 1 / (fn + tn))), 6) AS z FROM four"),
    "agreement_fleiss": """WITH e AS (SELECT event_id % 1000 AS subject, CASE WHEN value > 30 THEN 'a' ELSE 'b' END AS label FROM events), c AS (SELECT subject, label, count(*) AS n FROM e GROUP BY 1, 2),
      s0 AS (SELECT subject, sum(n) AS m, sum(n * n) AS sq, count(*) AS l FROM c GROUP BY 1), mm AS (SELECT m FROM s0 GROUP BY 1 ORDER BY count(*) DESC, m LIMIT 1), s AS (SELECT * FROM s0 WHERE m = (SELECT m FROM mm) AND m > 1),
      pe AS (SELECT sum(n * n) / (sum(n) ** 2) AS pe FROM (SELECT label, sum(n) AS n FROM c WHERE subject IN (SELECT subject FROM s) GROUP BY 1))
      SELECT count(*) AS subjects, CAST(any_value(m) AS BIGINT) AS raters, round(avg((l = 1)::INT), 6) AS unanimous, round((avg((sq - m) / (m * (m - 1))) - any_value(pe)) / (1 - any_value(pe)), 6) AS kappa FROM s, pe""",
    "agreement_cohen": """WITH t AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg((quality = 1)::INT) AS a, avg((toxic = 1)::INT) AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
      SELECT n, round(po, 6) AS po, round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa FROM t""",
    "score_auc": """WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM documents JOIN labels USING (doc_id))
      SELECT count_if(quality = 1) AS p, count_if(quality = 0) AS n, round((sum(CASE WHEN quality = 1 THEN r END) - count_if(quality = 1) * (count_if(quality = 1) + 1) / 2) / (count_if(quality = 1) * count_if(quality = 0)), 6) AS auc FROM r""",
    "proportions_wilson": legs(f"{_PROP} SELECT * FROM pr"),
    "proportions_better": legs(f"{_PROP} SELECT x.source_center AS better, y.source_center AS worse FROM pr x JOIN pr y ON x.low > y.high"),
    "stability_parts": legs(f"""dy AS (SELECT day, ntile(3) OVER (ORDER BY day) AS part FROM (SELECT DISTINCT CAST(trip_creation_time AS DATE) AS day FROM legs)),
      c AS (SELECT part, corridor_id, count(*) AS n, avg(log_gap_ratio) AS m FROM legs JOIN dy ON CAST(trip_creation_time AS DATE) = day GROUP BY 1, 2 HAVING count(*) >= 3), f AS (SELECT part, corridor_id, m > 0.9 AS slow FROM c),
      t AS (SELECT CAST(x.part AS INT) AS a, CAST(y.part AS INT) AS b, count(*) AS common, count_if(x.slow) AS slow_a, count_if(y.slow) AS slow_b, count_if(x.slow AND y.slow) AS "both" FROM f x JOIN f y ON x.corridor_id = y.corridor_id AND x.part < y.part GROUP BY 1, 2)
      SELECT a, b, common, slow_a, slow_b, "both", round("both" / nullif(slow_a + slow_b - "both", 0), 6) AS jaccard, round(slow_a * slow_b / common, 6) AS expected, {_WILSON} FROM (SELECT *, slow_a AS n, "both" / slow_a AS p FROM t)"""),
    "stability_chance": legs(f"""dy AS (SELECT day, ntile(3) OVER (ORDER BY day) AS part FROM (SELECT DISTINCT CAST(trip_creation_time AS DATE) AS day FROM legs)),
      c AS (SELECT part, corridor_id, count(*) AS n, avg(log_gap_ratio) AS m FROM legs JOIN dy ON CAST(trip_creation_time AS DATE) = day GROUP BY 1, 2 HAVING count(*) >= 3), f AS (SELECT part, corridor_id, m > 0.9 AS slow FROM c),
      t AS (SELECT CAST(x.part AS INT) AS a, CAST(y.part AS INT) AS b, count(*) AS common, count_if(x.slow) AS slow_a, count_if(y.slow) AS slow_b, count_if(x.slow AND y.slow) AS "both" FROM f x JOIN f y ON x.corridor_id = y.corridor_id AND x.part < y.part GROUP BY 1, 2)
      SELECT a, b, "both", slow_a, slow_b, common, round(sum(CASE WHEN slow_b - k <= common - slow_a THEN exp({_CH('slow_a', 'k')} + {_CH('common - slow_a', 'slow_b - k')} - {_CH('common', 'slow_b')}) ELSE 0 END), 6) AS p_overlap
      FROM (SELECT *, unnest(range(CAST("both" AS BIGINT), CAST(least(slow_a, slow_b) + 1 AS BIGINT))) AS k FROM t) GROUP BY a, b, "both", slow_a, slow_b, common"""),
    "hash_draws": legs(f"SELECT leg_id, {_D(chr(39) + '5' + chr(39), chr(39) + '0' + chr(39), 'leg_id')} AS u FROM legs"),
}
