"""Queries on empirical-Bayes rankings and on the dependence of legs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import audit as A
from tramline.operators import dependence as D
from tramline.operators import shrinkage as S
from tramline.sources.adapters import legs_from_events, legs_from_orders
from tramline.sources.shared import written

from .history import _rounded, six
from .network import _AGG
from .sql import legs, trips


def _sums(rows):
    """Corridors, network and design effects, from two readings of the legs: corridors are written, and their sums are the network's."""
    c = A.corridor_aggregate(rows).select("corridor_id", "source_center", "destination_center", "n_legs", "sum_log", "sumsq_log", "sum_gap_min")
    c = written(c, "sums")
    names = {"net_n": "n_legs", "net_sum": "sum_log", "net_sumsq": "sumsq_log", "net_gap": "sum_gap_min"}
    return c, c.agg(*[F.sum(of).alias(n) for n, of in names.items()]), S.design_effects(rows)


def _fitted(spark, sf_dir):
    return S.fitted(*_sums(legs_from_orders(spark, sf_dir)))


def _ranks(spark, sf_dir):
    return S.floor_rankings(*_sums(legs_from_orders(spark, sf_dir)))


def eb_design_effects(spark, sf_dir):
    return _rounded(S.design_effects(legs_from_orders(spark, sf_dir)))


def eb_between_variances(spark, sf_dir):
    """Moments, likelihood and restricted likelihood for all floors, with and without design effects."""
    rows = legs_from_events(spark, sf_dir)
    fits = [(name, name, c, S.FACTOR) for name in ("dl", "ml", "reml") for c in (False, True)]
    fits = [(f"{name}{'_clustered' if c else ''}", e, c, x) for name, e, c, x in fits]
    d = S.fitted(A.corridor_aggregate(rows), A.network_baseline(rows), S.design_effects(rows), fits=fits)
    return _rounded(d.groupBy("fit", "floor").agg(F.max("k").alias("k"), F.max("tau2").alias("tau2")), 5)


def eb_fits(spark, sf_dir):
    """Posteriors of every corridor at every floor under the three fits and two other thresholds; p_exceed is tested apart.

    Between-corridor variances go in to six digits: their search ends where likelihoods are equal but for the last bits.
    """
    d = S.posteriors(_fitted(spark, sf_dir).withColumn("tau2", six("tau2")), ["fit", "floor"], with_p=False)
    d = d.select("fit", "floor", "corridor_id", F.col("tau2").cast("decimal(12,6)").alias("tau2"), "mu", "shrink", "post_mean", "post_sd", "lo90", "hi90", "z")
    return _rounded(d, 5).withColumn("tau2", F.col("tau2").cast("double"))


def ranking_overlap(spark, sf_dir):
    """Stability over floors of the three rankings that need no p-value, under every fit."""
    return _rounded(S.pair_stability(_ranks(spark, sf_dir).where("ranking != 'raw_published'")))


def ranking_stability(spark, sf_dir):
    return _rounded(S.pair_stability(_ranks(spark, sf_dir)))


def ranking_mean_jaccard(spark, sf_dir):
    return _rounded(S.mean_jaccard(S.pair_stability(_ranks(spark, sf_dir).where("ranking != 'raw_published'"))))


def dependence_iccs(spark, sf_dir):
    rows, _ = D.tested_legs(legs_from_events(spark, sf_dir))
    return _rounded(D.cluster_iccs(rows))


def dependence_diagnostics(spark, sf_dir):
    return _rounded(D.diagnostics(legs_from_events(spark, sf_dir)))


def dependence_repeats(spark, sf_dir):
    return _rounded(D.repeats(legs_from_events(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (
    eb_design_effects, eb_between_variances, eb_fits, ranking_overlap, ranking_stability, ranking_mean_jaccard,
    dependence_iccs, dependence_diagnostics, dependence_repeats,
)}

_BASE = f"""{_AGG}, de AS (SELECT corridor_id, count(*) AS cells, 1 + (greatest(sum(n) / count(*), 1.0) - 1) * {S.SCHEDULE_ICC} AS design_effect
    FROM (SELECT corridor_id, schedule, count(*) AS n FROM legs GROUP BY 1, 2) GROUP BY 1),
  fl AS (SELECT corridor_id, unnest(list_filter({S.FLOORS}, lambda x: x <= n_legs)) AS floor, s / n_legs AS y, greatest(0, (ss - s * s / n_legs) / (n_legs - 1)) / n_legs AS v0
    FROM agg WHERE n_legs > 1),
  rw AS (SELECT floor, clustered, corridor_id, y, CASE WHEN clustered THEN v0 * design_effect ELSE v0 END AS v FROM fl JOIN de USING (corridor_id), (SELECT unnest([true, false]) AS clustered) WHERE v0 > 0),
  fam AS (SELECT floor, clustered, count(*) AS k, greatest(0, coalesce((sum(y * y / v) - sum(y / v) ** 2 / sum(1 / v) - (count(*) - 1)) / nullif(sum(1 / v) - sum(1 / v ** 2) / sum(1 / v), 0), 0)) AS dl,
    greatest(4 * var_pop(y), 1e-6) AS high FROM rw GROUP BY 1, 2),
  s0 AS (SELECT floor, clustered, reml, 0.0::DOUBLE AS low, high FROM fam, (SELECT unnest([true, false]) AS reml))"""


def _rounds() -> str:
    out = []
    for k in range(S.ROUNDS):
        out.append(f"""g{k} AS (SELECT floor, clustered, reml, (high - low) / {S.POINTS - 1} AS step, low + (high - low) / {S.POINTS - 1} * i AS t FROM s{k}, range({S.POINTS}) r(i)),
  m{k} AS (SELECT floor, clustered, reml, step, t, sum(ln(v + t)) AS lv, sum(1 / (v + t)) AS w, sum(y / (v + t)) AS wy, sum(y * y / (v + t)) AS wyy FROM g{k} JOIN rw USING (floor, clustered) GROUP BY ALL),
  l{k} AS (SELECT floor, clustered, reml, step, t, lv + wyy - wy * wy / w + CASE WHEN reml THEN ln(w) ELSE 0 END AS loss FROM m{k}),
  s{k + 1} AS (SELECT floor, clustered, reml, greatest(0, t - step) AS low, t + step AS high, t AS best FROM l{k} QUALIFY row_number() OVER (PARTITION BY floor, clustered, reml ORDER BY loss, t) = 1)""")
    return ",\n  ".join(out)


_TAU2 = f"""{_BASE}, {_rounds()},
  tau AS (SELECT floor, clustered, any_value(k) AS k, any_value(dl) AS dl, max(CASE WHEN f.reml THEN best END) AS reml, max(CASE WHEN NOT f.reml THEN best END) AS ml FROM fam JOIN s{S.ROUNDS} f USING (floor, clustered) GROUP BY floor, clustered)"""
_FITS = ", ".join(f"{{'fit': '{name}', 'c': {str(c).lower()}, 'e': '{e}', 'over': ln({x}::DOUBLE)}}" for name, e, c, x in S.FITS)
_POST = f"""{_TAU2},
  ft AS (SELECT floor, clustered, u.fit AS fit, CASE u.e WHEN 'dl' THEN dl ELSE reml END AS tau2, u.over + (SELECT ns / nn FROM net) AS threshold
    FROM (SELECT *, unnest([{_FITS}]) AS u FROM tau) WHERE u.c = clustered),
  c AS (SELECT fit, floor, any_value(tau2) AS tau2, any_value(threshold) AS threshold, sum(1 / (v + tau2)) AS u, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS mu FROM rw JOIN ft USING (floor, clustered) GROUP BY 1, 2),
  p AS (SELECT fit, floor, corridor_id, y, v, tau2, mu, u, threshold, v / (v + tau2) AS b, (1 - v / (v + tau2)) * y + v / (v + tau2) * mu AS pm FROM rw JOIN ft USING (floor, clustered) JOIN (SELECT fit, floor, mu, u FROM c) USING (fit, floor)),
  z AS (SELECT *, sqrt((1 - b) * v + b * b / u) AS sd, (pm - threshold) / nullif(sqrt((1 - b) * v + b * b / u), 0) AS z FROM p)"""
_OVERLAP = f"""{_POST},
  l AS (SELECT fit, floor, corridor_id, 'raw_mean' AS ranking, y AS s1, 0.0 AS s2 FROM z UNION ALL SELECT fit, floor, corridor_id, 'eb_prob', z, pm FROM z UNION ALL SELECT fit, floor, corridor_id, 'eb_postmean', pm, 0.0 FROM z),
  r AS (SELECT *, row_number() OVER (PARTITION BY fit, floor, ranking ORDER BY round(s1, 9) DESC NULLS LAST, round(s2, 9) DESC, corridor_id) AS pos FROM l),
  sz AS (SELECT fit, floor, ranking, least(20, count(*)) AS n FROM r GROUP BY ALL),
  j AS (SELECT x.fit, x.ranking, x.floor AS a, y.floor AS b, x.pos AS pa, y.pos AS pb, row_number() OVER (PARTITION BY x.fit, x.ranking, x.floor, y.floor ORDER BY x.pos) AS ca
    FROM r x JOIN r y ON x.fit = y.fit AND x.ranking = y.ranking AND x.corridor_id = y.corridor_id AND x.floor < y.floor),
  k AS (SELECT fit, ranking, a, b, count_if(pa <= 20 AND pb <= 20) AS both2, count_if(ca <= 20 AND pb <= 20) AS both_c, count_if(ca <= 20) AS size_c, CASE WHEN count(*) > 1 THEN corr(ca, pb) END AS rho, count(*) AS corridors FROM j GROUP BY 1, 2, 3, 4),
  st AS (SELECT k.*, both2 / nullif(x.n + y.n - both2, 0) AS jaccard, both_c / nullif(size_c + y.n - both_c, 0) AS common_jaccard
    FROM k JOIN sz x ON x.fit = k.fit AND x.ranking = k.ranking AND x.floor = a JOIN sz y ON y.fit = k.fit AND y.ranking = k.ranking AND y.floor = b)"""

_LEGS = """cs AS (SELECT corridor_id, count(*) AS n_legs, avg(log_gap_ratio) AS mean_r, count(DISTINCT trip_uuid) AS n_trips, count(DISTINCT CAST(trip_creation_time AS DATE)) AS n_days, count(DISTINCT schedule) AS n_schedules
    FROM legs GROUP BY 1 HAVING count(*) >= 10),
  tl AS (SELECT legs.*, CAST(trip_creation_time AS DATE) AS day, log_gap_ratio - mean_r AS res FROM legs JOIN cs USING (corridor_id))"""


def _icc_of(what: str, value: str, by: str, several: bool) -> str:
    return f"""SELECT '{what}' AS what, groups, (n - n2 / n) / nullif(groups - 1, 0) AS n0, (b - s * s / n) / nullif(groups - 1, 0) AS msb, (ss - b) / nullif(n - groups, 0) AS msw FROM (
      SELECT count(*) AS groups, sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b, sum(n * n) AS n2 FROM (
        SELECT count(*) AS n, sum({value}) AS s, sum({value} ** 2) AS ss FROM tl GROUP BY {by}{" HAVING count(*) > 1" if several else ""}))"""


_ICC = f"""{_LEGS}, ic AS (SELECT what, groups, n0, (msb - msw) / nullif(msb + (n0 - 1) * msw, 0) AS rho FROM ({" UNION ALL ".join([
    _icc_of("corridor", "log_gap_ratio", "corridor_id", False), _icc_of("day", "res", "day", False), _icc_of("trip", "res", "trip_uuid", True),
    _icc_of("cell", "res", "corridor_id, schedule", True)])}))"""


def _spread(what: str, x: str, of: str) -> str:
    at = lambda q: f"round(quantile_cont(CAST({x} AS DOUBLE), {q}), 6)"
    return f"""SELECT '{what}' AS what, count(*) AS units, round(CAST(min({x}) AS DOUBLE), 6) AS least, {at(0.25)} AS p25, {at(0.5)} AS median, round(avg({x}), 6) AS mean, {at(0.75)} AS p75, round(CAST(max({x}) AS DOUBLE), 6) AS most FROM {of}"""


_DE = f"""{_ICC}, rh AS (SELECT greatest(0, max(rho) FILTER (what = 'day')) AS rd, greatest(0, max(rho) FILTER (what = 'cell')) AS rc FROM ic),
  de AS (SELECT cs.*, 1 + (greatest(n_legs / n_days, 1.0) - 1) * rd AS de_day, 1 + (greatest(n_legs / n_schedules, 1.0) - 1) * rc AS de_cell FROM cs, rh)"""

ORACLE_SQL = {
    "eb_design_effects": legs(f"{_BASE} SELECT corridor_id, cells, round(design_effect, 6) AS design_effect FROM de"),
    "eb_between_variances": trips(f"""{_TAU2} SELECT u.f || CASE WHEN clustered THEN '_clustered' ELSE '' END AS fit, floor, k, round(u.t, 5) AS tau2
      FROM (SELECT *, unnest([{{'f': 'dl', 't': dl}}, {{'f': 'ml', 't': ml}}, {{'f': 'reml', 't': reml}}]) AS u FROM tau)"""),
    "eb_fits": legs(f"""{_POST.replace("THEN dl ELSE reml END AS tau2", "THEN round(dl, 6) ELSE round(reml, 6) END AS tau2")} SELECT fit, floor, corridor_id, tau2, round(mu, 5) AS mu, round(b, 5) AS shrink, round(pm, 5) AS post_mean, round(sd, 5) AS post_sd,
      round(pm - 1.6448536269514722 * sd, 5) AS lo90, round(pm + 1.6448536269514722 * sd, 5) AS hi90, round(z, 5) AS z FROM z"""),
    "ranking_overlap": legs(f"{_OVERLAP} SELECT fit, ranking, a, b, round(jaccard, 6) AS jaccard, round(common_jaccard, 6) AS common_jaccard, round(rho, 6) AS rho, corridors FROM st"),
    "ranking_mean_jaccard": legs(f"{_OVERLAP} SELECT fit, ranking, round(avg(jaccard), 6) AS mean_jaccard, count(jaccard) AS pairs FROM st GROUP BY 1, 2"),
    "dependence_iccs": trips(f"{_ICC} SELECT what, groups, round(n0, 6) AS n0, round(rho, 6) AS rho FROM ic"),
    "dependence_diagnostics": trips(f"{_DE} " + " UNION ALL ".join([
        _spread("legs per corridor", "n_legs", "cs"), _spread("trips per corridor", "n_trips", "cs"), _spread("days per corridor", "n_days", "cs"),
        _spread("schedule cells per corridor", "n_schedules", "cs"), _spread("legs per trip", "n", "(SELECT count(*) AS n FROM legs GROUP BY trip_uuid)"),
        _spread("legs per corridor and day", "n", "(SELECT count(*) AS n FROM tl GROUP BY corridor_id, day)"),
        _spread("legs per schedule cell", "n", "(SELECT count(*) AS n FROM tl GROUP BY corridor_id, schedule)"),
        _spread("design effect of days", "de_day", "de"), _spread("effective legs under days", "n_legs / de_day", "de"),
        _spread("design effect of schedule cells", "de_cell", "de"), _spread("effective legs under schedule cells", "n_legs / de_cell", "de"),
    ])),
    "dependence_repeats": trips(f"""{_ICC}, tp AS (SELECT count(*) AS n_trips, sum(n * n) / sum(n) AS size FROM (SELECT count(*) AS n FROM legs GROUP BY trip_uuid)),
      dy AS (SELECT count(*) AS n_legs, count(DISTINCT CAST(trip_creation_time AS DATE)) AS n_days, min(CAST(trip_creation_time AS DATE)) AS first_day, max(CAST(trip_creation_time AS DATE)) AS last_day FROM legs),
      co AS (SELECT count(*) AS corridors_tested, CAST(sum(n_legs) AS BIGINT) AS tested_legs, count_if(n_legs > n_trips) AS corridors_repeated, max(n_legs - n_trips) AS most_repeats, CAST(sum(n_days) AS BIGINT) AS corridor_days, count_if(n_schedules = 1) AS one_schedule FROM cs)
      SELECT dy.*, n_trips, co.*, round(1 + (size - 1) * (SELECT greatest(0, rho) FROM ic WHERE what = 'trip'), 6) AS trip_design_effect FROM tp, dy, co"""),
}
