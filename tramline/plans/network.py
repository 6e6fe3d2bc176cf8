"""Queries on legs, hubs and the corridor audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import audit as A
from tramline.operators import hubs as H
from tramline.sources.adapters import as_legs, legs_from_events, legs_from_orders, segments_from_lineitem, table

from .history import _rounded
from .sql import legs, segments, trips


def flagship(spark, sf_dir, floor: int = 1):
    """Corridors of the order legs against the rest of the network, by excess ratio."""
    rows = legs_from_orders(spark, sf_dir)
    tested = A.welch(A.corridor_aggregate(rows).where(F.col("n_legs") >= floor), A.network_baseline(rows), with_p=False)
    return _rounded(tested.select("corridor_id", "n_legs", "mean_log", "excess_ratio", "t_stat", "dof", "cohens_d").orderBy(F.col("excess_ratio").desc(), "corridor_id"))


def corridor_welch(spark, sf_dir):
    return flagship(spark, sf_dir, 10)


def corridor_aggregate(spark, sf_dir):
    return _rounded(A.corridor_aggregate(legs_from_orders(spark, sf_dir)))


def network_baseline(spark, sf_dir):
    return _rounded(A.network_baseline(legs_from_orders(spark, sf_dir)), 4)


def audit_full(spark, sf_dir):
    d = A.audit(legs_from_orders(spark, sf_dir))
    return _rounded(d.select("corridor_id", "n_legs", "excess_ratio", "p_value", "q_value", "is_significant", "direction", "bottleneck_rank"))


def audit_floor_sweep(spark, sf_dir):
    return A.floor_summary(A.audit_floors(legs_from_orders(spark, sf_dir), [10, 20, 30, 50, 100]))


def _q(spark, sf_dir):
    """Corridors with a p-value that SQL can compute too: the hash of the corridor as a uniform number."""
    rows = A.corridor_aggregate(legs_from_orders(spark, sf_dir)).select("corridor_id", "source_center", "n_legs")
    from tramline.functions.columns import draw

    return rows.withColumn("p_value", draw("p", F.col("corridor_id")) / 4294967296.0)


def adjust_bh(spark, sf_dir):
    return _rounded(A.adjusted(_q(spark, sf_dir), "p_value", ["source_center"]), 9)


def adjust_by(spark, sf_dir):
    return _rounded(A.adjusted(_q(spark, sf_dir), "p_value", ["source_center"], "by"), 9)


def adjust_holm(spark, sf_dir):
    return _rounded(A.adjusted(_q(spark, sf_dir), "p_value", ["source_center"], "holm"), 9)


def audit_headline(spark, sf_dir):
    """Variants, headline and status over p-values that SQL can compute too (audit_variants has the real ones)."""
    from tramline.functions.columns import draw

    rows = A.corridor_aggregate(legs_from_orders(spark, sf_dir))
    p = lambda name, power: F.pow(draw(name, F.col("corridor_id")) / 4294967296.0, F.lit(power))
    tested = rows.select("corridor_id", (0.5 + draw("x", F.col("corridor_id")) / 4294967296.0).alias("excess_ratio"), p("w", 6.0).alias("p_welch"), p("m", 5.0).alias("p_perm"))
    return _rounded(A.headline(A.variants(tested)))


def worst_corridors(spark, sf_dir):
    return A.top(corridor_welch(spark, sf_dir).where("excess_ratio > 1"), [F.col("excess_ratio").desc(), F.col("corridor_id")], 20)


def best_corridors(spark, sf_dir):
    return A.top(corridor_welch(spark, sf_dir).where("excess_ratio < 1"), [F.col("excess_ratio"), F.col("corridor_id")], 20)


def corridor_severity(spark, sf_dir):
    d = corridor_welch(spark, sf_dir).withColumn("direction", F.when(F.col("excess_ratio") >= 1, "worse").otherwise("better"))
    return d.select("corridor_id", "direction", A.severity(F.col("excess_ratio"), F.col("direction")).alias("severity"))


def corridor_lookup(spark, sf_dir):
    return corridor_welch(spark, sf_dir).where("corridor_id = 'S1>C1'").select("corridor_id", "n_legs", "excess_ratio")


def segments_to_legs(spark, sf_dir):
    return _rounded(H.reconstruct(segments_from_lineitem(spark, sf_dir)))


def segments_constant(spark, sf_dir):
    return H.constants(segments_from_lineitem(spark, sf_dir), "leg", ["route_type", "row_index"])


def segments_first_maximum(spark, sf_dir):
    return _rounded(H.first_maximum(segments_from_lineitem(spark, sf_dir)))


def segments_summary(spark, sf_dir):
    return _rounded(H.reconstruction_summary(H.reconstruct(segments_from_lineitem(spark, sf_dir))))


def foreign_trips(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = as_legs(o, F.col("l_suppkey") % 10, F.col("o_custkey") % 10, "o_orderdate", "l_shipdate", F.col("l_quantity"), F.lit(0.5))
    return _rounded(rows.groupBy("corridor_id").agg(F.count("*").alias("legs"), F.avg("gap_ratio").alias("mean_ratio")), 4)


def hub_sides(spark, sf_dir):
    return _rounded(H.sides(legs_from_events(spark, sf_dir)))


def hub_handoffs(spark, sf_dir):
    return _rounded(H.handoffs(legs_from_events(spark, sf_dir)), 4)


def hub_chain(spark, sf_dir):
    return H.leg_chain(legs_from_events(spark, sf_dir)).select("leg_id", "leg_seq", "next_source")


def hub_directory(spark, sf_dir):
    return H.directory(legs_from_events(spark, sf_dir))


def hub_table(spark, sf_dir):
    d = H.hub_table(legs_from_events(spark, sf_dir))
    return _rounded(d.select("centre_code", "main_route", "n_legs_out", "n_legs_in", "n_legs_total", "n_handoffs", "n_chain_breaks", "chain_break_rate", "has_support", "friction_rank"))


def hub_diagnostics(spark, sf_dir):
    return _rounded(H.metric_diagnostics(H.hub_table(legs_from_events(spark, sf_dir))))


def hub_leaderboard(spark, sf_dir):
    return H.leaderboard(H.hub_table(legs_from_events(spark, sf_dir)))


def hub_corridors(spark, sf_dir):
    rows = legs_from_events(spark, sf_dir)
    tested = A.welch(A.corridor_aggregate(rows), A.network_baseline(rows), with_p=False)
    slow = tested.withColumn("bottleneck_rank", F.when(F.col("excess_ratio") > 1.1, 1))
    return _rounded(H.hubs_and_corridors(H.hub_table(rows), slow))


QUERIES = {f.__name__: f for f in (
    corridor_welch, corridor_aggregate, network_baseline, audit_full, audit_floor_sweep, adjust_bh, adjust_by, adjust_holm, audit_headline,
    worst_corridors, best_corridors, corridor_severity, corridor_lookup, segments_to_legs, segments_constant, segments_first_maximum,
    segments_summary, foreign_trips, hub_sides, hub_handoffs, hub_chain, hub_directory, hub_table, hub_diagnostics, hub_leaderboard, hub_corridors,
)}

_AGG = """agg AS (SELECT corridor_id, min(source_center) AS source_center, count(*) AS n_legs, sum(log_gap_ratio) AS s, sum(log_gap_ratio * log_gap_ratio) AS ss FROM legs GROUP BY 1),
net AS (SELECT sum(n_legs) AS nn, sum(s) AS ns, sum(ss) AS nss FROM agg)"""


def _welch(floor: int) -> str:
    return f"""{_AGG},
w0 AS (SELECT *, s / n_legs AS m, (ns - s) / nullif(nn - n_legs, 0) AS rm, nn - n_legs AS k FROM agg, net WHERE n_legs >= {floor}),
w1 AS (SELECT *, CASE WHEN n_legs > 1 THEN greatest(0, (ss - n_legs * m * m) / nullif(n_legs - 1, 0)) END AS v, CASE WHEN k > 1 THEN greatest(0, (nss - ss - k * rm * rm) / nullif(k - 1, 0)) END AS rv FROM w0),
welch AS (SELECT corridor_id, source_center, n_legs, m AS mean_log, exp(m - rm) AS excess_ratio, (m - rm) / nullif(sqrt(v / n_legs + rv / k), 0) AS t_stat,
  (v / n_legs + rv / k) ** 2 / nullif((v / n_legs) ** 2 / nullif(n_legs - 1, 0) + (rv / k) ** 2 / nullif(k - 1, 0), 0) AS dof,
  (m - rm) / nullif(sqrt(((n_legs - 1) * v + (k - 1) * rv) / nullif(n_legs + k - 2, 0)), 0) AS cohens_d FROM w1)"""


_WELCH_ROWS = "SELECT corridor_id, n_legs, round(mean_log, 6) AS mean_log, round(excess_ratio, 6) AS excess_ratio, round(t_stat, 6) AS t_stat, round(dof, 6) AS dof, round(cohens_d, 6) AS cohens_d FROM welch"
_P = "p AS (SELECT corridor_id, min(source_center) AS source_center, count(*) AS n_legs, CAST('0x' || substr(md5('p|' || corridor_id), 1, 8) AS BIGINT) / 4294967296.0 AS p_value FROM legs GROUP BY 1), pr AS (SELECT *, row_number() OVER (PARTITION BY source_center ORDER BY p_value, corridor_id) AS r, count(*) OVER (PARTITION BY source_center) AS m FROM p)"


def _adj(kind: str) -> str:
    c = "list_sum(list_transform(range(1, m + 1), lambda i: 1.0::DOUBLE / i))" if kind == "by" else "1"
    e = "least(1, max((m - r + 1) * p_value) OVER (PARTITION BY source_center ORDER BY r))" if kind == "holm" else f"least(1, min(p_value * m * {c} / r) OVER (PARTITION BY source_center ORDER BY r DESC))"
    return f"SELECT corridor_id, source_center, n_legs, round(p_value, 9) AS p_value, round({e}, 9) AS q_value FROM pr"


_SIDE = ", ".join(
    f"count(*) FILTER (side = '{s}') AS n_legs_{s}, count(DISTINCT corridor_id) FILTER (side = '{s}') AS n_corridors_{s}, round(quantile_cont(dwell_min, 0.5) FILTER (side = '{s}'), 6) AS median_dwell_min_{s}, "
    f"round(avg(dwell_min) FILTER (side = '{s}'), 6) AS mean_dwell_min_{s}, round(quantile_cont(dwell_min, 0.9) FILTER (side = '{s}'), 6) AS p90_dwell_min_{s}, "
    f"round(quantile_cont(dwell_share, 0.5) FILTER (side = '{s}'), 6) AS median_dwell_share_{s}, round(quantile_cont(gap_ratio, 0.5) FILTER (side = '{s}'), 6) AS median_gap_ratio_{s}"
    for s in ("out", "in")
)
_ENDS = """ends AS (SELECT source_center AS centre_code, 'out' AS side, corridor_id, dwell_min, gap_ratio, route_type, dwell_min / nullif(start_scan_to_end_scan, 0) AS dwell_share FROM legs
  UNION ALL SELECT destination_center, 'in', corridor_id, dwell_min, gap_ratio, route_type, dwell_min / nullif(start_scan_to_end_scan, 0) FROM legs)"""
_CHAIN = "chain AS (SELECT *, row_number() OVER w AS leg_seq, lead(source_center) OVER w AS next_source, lead(od_start_time) OVER w AS next_start FROM legs WINDOW w AS (PARTITION BY trip_uuid ORDER BY od_start_time, od_end_time, leg_id))"
_HAND = """hand AS (SELECT destination_center AS centre_code, count(*) AS n_handoffs, count(gap) AS n_chain_breaks, quantile_cont(gap, 0.5) AS md, avg(gap) AS mn FROM (
  SELECT *, CASE WHEN destination_center <> next_source THEN (epoch_us(next_start) - epoch_us(od_end_time)) / 60e6 END AS gap FROM chain WHERE next_source IS NOT NULL) GROUP BY 1)"""
_DIR = "dir AS (SELECT centre_code, route_type AS main_route FROM (SELECT centre_code, route_type, count(*) AS n FROM ends GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY centre_code ORDER BY n DESC, route_type) = 1)"
_HUB = f"""{_ENDS}, {_CHAIN}, {_HAND}, {_DIR}, sd AS (SELECT centre_code, {_SIDE} FROM ends GROUP BY 1),
hub AS (SELECT *, n_legs_out >= 30 AS has_support, n_legs_out + n_legs_in AS n_legs_total FROM dir LEFT JOIN sd USING (centre_code) LEFT JOIN hand USING (centre_code)),
hubr AS (SELECT * REPLACE (coalesce(n_handoffs, 0) AS n_handoffs, coalesce(n_chain_breaks, 0) AS n_chain_breaks),
  CASE WHEN has_support THEN row_number() OVER (PARTITION BY has_support ORDER BY msx DESC NULLS LAST, centre_code) END AS friction_rank
  FROM hub JOIN (SELECT centre_code, quantile_cont(dwell_share, 0.5) FILTER (side = 'out') AS msx, quantile_cont(dwell_min, 0.5) FILTER (side = 'out') AS mmx, quantile_cont(dwell_share, 0.5) FILTER (side = 'in') AS msi FROM ends GROUP BY 1) USING (centre_code))"""
_BINS = """CASE WHEN excess_ratio >= 1 THEN CASE WHEN excess_ratio <= 1.20 THEN 'mildly worse' WHEN excess_ratio <= 1.50 THEN 'clearly worse' WHEN excess_ratio <= 2.50 THEN 'severe' ELSE 'extreme' END
  ELSE CASE WHEN excess_ratio <= 0.60 THEN 'extreme' WHEN excess_ratio <= 0.75 THEN 'much better' WHEN excess_ratio <= 0.90 THEN 'clearly better' ELSE 'mildly better' END END"""


def _unit(name: str) -> str:
    return f"CAST('0x' || substr(md5('{name}|' || corridor_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


def _variant(p: str) -> str:
    """BH and BY of one p-value over all corridors."""
    return f"""r_{p} AS (SELECT corridor_id, p_{p} AS p, row_number() OVER (ORDER BY p_{p}, corridor_id) AS r, count(*) OVER () AS m FROM h),
      y_{p} AS (SELECT sum(1.0::DOUBLE / r) AS y FROM r_{p}),
      v_{p} AS (SELECT corridor_id, least(1, min(p * m / r) OVER (ORDER BY r DESC)) AS q_bh_{p}, least(1, min(p * m * y / r) OVER (ORDER BY r DESC)) AS q_by_{p} FROM r_{p}, y_{p})"""

_RECON = """last AS (SELECT leg, arg_max(actual_time, row_index) AS actual_time, arg_max(osrm_time, row_index) AS osrm_time, arg_max(route_type, row_index) AS route_type, count(*) AS n_segments, sum(segment_actual_time) AS sum_actual, sum(segment_osrm_time) AS sum_osrm FROM seg GROUP BY 1)"""

ORACLE_SQL = {
    "corridor_welch": legs(f"{_welch(10)} {_WELCH_ROWS}"),
    "corridor_aggregate": legs("""SELECT corridor_id, min(source_center) AS source_center, min(destination_center) AS destination_center, count(*) AS n_legs, round(sum(log_gap_ratio), 6) AS sum_log, round(sum(log_gap_ratio * log_gap_ratio), 6) AS sumsq_log,
      round(avg(gap_min), 6) AS mean_gap_min, round(quantile_cont(gap_min, 0.5), 6) AS median_gap_min, round(quantile_cont(gap_min, 0.9), 6) AS p90_gap_min, round(sum(gap_min), 6) AS sum_gap_min, round(avg(gap_ratio), 6) AS mean_gap_ratio,
      round(quantile_cont(gap_ratio, 0.5), 6) AS median_gap_ratio, round(avg(planned_min), 6) AS mean_planned_min, round(avg(planned_km), 6) AS mean_km, round(avg(actual_time), 6) AS mean_actual_min, round(avg(dwell_min), 6) AS mean_dwell_min,
      round(avg(is_delayed::INT), 6) AS delayed_share, count(DISTINCT trip_uuid) AS n_trips, count(DISTINCT schedule) AS n_schedules, round(avg((route_type = 'FTL')::INT), 6) AS ftl_share, min(od_end_time) AS first_end, max(od_end_time) AS last_end FROM legs GROUP BY 1"""),
    "network_baseline": legs("SELECT count(*) AS net_n, round(sum(log_gap_ratio), 4) AS net_sum, round(sum(log_gap_ratio * log_gap_ratio), 4) AS net_sumsq, round(sum(gap_min), 4) AS net_gap FROM legs"),
    **{f"adjust_{k}": legs(f"{_P} {_adj(k)}") for k in ("bh", "by", "holm")},
    "audit_headline": legs(f"""h AS (SELECT corridor_id, 0.5 + {_unit('x')} AS excess_ratio, ({_unit('w')}) ** 6 AS p_welch, ({_unit('m')}) ** 5 AS p_perm FROM (SELECT DISTINCT corridor_id FROM legs)),
      {_variant('welch')}, {_variant('perm')},
      t AS (SELECT h.*, q_by_perm, q_bh_perm, q_by_welch, q_bh_welch, q_by_perm <= 0.05 AS sig_by_perm, q_bh_perm <= 0.05 AS sig_bh_perm, q_by_welch <= 0.05 AS sig_by_welch, q_bh_welch <= 0.05 AS sig_bh_welch,
        CASE WHEN excess_ratio >= 1 THEN 'worse' ELSE 'better' END AS direction FROM h JOIN v_welch USING (corridor_id) JOIN v_perm USING (corridor_id)),
      c AS (SELECT 1 AS k, 'by_perm' AS variant, count_if(sig_by_perm AND direction = 'worse') AS s, count_if(sig_by_perm AND direction = 'better') AS f FROM t
        UNION ALL SELECT 2, 'bh_perm', count_if(sig_bh_perm AND direction = 'worse'), count_if(sig_bh_perm AND direction = 'better') FROM t
        UNION ALL SELECT 3, 'by_welch', count_if(sig_by_welch AND direction = 'worse'), count_if(sig_by_welch AND direction = 'better') FROM t
        UNION ALL SELECT 4, 'bh_welch', count_if(sig_bh_welch AND direction = 'worse'), count_if(sig_bh_welch AND direction = 'better') FROM t),
      hd AS (SELECT variant AS headline_variant FROM c ORDER BY s, f, k LIMIT 1),
      o AS (SELECT *, CASE headline_variant WHEN 'by_perm' THEN sig_by_perm WHEN 'bh_perm' THEN sig_bh_perm WHEN 'by_welch' THEN sig_by_welch ELSE sig_bh_welch END AS hit FROM t, hd)
      SELECT corridor_id, round(excess_ratio, 6) AS excess_ratio, round(p_welch, 6) AS p_welch, round(p_perm, 6) AS p_perm, round(q_by_perm, 6) AS q_by_perm, round(q_bh_perm, 6) AS q_bh_perm, round(q_by_welch, 6) AS q_by_welch, round(q_bh_welch, 6) AS q_bh_welch,
        sig_by_perm, sig_bh_perm, sig_by_welch, sig_bh_welch, direction, headline_variant, CASE WHEN hit AND sig_bh_welch THEN 'robust' WHEN sig_bh_welch THEN 'fragile' WHEN hit THEN 'headline_only' ELSE 'not_significant' END AS status FROM o"""),
    "worst_corridors": legs(f"{_welch(10)}, r AS ({_WELCH_ROWS}) SELECT * FROM r WHERE excess_ratio > 1 ORDER BY excess_ratio DESC, corridor_id LIMIT 20"),
    "best_corridors": legs(f"{_welch(10)}, r AS ({_WELCH_ROWS}) SELECT * FROM r WHERE excess_ratio < 1 ORDER BY excess_ratio, corridor_id LIMIT 20"),
    "corridor_severity": legs(f"{_welch(10)}, r AS ({_WELCH_ROWS}) SELECT corridor_id, CASE WHEN excess_ratio >= 1 THEN 'worse' ELSE 'better' END AS direction, {_BINS} AS severity FROM r"),
    "corridor_lookup": legs(f"{_welch(10)}, r AS ({_WELCH_ROWS}) SELECT corridor_id, n_legs, excess_ratio FROM r WHERE corridor_id = 'S1>C1'"),
    "segments_to_legs": segments(f"{_RECON} SELECT leg, round(actual_time, 6) AS actual_time, round(osrm_time, 6) AS osrm_time, route_type, n_segments, round(sum_actual, 6) AS sum_actual, round(sum_osrm, 6) AS sum_osrm, round(actual_time - osrm_time, 6) AS gap_min, round(actual_time / nullif(osrm_time, 0), 6) AS gap_ratio FROM last"),
    "segments_constant": segments("v AS (SELECT leg, min(route_type) <> max(route_type) AS a, min(row_index) <> max(row_index) AS b FROM seg GROUP BY 1) SELECT count(*) AS legs, count_if(a) AS route_type_varies, count_if(b) AS row_index_varies FROM v"),
    "segments_first_maximum": segments("SELECT leg, CAST(row_index AS INT) AS row_index, round(actual_time, 6) AS actual_time, round(osrm_time, 6) AS osrm_time FROM seg QUALIFY row_number() OVER (PARTITION BY leg ORDER BY actual_time DESC, row_index) = 1"),
    "segments_summary": segments(f"{_RECON} SELECT count(*) AS legs, round(quantile_cont(actual_time / osrm_time, 0.5), 6) AS median_ratio, round(quantile_cont(actual_time - osrm_time, 0.5), 6) AS median_gap, round(avg((actual_time / osrm_time > 2)::INT), 6) AS late_share, round(avg(n_segments), 6) AS mean_segments FROM last"),
    "foreign_trips": """SELECT (l_suppkey % 10) || '>' || (o_custkey % 10) AS corridor_id, count(*) AS legs, round(avg((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 60e6 / (l_quantity / 0.5)), 4) AS mean_ratio
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate AND l_quantity > 0 GROUP BY 1""",
    "hub_sides": trips(f"{_ENDS} SELECT centre_code, {_SIDE} FROM ends GROUP BY 1"),
    "hub_handoffs": trips(f"{_CHAIN}, {_HAND} SELECT centre_code, n_handoffs, n_chain_breaks, round(md, 4) AS median_unobserved_gap_min, round(mn, 4) AS mean_unobserved_gap_min FROM hand"),
    "hub_chain": trips(f"{_CHAIN} SELECT leg_id, CAST(leg_seq AS INT) AS leg_seq, next_source FROM chain"),
    "hub_directory": trips(f"{_ENDS}, {_DIR} SELECT * FROM dir"),
    "hub_table": trips(f"{_HUB} SELECT centre_code, main_route, n_legs_out, n_legs_in, n_legs_total, n_handoffs, n_chain_breaks, round(n_chain_breaks / nullif(n_handoffs, 0), 6) AS chain_break_rate, has_support, CAST(friction_rank AS INT) AS friction_rank FROM hubr"),
    "hub_diagnostics": trips(f"{_HUB}, rk AS (SELECT *, row_number() OVER (ORDER BY msx DESC NULLS LAST, centre_code) AS a, row_number() OVER (ORDER BY mmx DESC NULLS LAST, centre_code) AS b FROM hubr WHERE has_support) SELECT count(*) AS hubs, round(corr(msx, msi), 6) AS corr_share, round(corr(a, b), 6) AS rank_corr, count_if(a <= 5 AND b <= 5) AS top_overlap FROM rk"),
    "hub_leaderboard": trips(f"{_HUB} SELECT CAST(friction_rank AS INT) AS friction_rank, centre_code, n_legs_out, round(msx, 4) AS median_dwell_share_out, round(mmx, 2) AS median_dwell_min_out FROM hubr WHERE friction_rank <= 20"),
    "hub_corridors": trips(f"{_welch(1)}, {_HUB} SELECT centre_code, round(msx, 6) AS median_dwell_share_out, count(*) AS corridors, round(avg(excess_ratio), 6) AS mean_excess, count_if(excess_ratio > 1.1) AS slow_corridors FROM hubr JOIN welch ON source_center = centre_code WHERE has_support GROUP BY 1, 2"),
}
