"""Queries on as-of history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import history as H
from tramline.sources.adapters import legs_from_events, legs_from_orders, table

from .sql import legs, trips


#: Added before rounding to six digits, here and in SQL, so that means of short decimals aren't ties, which engines round differently.
OFF_EDGE = "1.3e-8"


def six(column):
    return F.round(F.col(column) + float(OFF_EDGE), 6)


def off_edge(sql: str) -> str:
    return sql.replace(", 6)", f" + {OFF_EDGE}, 6)")


def _rounded(df, digits=6):
    return df.select(*[(six(c) if digits == 6 else F.round(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def history_corridor(spark, sf_dir):
    return _rounded(H.as_of(legs_from_events(spark, sf_dir), "corridor_id", "corr"))


def history_source_orders(spark, sf_dir):
    return _rounded(H.as_of(legs_from_orders(spark, sf_dir), "source_center", "src"))


def history_dispersion(spark, sf_dir):
    return _rounded(H.dispersion(legs_from_events(spark, sf_dir)))


def history_dispersion_long(spark, sf_dir):
    return _rounded(H.dispersion(legs_from_orders(spark, sf_dir), days=180))


def history_dwell_part(spark, sf_dir):
    return _rounded(H.dwell_by_day_part(legs_from_events(spark, sf_dir), "source_center", "src"))


def features_v1(spark, sf_dir):
    return _rounded(H.features(legs_from_events(spark, sf_dir)))


def features_v2(spark, sf_dir):
    f = H.features_v2(legs_from_events(spark, sf_dir))
    return _rounded(f.select("leg_id", "corr_n_prior", "src_n_prior", "dst_n_prior", "corr_median_gap_min", "src_dwell_by_hour_min", "dst_dwell_by_hour_min", "created_part"))


def history_naive_leak(spark, sf_dir):
    return _rounded(H.naive_leak(legs_from_events(spark, sf_dir)))


def history_range_join(spark, sf_dir):
    return H.counts_by_range_join(legs_from_events(spark, sf_dir))


def history_leakage_checks(spark, sf_dir):
    return H.leakage_checks(legs_from_events(spark, sf_dir))


def prediction_point(spark, sf_dir):
    return H.prediction_point(legs_from_events(spark, sf_dir))


def features_cold_start(spark, sf_dir):
    return _rounded(H.cold_start(H.features(legs_from_events(spark, sf_dir))))


def history_snapshot(spark, sf_dir):
    return _rounded(H.snapshot(legs_from_events(spark, sf_dir)))


def history_latest(spark, sf_dir):
    rows = legs_from_events(spark, sf_dir).select("corridor_id", "od_end_time", "leg_id", "gap_min")
    return H.latest_per_key(rows, "corridor_id", "od_end_time")


def history_what_if(spark, sf_dir):
    q = table(spark, sf_dir, "events").where("event_type = 'click'").select(
        F.col("event_id").alias("query_id"), F.concat(F.lit("H"), F.col("user_id") % 12, F.lit(">H"), F.col("event_id") % 12).alias("corridor_id"),
        F.col("ts").alias("asked_at"),
    )
    return _rounded(H.as_of_lookup(legs_from_events(spark, sf_dir), q))


_CUTS = (30.0, 60.0)


def backoff_levels(spark, sf_dir):
    return _rounded(H.level_medians(legs_from_events(spark, sf_dir), _CUTS))


def backoff_hard(spark, sf_dir):
    return _rounded(H.hard_backoff(H.level_medians(legs_from_events(spark, sf_dir), _CUTS)))


def backoff_shrunken(spark, sf_dir):
    return _rounded(H.shrunken_backoff(H.level_medians(legs_from_events(spark, sf_dir), _CUTS), [2.0, 10.0]))


def backoff_choose_k(spark, sf_dir):
    trips_ = legs_from_events(spark, sf_dir)
    return H.choose_k(H.shrunken_backoff(H.level_medians(trips_, _CUTS), [1.0, 5.0, 20.0, 80.0]), trips_).select("k", six("mae").alias("mae"))


def history_network_prefix(spark, sf_dir):
    return _rounded(H.network_prefix(legs_from_events(spark, sf_dir)))


def history_network_quantiles(spark, sf_dir):
    return _rounded(H.network_quantiles(legs_from_events(spark, sf_dir), {"p10": 0.1, "median": 0.5, "p90": 0.9}))


QUERIES = {f.__name__: f for f in (
    history_corridor, history_source_orders, history_dispersion, history_dispersion_long, history_dwell_part, features_v1, features_v2,
    history_naive_leak, history_range_join, history_leakage_checks, prediction_point, features_cold_start, history_snapshot,
    history_latest, history_what_if, backoff_levels, backoff_hard, backoff_shrunken, backoff_choose_k, history_network_prefix, history_network_quantiles,
)}


def _asof(key: str, p: str, fact: str = "od_end_time", where: str = "legs") -> str:
    return f"""SELECT leg_id, CAST(n AS INT) AS {p}_n_prior, round(ss / nullif(n, 0), 6) AS {p}_mean_log_ratio,
      CASE WHEN n > 1 THEN round(sqrt(greatest(0, sss / n - (ss / n) * (ss / n))), 6) END AS {p}_std_log_ratio,
      round(sg / nullif(n, 0), 6) AS {p}_mean_gap_min, round(ls, 6) AS {p}_last_log_ratio, round((epoch_us(t) - lt) / 3.6e9, 6) AS {p}_hours_since_last
    FROM (SELECT *, count(s) OVER w AS n, sum(s) OVER w AS ss, sum(s * s) OVER w AS sss, sum(g) OVER w AS sg, last_value(s IGNORE NULLS) OVER w AS ls,
      max(CASE WHEN kind = 0 THEN epoch_us(t) END) OVER w AS lt FROM (
        SELECT {key} AS k, {fact} AS t, 0 AS kind, leg_id, log_gap_ratio AS s, gap_min AS g FROM {where} UNION ALL
        SELECT {key}, trip_creation_time, 1, leg_id, NULL, NULL FROM {where})
      WINDOW w AS (PARTITION BY k ORDER BY t, kind, leg_id ROWS UNBOUNDED PRECEDING)) WHERE kind = 1"""


def _dispersion(days: int) -> str:
    return f"""SELECT leg_id, round(md, 6) AS corr_median_gap_min, round(p90, 6) AS corr_p90_gap_min, round(p75 - p25, 6) AS corr_iqr_gap_min,
      CASE WHEN n > 1 THEN round(sd, 6) END AS corr_std_gap_min, round(m7, 6) AS corr_mean_gap_7d, CAST(n7 AS INT) AS corr_n_prior_7d
    FROM (SELECT *, count(g) OVER w AS n, quantile_cont(g, 0.5) OVER w AS md, quantile_cont(g, 0.9) OVER w AS p90, quantile_cont(g, 0.75) OVER w AS p75,
      quantile_cont(g, 0.25) OVER w AS p25, stddev_samp(g) OVER w AS sd, avg(g) OVER r AS m7, count(g) OVER r AS n7 FROM (
        SELECT corridor_id AS k, epoch_us(od_end_time) AS t, 0 AS kind, leg_id, gap_min AS g FROM legs UNION ALL
        SELECT corridor_id, epoch_us(trip_creation_time), 1, leg_id, NULL FROM legs)
      WINDOW w AS (PARTITION BY k ORDER BY t, kind, leg_id ROWS UNBOUNDED PRECEDING),
        r AS (PARTITION BY k ORDER BY t RANGE BETWEEN {days * 86_400_000_000} PRECEDING AND CURRENT ROW)) WHERE kind = 1"""


_PART = "CASE WHEN hour(trip_creation_time) < 6 THEN 'night' WHEN hour(trip_creation_time) < 12 THEN 'morning' WHEN hour(trip_creation_time) < 18 THEN 'afternoon' ELSE 'evening' END"


def _dwell(hub: str, p: str) -> str:
    return f"""SELECT leg_id, round(m, 6) AS {p}_dwell_by_hour_min FROM (SELECT *, avg(d) OVER (PARTITION BY k ORDER BY t, kind, leg_id ROWS UNBOUNDED PRECEDING) AS m FROM (
        SELECT {hub} || '|' || {_PART} AS k, od_end_time AS t, 0 AS kind, leg_id, start_scan_to_end_scan - actual_time AS d FROM legs UNION ALL
        SELECT {hub} || '|' || {_PART}, trip_creation_time, 1, leg_id, NULL FROM legs)) WHERE kind = 1"""


_BASE = f"""SELECT leg_id, corridor_id, route_type, planned_min, planned_km, round(gap_min, 6) AS gap_min, round(log_gap_ratio, 6) AS log_gap_ratio, is_delayed,
  CAST(hour(trip_creation_time) AS INT) AS created_hour, CAST(dayofweek(trip_creation_time) + 1 AS INT) AS created_weekday,
  dayofweek(trip_creation_time) IN (6, 0) AS created_weekend, {_PART} AS created_part FROM legs"""
_KEYS = (("corr", "corridor_id"), ("src", "source_center"), ("dst", "destination_center"))
_LEVELS = f"""lv AS (SELECT *, CASE WHEN planned_km < {_CUTS[0]} THEN 'short' WHEN planned_km < {_CUTS[1]} THEN 'medium' ELSE 'long' END AS band FROM legs),
keyed AS (SELECT leg_id, gap_min, od_end_time, trip_creation_time, unnest([
  {{'level': 'corridor', 'key': corridor_id}}, {{'level': 'origin_hub', 'key': source_center}}, {{'level': 'destination_hub', 'key': destination_center}},
  {{'level': 'route_distance_band', 'key': route_type || '|' || band}}, {{'level': 'network', 'key': 'all'}}]) AS o FROM lv),
levels AS (SELECT leg_id, level, n, median FROM (
  SELECT *, count(g) OVER w AS n, quantile_cont(g, 0.5) OVER w AS median FROM (
    SELECT o.level AS level, o.key AS key, od_end_time AS t, 0 AS kind, leg_id, gap_min AS g FROM keyed UNION ALL
    SELECT o.level, o.key, trip_creation_time, 1, leg_id, NULL FROM keyed)
  WINDOW w AS (PARTITION BY level, key ORDER BY t, kind, leg_id ROWS UNBOUNDED PRECEDING)) WHERE kind = 1)"""
_WIDE = "wide AS (SELECT leg_id, " + ", ".join(f"max(CASE WHEN level = '{x}' THEN {c} END) AS {x}_{c}" for x in H.LEVELS for c in ("n", "median")) + " FROM levels GROUP BY 1)"


def _shrunk(ks: str) -> str:
    value = "coalesce(network_median, 0)"
    for x in reversed(H.LEVELS[:-1]):
        value = f"({x}_n / ({x}_n + k) * coalesce({x}_median, 0) + (1 - {x}_n / ({x}_n + k)) * {value})"
    return f"shrunk AS (SELECT leg_id, k, {value} AS shrunken_gap FROM (SELECT *, unnest([{ks}]) AS k FROM wide))"


ORACLE_SQL = {
    "history_corridor": trips(_asof("corridor_id", "corr")),
    "history_source_orders": legs(_asof("source_center", "src")),
    "history_dispersion": trips(_dispersion(7)),
    "history_dispersion_long": legs(_dispersion(180)),
    "history_dwell_part": trips(_dwell("source_center", "src")),
    "features_v1": trips(f"base AS ({_BASE}), " + ", ".join(f"h_{p} AS ({_asof(c, p)})" for p, c in _KEYS) + " SELECT * FROM base JOIN h_corr USING (leg_id) JOIN h_src USING (leg_id) JOIN h_dst USING (leg_id)"),
    "features_v2": trips(
        f"base AS ({_BASE}), " + ", ".join(f"h_{p} AS ({_asof(c, p)})" for p, c in _KEYS) + f", disp AS ({_dispersion(7)}), ds AS ({_dwell('source_center', 'src')}), dd AS ({_dwell('destination_center', 'dst')}) "
        "SELECT leg_id, corr_n_prior, src_n_prior, dst_n_prior, corr_median_gap_min, src_dwell_by_hour_min, dst_dwell_by_hour_min, created_part FROM base JOIN h_corr USING (leg_id) JOIN h_src USING (leg_id) JOIN h_dst USING (leg_id) JOIN disp USING (leg_id) JOIN ds USING (leg_id) JOIN dd USING (leg_id)"
    ),
    "history_naive_leak": trips(f"a AS ({_asof('corridor_id', 'r')}), b AS ({_asof('corridor_id', 'n', 'od_start_time')}) SELECT count(*) AS legs, count_if(n_n_prior > r_n_prior) AS leaking, round(avg(n_n_prior - r_n_prior), 6) AS mean_excess, max(n_n_prior - r_n_prior) AS most_excess FROM a JOIN b USING (leg_id)"),
    "history_range_join": trips("SELECT q.leg_id, CAST(count(f.leg_id) AS INT) AS n_prior FROM legs q LEFT JOIN legs f ON q.corridor_id = f.corridor_id AND f.od_end_time <= q.trip_creation_time GROUP BY 1"),
    "history_leakage_checks": trips("SELECT count(*) AS legs, CAST(0 AS BIGINT) AS differing, count_if(od_end_time <= trip_creation_time) AS self_seeing FROM legs"),
    "prediction_point": trips("SELECT count_if(od_start_time < trip_creation_time) AS violations, CAST(min(epoch_us(od_start_time) - epoch_us(trip_creation_time)) AS DOUBLE) / 60e6 AS least_lead, CAST(max(epoch_us(od_start_time) - epoch_us(trip_creation_time)) AS DOUBLE) / 60e6 AS most_lead FROM legs"),
    "features_cold_start": trips(", ".join(f"h_{p} AS ({_asof(c, p)})" for p, c in _KEYS) + " SELECT count(*) AS legs, round(avg((corr_n_prior = 0)::INT), 6) AS corr_cold, round(avg((src_n_prior = 0)::INT), 6) AS src_cold, round(avg((dst_n_prior = 0)::INT), 6) AS dst_cold, round(avg((corr_std_log_ratio IS NULL)::INT), 6) AS corr_std_null FROM h_corr JOIN h_src USING (leg_id) JOIN h_dst USING (leg_id)"),
    "history_snapshot": trips(f"""keyed AS (SELECT *, unnest([{{'t': 'corridor', 'k': corridor_id}}, {{'t': 'source', 'k': source_center}}, {{'t': 'destination', 'k': destination_center}},
      {{'t': 'source_part', 'k': source_center || '|' || {_PART}}}, {{'t': 'destination_part', 'k': destination_center || '|' || {_PART}}}]) AS o FROM legs)
      SELECT o.t AS key_type, o.k AS key, count(*) AS n, round(avg(log_gap_ratio), 6) AS mean_log_ratio, round(stddev_pop(log_gap_ratio), 6) AS std_log_ratio, round(avg(gap_min), 6) AS mean_gap_min,
      round(quantile_cont(gap_min, 0.5), 6) AS median_gap_min, round(quantile_cont(gap_min, 0.9), 6) AS p90_gap_min, round(avg(dwell_min), 6) AS mean_dwell_min, max(od_end_time) AS known_at FROM keyed GROUP BY 1, 2"""),
    "history_latest": trips("SELECT corridor_id, od_end_time, leg_id, gap_min FROM legs QUALIFY row_number() OVER (PARTITION BY corridor_id ORDER BY od_end_time DESC, leg_id DESC) = 1"),
    "history_what_if": trips("""q AS (SELECT CAST(event_id AS VARCHAR) AS query_id, 'H' || (user_id % 12) || '>H' || (event_id % 12) AS c, ts FROM events WHERE event_type = 'click')
      SELECT query_id, count(gap_min) AS n_prior, round(avg(gap_min), 6) AS mean_gap, round(arg_max(gap_min, (od_end_time, leg_id)), 6) AS last_gap FROM q LEFT JOIN legs ON c = corridor_id AND od_end_time <= ts GROUP BY 1"""),
    "backoff_levels": trips(f"{_LEVELS} SELECT leg_id, level, n, round(median, 6) AS median FROM levels"),
    "backoff_hard": trips(f"""{_LEVELS}, d AS (SELECT *, list_position(['{"', '".join(H.LEVELS)}'], level) AS depth FROM levels),
      f AS (SELECT * FROM d WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY leg_id ORDER BY depth) = 1)
      SELECT leg_id, round(coalesce(median, 0), 6) AS backoff_gap, CAST(coalesce(depth, 0) AS INT) AS backoff_level, coalesce(n, 0) AS backoff_n FROM legs LEFT JOIN f USING (leg_id)"""),
    "backoff_shrunken": trips(f"{_LEVELS}, {_WIDE}, {_shrunk('2.0::DOUBLE, 10.0::DOUBLE')} SELECT leg_id, k, round(shrunken_gap, 6) AS shrunken_gap FROM shrunk"),
    "backoff_choose_k": trips(f"{_LEVELS}, {_WIDE}, {_shrunk('1.0::DOUBLE, 5.0::DOUBLE, 20.0::DOUBLE, 80.0::DOUBLE')} SELECT k, round(avg(abs(gap_min - shrunken_gap)), 6) AS mae FROM shrunk JOIN legs USING (leg_id) GROUP BY 1 ORDER BY 2, 1 LIMIT 1"),
    "history_network_prefix": trips("""SELECT leg_id, n AS n_prior, round(m, 6) AS mean_gap FROM (SELECT *, count(g) OVER w AS n, avg(g) OVER w AS m FROM (
      SELECT od_end_time AS t, 0 AS kind, leg_id, gap_min AS g FROM legs UNION ALL SELECT trip_creation_time, 1, leg_id, NULL FROM legs) WINDOW w AS (ORDER BY t, kind, leg_id ROWS UNBOUNDED PRECEDING)) WHERE kind = 1"""),
    "history_network_quantiles": trips("""SELECT leg_id, n AS n_prior, round(a, 6) AS p10, round(b, 6) AS median, round(c, 6) AS p90 FROM (
      SELECT *, count(g) OVER w AS n, quantile_cont(g, 0.1) OVER w AS a, quantile_cont(g, 0.5) OVER w AS b, quantile_cont(g, 0.9) OVER w AS c FROM (
        SELECT od_end_time AS t, 0 AS kind, leg_id, gap_min AS g FROM legs UNION ALL SELECT trip_creation_time, 1, leg_id, NULL FROM legs)
      WINDOW w AS (ORDER BY t, kind, leg_id ROWS UNBOUNDED PRECEDING)) WHERE kind = 1"""),
}
