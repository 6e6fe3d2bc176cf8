"""DuckDB SQL of the queries in ``tables``."""

from __future__ import annotations


from .history import _KEYS, _PART, _asof, _dispersion
from .network import _HUB, _welch
from .sql import legs, trips
from .stats import _CH

_N = "('', 'nan', 'NaN', 'NAN', 'null', 'NULL', 'None', 'NA', 'N/A', '-')"
_RAW = """raw AS (SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS source_row_index,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END AS trip_uuid,
  'IND' || (l_suppkey % 90 + 10) || '0001AAA' AS source_center, 'IND' || (l_partkey % 90 + 10) || '0001AAA' AS destination_center,
  CASE WHEN l_partkey % 7 = 2 THEN 'Town' || (l_suppkey % 9) || '_Hub_D (Goa)' END AS source_name, NULL::VARCHAR AS destination_name, o_orderdate AS od_start_time,
  CASE WHEN l_partkey % 7 = 3 THEN NULL ELSE date_trunc('second', l_shipdate) END AS od_end_time, l_quantity AS osrm_time, l_extendedprice / 1000 - 2 AS actual_time,
  l_extendedprice / 1000 - 10 AS segment_actual_time, CASE WHEN l_partkey % 7 = 4 THEN 0.0 ELSE l_quantity END AS segment_osrm_time, l_partkey % 7 AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_VOTES = "votes AS (SELECT source_center AS centre_code, source_name AS best_name FROM (SELECT source_center, source_name, count(*) AS n FROM raw WHERE source_name IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source_center ORDER BY n DESC, source_name) = 1)"


def _state(code: str) -> str:
    """State by PIN digits, written out here apart from the operator's own table."""
    pin = f"TRY_CAST(substr({code}, 4, 2) AS INT)"
    return f"""CASE {pin}
      WHEN 11 THEN 'Delhi'
      WHEN 12 THEN 'Haryana' WHEN 13 THEN 'Haryana'
      WHEN 14 THEN 'Punjab' WHEN 15 THEN 'Punjab' WHEN 16 THEN 'Punjab'
      WHEN 17 THEN 'Himachal Pradesh'
      WHEN 18 THEN 'Jammu and Kashmir' WHEN 19 THEN 'Jammu and Kashmir'
      WHEN 20 THEN 'Uttar Pradesh' WHEN 21 THEN 'Uttar Pradesh' WHEN 22 THEN 'Uttar Pradesh' WHEN 23 THEN 'Uttar Pradesh' WHEN 24 THEN 'Uttar Pradesh' WHEN 25 THEN 'Uttar Pradesh' WHEN 26 THEN 'Uttar Pradesh' WHEN 27 THEN 'Uttar Pradesh' WHEN 28 THEN 'Uttar Pradesh'
      WHEN 30 THEN 'Rajasthan' WHEN 31 THEN 'Rajasthan' WHEN 32 THEN 'Rajasthan' WHEN 33 THEN 'Rajasthan' WHEN 34 THEN 'Rajasthan'
      WHEN 36 THEN 'Gujarat' WHEN 37 THEN 'Gujarat' WHEN 38 THEN 'Gujarat' WHEN 39 THEN 'Gujarat'
      WHEN 40 THEN 'Maharashtra' WHEN 41 THEN 'Maharashtra' WHEN 42 THEN 'Maharashtra' WHEN 43 THEN 'Maharashtra' WHEN 44 THEN 'Maharashtra'
      WHEN 45 THEN 'Madhya Pradesh' WHEN 46 THEN 'Madhya Pradesh' WHEN 47 THEN 'Madhya Pradesh' WHEN 48 THEN 'Madhya Pradesh'
      WHEN 49 THEN 'Chhattisgarh'
      WHEN 50 THEN 'Telangana' WHEN 51 THEN 'Telangana'
      WHEN 52 THEN 'Andhra Pradesh' WHEN 53 THEN 'Andhra Pradesh'
      WHEN 56 THEN 'Karnataka' WHEN 57 THEN 'Karnataka' WHEN 58 THEN 'Karnataka' WHEN 59 THEN 'Karnataka'
      WHEN 60 THEN 'Tamil Nadu' WHEN 61 THEN 'Tamil Nadu' WHEN 62 THEN 'Tamil Nadu' WHEN 63 THEN 'Tamil Nadu' WHEN 64 THEN 'Tamil Nadu'
      WHEN 67 THEN 'Kerala' WHEN 68 THEN 'Kerala' WHEN 69 THEN 'Kerala'
      WHEN 70 THEN 'West Bengal' WHEN 71 THEN 'West Bengal' WHEN 72 THEN 'West Bengal' WHEN 73 THEN 'West Bengal' WHEN 74 THEN 'West Bengal'
      WHEN 75 THEN 'Odisha' WHEN 76 THEN 'Odisha' WHEN 77 THEN 'Odisha'
      WHEN 78 THEN 'Assam'
      WHEN 79 THEN 'North Eastern States'
      WHEN 80 THEN 'Bihar' WHEN 81 THEN 'Bihar' WHEN 82 THEN 'Bihar' WHEN 83 THEN 'Bihar' WHEN 84 THEN 'Bihar' WHEN 85 THEN 'Bihar'
      END"""


_BAD = {
    "null_trip_uuid": "trip_uuid IS NULL", "null_centre_code": "source_center IS NULL OR destination_center IS NULL",
    "unparseable_od_window": "od_start_time IS NULL OR od_end_time IS NULL", "inverted_od_window": "od_end_time < od_start_time",
    "nonpositive_osrm_time": "osrm_time IS NULL OR osrm_time <= 0", "nonpositive_actual_time": "actual_time IS NULL OR actual_time <= 0",
}
_KEEP = " AND ".join(f"NOT coalesce({r}, true)" for r in _BAD.values())


def _profile(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count_if({c} IS NULL) AS DOUBLE) AS nulls, CAST(count(DISTINCT {c}) AS DOUBLE) AS "distinct", CAST(min({c}) AS DOUBLE) AS "min", round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS median,
        round(quantile_cont({c}, 0.75), 4) AS p75, round(quantile_cont({c}, 0.99), 4) AS p99, CAST(max({c}) AS DOUBLE) AS "max", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(count_if({c} <= 0) AS DOUBLE) AS nonpositive FROM {table}"""
        for c in columns
    )


_ALERTS = f"""hist AS ({_asof('corridor_id', 'corr')}),
al AS (SELECT l.*, g.predicted_gap, 0.3 * planned_min AS threshold_gap, g.predicted_gap / (0.3 * planned_min) AS alert_excess, planned_min + g.predicted_gap AS predicted_total_min, trip_creation_time AS alerted_at
  FROM legs l JOIN (SELECT leg_id, m AS predicted_gap FROM (SELECT *, avg(g) OVER (PARTITION BY k ORDER BY t, kind, leg_id ROWS UNBOUNDED PRECEDING) AS m FROM (
    SELECT corridor_id AS k, od_end_time AS t, 0 AS kind, leg_id, gap_min AS g FROM legs UNION ALL SELECT corridor_id, trip_creation_time, 1, leg_id, NULL FROM legs)) WHERE kind = 1) g USING (leg_id)
  WHERE g.predicted_gap > 0.3 * planned_min)"""
_GRADED = f"""{_ALERTS}, gr AS (SELECT al.*, s.c IS NOT NULL AS confirmed_slow, ['low', 'medium', 'high', 'critical'][least((CASE WHEN alert_excess >= 3 THEN 3 WHEN alert_excess >= 2 THEN 2 WHEN alert_excess >= 1.3 THEN 1 ELSE 0 END) + (s.c IS NOT NULL)::INT, 3) + 1] AS severity
  FROM al LEFT JOIN (SELECT 'H' || n_nationkey || '>H3' AS c FROM nation WHERE n_nationkey < 12 AND n_nationkey % 2 = 0) s ON corridor_id = s.c)"""
_INV = """inv AS (SELECT o_orderkey AS invoice_id, 'INV' || (o_orderkey % 14000) AS invoice_number, o_orderdate AS received_at, o_custkey % 25 AS c, CASE WHEN o_orderstatus = 'F' THEN 'FTL' ELSE 'Carting' END AS route_type,
  CAST(o_custkey % 900 + 100 AS DOUBLE) AS kg, round(o_totalprice / 100, 2) AS freight, round(o_totalprice / 100 * (o_orderkey % 25) / 100, 2) AS other, CASE WHEN o_orderkey % 50 = 0 THEN 1.0 ELSE 0.0 END AS extra, CASE WHEN o_orderkey % 97 = 0 THEN 'USD' ELSE 'INR' END AS currency FROM orders)"""


def _invoices(skip: str) -> str:
    return f"""{_INV}, band AS (SELECT inv.*, row_number() OVER (PARTITION BY invoice_number ORDER BY received_at, invoice_id) AS n, CASE WHEN {skip} THEN CAST(c * 2 + 10 AS DOUBLE) END AS km FROM inv),
    lim AS (SELECT *, round((CASE WHEN route_type = 'FTL' THEN km * 28.0 ELSE km * kg / 1000 * 6.0 + kg * 2.0 END) * 0.85, 2) AS low, round((CASE WHEN route_type = 'FTL' THEN km * 45.0 ELSE km * kg / 1000 * 10.0 + kg * 4.0 END) * 1.15, 2) AS high FROM band),
    fnd AS (SELECT invoice_id, route_type, concat_ws(';', CASE WHEN abs(round(freight + other, 2) - (freight + other + extra)) > 0.01 THEN 'total_mismatch' END, CASE WHEN freight > high THEN 'rate_above_band' END, CASE WHEN freight < low THEN 'rate_below_band' END,
      CASE WHEN freight > 0 AND NOT (other / freight BETWEEN 0.04 AND 0.19) THEN 'other_charges_out_of_band' END, CASE WHEN n > 1 THEN 'duplicate_invoice_number' END, CASE WHEN currency <> 'INR' THEN 'unexpected_currency' END) AS findings FROM lim)"""


_Z = 1.959963984540054
_W = f"round(greatest(0, (p + {_Z}**2 / (2 * n)) / (1 + {_Z}**2 / n) - {_Z} * sqrt(p * (1 - p) / n + {_Z}**2 / (4.0 * n * n)) / (1 + {_Z}**2 / n)), 6) AS low, round(least(1, (p + {_Z}**2 / (2 * n)) / (1 + {_Z}**2 / n) + {_Z} * sqrt(p * (1 - p) / n + {_Z}**2 / (4.0 * n * n)) / (1 + {_Z}**2 / n)), 6) AS high"
_CODE = "'IND' || lpad(CAST({0} % 800000 + 100000 AS VARCHAR), 6, '0') || 'AAB'"
_ORDERS = f"""od AS (SELECT *, CASE WHEN consignments > 1 THEN 'consignment' WHEN weight_kg IS NULL THEN 'weight_kg' WHEN source_center = destination_center THEN 'destination_center' WHEN route_type IS NULL THEN 'route_type'
    WHEN customer_name IS NULL THEN 'customer_name' END AS ask_for FROM (SELECT o_orderkey AS mail_id, {_CODE.format('o_custkey')} AS source_center, {_CODE.format('o_orderkey')} AS destination_center,
  CASE WHEN o_orderkey % 6 = 3 THEN 'FTL' WHEN o_orderkey % 6 = 4 THEN NULL ELSE 'Carting' END AS route_type,
  CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 2500.0 WHEN 2 THEN 99.0 ELSE CAST(o_custkey % 900 + 1 AS DOUBLE) END AS weight_kg,
  CASE WHEN o_orderkey % 17 = 0 THEN 25 ELSE o_orderkey % 40 + 1 END AS pieces, CASE WHEN o_orderkey % 11 <> 0 THEN 'Acme Traders' END AS customer_name,
  CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 1 END AS consignments, CAST(NULL AS VARCHAR) AS notes FROM orders))"""
_NEAR = "u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), nn AS (SELECT q.vec_id, b.vec_id AS b_id, q.label = b.label AS same, list_cosine_similarity(q.v, b.v) AS s FROM u q JOIN u b ON q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id)"
_FEATS = ", ".join(f"h_{p} AS ({_asof(c, p)})" for p, c in _KEYS)
_BASES = f"""hh AS (SELECT leg_id, n, m, ml FROM (SELECT *, count(g) OVER w AS n, avg(g) OVER w AS m, avg(s) OVER w AS ml FROM (
    SELECT corridor_id AS k, od_end_time AS t, 0 AS kind, leg_id, gap_min AS g, log_gap_ratio AS s FROM legs UNION ALL SELECT corridor_id, trip_creation_time, 1, leg_id, NULL, NULL FROM legs)
    WINDOW w AS (PARTITION BY k ORDER BY t, kind, leg_id ROWS UNBOUNDED PRECEDING)) WHERE kind = 1),
  fx AS (SELECT legs.*, n AS corr_n_prior, m, ml, {_PART} AS created_part FROM legs JOIN hh USING (leg_id)),
  pr AS (SELECT *, 'plan' AS model, 0.0::DOUBLE AS predicted FROM fx UNION ALL SELECT *, 'asof_mean', coalesce(m, 0) FROM fx UNION ALL SELECT *, 'asof_ratio', coalesce((exp(ml) - 1) * planned_min, 0) FROM fx)"""
_MET = "SELECT model, count(*) AS n, round(avg(abs(gap_min - predicted)), 6) AS mae, round(sqrt(avg((gap_min - predicted) ** 2)), 6) AS rmse, round(avg(gap_min - predicted), 6) AS bias, round(quantile_cont(abs(gap_min - predicted), 0.5), 6) AS median_error FROM pr GROUP BY 1"
_SPLIT = "cutp AS (SELECT quantile_cont(CAST(epoch_us(trip_creation_time) AS DOUBLE), 0.8) AS c FROM legs), sp AS (SELECT legs.*, CASE WHEN epoch_us(trip_creation_time) <= c THEN 'train' ELSE 'test' END AS part FROM legs, cutp)"
_EV = """evs AS (SELECT 'q:' || leg_id AS event_id, 'query' AS kind, leg_id, trip_creation_time AS event_time, corridor_id, source_center, destination_center, CAST(hour(trip_creation_time) AS INT) AS created_hour, planned_min, NULL::DOUBLE AS gap_min, NULL::DOUBLE AS log_gap_ratio, NULL::DOUBLE AS dwell_min FROM legs
  UNION ALL SELECT 'f:' || leg_id, 'fact', leg_id, od_end_time, corridor_id, source_center, destination_center, CAST(hour(trip_creation_time) AS INT), planned_min, gap_min, log_gap_ratio, dwell_min FROM legs)"""


def _mean(key: str, p: str) -> str:
    return f"""h_{p} AS (SELECT leg_id, n AS {p}_n_prior, m, md, d FROM (SELECT *, count(g) OVER w AS n, avg(g) OVER w AS m, quantile_cont(g, 0.5) OVER w AS md, avg(dw) OVER w AS d FROM (
      SELECT {key} AS k, od_end_time AS t, 0 AS kind, leg_id, gap_min AS g, dwell_min AS dw FROM legs UNION ALL SELECT {key}, trip_creation_time, 1, leg_id, NULL, NULL FROM legs) WINDOW w AS (PARTITION BY k ORDER BY t, kind, leg_id ROWS UNBOUNDED PRECEDING)) WHERE kind = 1)"""


_STREAM = (("corridor_id", "corr"), ("source_center", "src"), ("destination_center", "dst"), (f"source_center || '|' || {_PART}", "sp"), (f"destination_center || '|' || {_PART}", "dp"))
#: Predicted by the corridor's median from five facts on, else the source's mean; flagged beyond twice the plan.
_STREAM_ALERTS = f"""{_mean("corridor_id", "corr")}, {_mean("source_center", "src")},
  fc AS (SELECT legs.leg_id, corridor_id, planned_min, coalesce(CASE WHEN corr_n_prior >= 5 THEN h_corr.md END, h_src.m, 0.0) AS predicted
    FROM legs JOIN h_corr USING (leg_id) JOIN h_src USING (leg_id)),
  al AS (SELECT * FROM fc WHERE predicted > planned_min)"""

_ALERT_LINES = """al AS (SELECT CAST(event_id % 700 AS VARCHAR) AS alert_id, ts AS alerted_at, CASE WHEN event_id % 13 <> 0 THEN 'H' || (event_id % 12) END AS corridor_id, value AS predicted_gap,
  CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN 'bad' WHEN event_id % 23 = 0 THEN 'blank' ELSE 'good' END AS state FROM events)"""
_MEDIANS = f"""{_BASES}, {_mean("corridor_id", "md")}, pm AS (SELECT * FROM pr UNION ALL SELECT fx.*, 'asof_median', coalesce(h_md.md, 0) FROM fx JOIN h_md USING (leg_id))"""


ORACLE_SQL = {
    "clean_null_texts": """SELECT * FROM (SELECT 'trip_uuid' AS "column", count_if(l_partkey % 7 = 0) AS n FROM lineitem UNION ALL SELECT 'source_name', count_if(l_partkey % 7 <> 2) FROM lineitem UNION ALL SELECT 'destination_name', count(*) FROM lineitem) WHERE n > 0""",
    "clean_parse_failures": "SELECT CAST(0 AS BIGINT) AS od_start_time, count_if(l_partkey % 7 = 3) AS od_end_time FROM lineitem",
    "clean_drop_counts": f"WITH {_RAW} SELECT " + ", ".join(f"count_if({r}) AS {n}" for n, r in _BAD.items()) + f", count_if({_KEEP}) AS kept FROM raw",
    "clean_segments": f"""WITH {_RAW}, {_VOTES}, r AS (SELECT raw.* REPLACE (coalesce(source_name, v.best_name) AS source_name, w.best_name AS destination_name) FROM raw LEFT JOIN votes v ON source_center = v.centre_code LEFT JOIN votes w ON destination_center = w.centre_code WHERE {_KEEP}),
      d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY trip_uuid, source_center, destination_center, source_name, od_start_time, od_end_time, osrm_time, actual_time, segment_actual_time, segment_osrm_time ORDER BY source_row_index) = 1)
      SELECT source_row_index, source_center || '>' || destination_center AS corridor_id, source_name, nullif(regexp_extract(source_name, '^([^_]+)_', 1), '') AS source_city, coalesce(nullif(regexp_extract(source_name, '\\(([^)]+)\\)\\s*$', 1), ''), {_state('source_center')}) AS source_state,
      coalesce(nullif(regexp_extract(destination_name, '\\(([^)]+)\\)\\s*$', 1), ''), {_state('destination_center')}) AS dest_state, (source_name IS NULL AND {_state('source_center')} IS NOT NULL) OR (destination_name IS NULL AND {_state('destination_center')} IS NOT NULL) AS state_from_pin, segment_actual_time <= 0 OR segment_osrm_time = 0 AS is_suspect,
      round(CASE WHEN segment_osrm_time > 0 THEN segment_actual_time / segment_osrm_time END, 6) AS segment_factor, round((epoch_us(od_end_time) - epoch_us(od_start_time)) / 60e6, 6) AS od_duration_min FROM d""",
    "clean_name_votes": f"WITH {_RAW}, {_VOTES} SELECT * FROM votes",
    "clean_report": legs("SELECT count(*) AS rows, count(DISTINCT corridor_id) AS corridor_id_distinct, count(DISTINCT trip_uuid) AS trip_uuid_distinct, min(planned_min) AS planned_min_min, max(planned_min) AS planned_min_max, count_if(planned_min IS NULL) AS planned_min_nulls, round(min(gap_min), 6) AS gap_min_min, round(max(gap_min), 6) AS gap_min_max, count_if(gap_min IS NULL) AS gap_min_nulls FROM legs"),
    "profile_orders": _profile("orders", ["o_totalprice", "o_custkey"]),
    "profile_documents": _profile("documents", ["n_chars"]),
    "profile_top_values": """WITH v AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)
      SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS LAST) AS INT) AS place FROM v QUALIFY place <= 3""",
    "profile_histogram": legs("b AS (SELECT least(25, greatest(1, CAST(floor(least(greatest(gap_ratio, 0), 5) / 0.2) AS BIGINT) + 1)) AS bin FROM legs) SELECT t.bin, count(b.bin) AS n FROM range(1, 26) t(bin) LEFT JOIN b ON b.bin = t.bin GROUP BY 1"),
    "threshold_sensitivity": legs("g AS (SELECT *, unnest([1.1::DOUBLE, 1.25::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE]) AS threshold FROM legs) SELECT threshold, route, count(*) AS legs, round(avg((gap_min > (threshold - 1) * planned_min)::INT), 6) AS delayed_share FROM (SELECT *, unnest([NULL, route_type]) AS route FROM g) GROUP BY 1, 2"),
    "corridor_support": legs("SELECT n AS n_legs, count(*) AS corridors FROM (SELECT count(*) AS n FROM legs GROUP BY corridor_id) GROUP BY 1"),
    "contract_orders": "SELECT 'orders' AS contract, 1 AS version, count(*) AS rows, CAST(count(*) - count(DISTINCT o_orderkey) AS BIGINT) AS repeated_keys, CAST(count_if(o_orderkey IS NULL) AS BIGINT) AS null_keys, 'missing o_clerk;extra o_orderpriority' AS breaches FROM orders",
    "alerts_flagged": trips(f"{_ALERTS} SELECT leg_id, corridor_id, source_center, destination_center, planned_min, round(predicted_gap, 6) AS predicted_gap, round(threshold_gap, 6) AS threshold_gap, round(alert_excess, 6) AS alert_excess, round(predicted_total_min, 6) AS predicted_total_min, alerted_at FROM al"),
    "alerts_graded": trips(f"{_GRADED} SELECT leg_id, confirmed_slow, severity FROM gr"),
    "alerts_rollup": trips(f"{_ALERTS} SELECT corridor_id, count(*) AS alerts, round(quantile_cont(predicted_gap - threshold_gap, 0.5), 6) AS median_beyond_min, round(max(predicted_gap - threshold_gap), 6) AS most_beyond_min, max(alerted_at) AS latest FROM al GROUP BY 1"),
    "alerts_quality": trips(f"{_ALERTS} SELECT count(a.leg_id) AS alerts, count_if(a.leg_id IS NOT NULL AND l.is_delayed) AS tp, round(count_if(a.leg_id IS NOT NULL AND l.is_delayed) / count(a.leg_id), 6) AS precision, round(count_if(a.leg_id IS NOT NULL AND l.is_delayed) / count_if(l.is_delayed), 6) AS recall, round(avg(abs(a.predicted_gap - l.gap_min)), 6) AS mae FROM legs l LEFT JOIN al a USING (leg_id)"),
    "alerts_policy": trips(f"""{_GRADED}, t AS (SELECT severity, list_position(['low', 'medium', 'high', 'critical'], severity) AS level, count(*) AS n, count_if(is_delayed) AS hits FROM gr GROUP BY 1),
      c AS (SELECT *, CAST(sum(n) OVER (ORDER BY level DESC) AS BIGINT) AS alerts, CAST(sum(hits) OVER (ORDER BY level DESC) AS BIGINT) AS tp FROM t) SELECT severity, n, hits, alerts, tp, round(tp / alerts, 6) AS precision, round(tp / (SELECT count_if(is_delayed) FROM legs), 6) AS recall FROM c"""),
    "alerts_shortlist": trips(f"{_ALERTS}, r AS (SELECT leg_id, round(alert_excess, 6) AS alert_excess FROM al) SELECT * FROM r WHERE CAST(leg_id AS BIGINT) % 3 <> 0 ORDER BY alert_excess DESC, leg_id LIMIT 25"),
    "alerts_shortlist_counts": trips(f"{_ALERTS} SELECT count(*) AS alerts, count_if(CAST(leg_id AS BIGINT) % 3 = 0) AS seen, count_if(CAST(leg_id AS BIGINT) % 3 <> 0) AS fresh, CAST(greatest(0, count_if(CAST(leg_id AS BIGINT) % 3 <> 0) - 25) AS BIGINT) AS capped FROM al"),
    "alerts_investigated": trips(f"""{_ALERTS}, {_welch(1)}, {_HUB}, op AS (SELECT corridor_id, arg_min(leg_id, (trip_creation_time, leg_id)) AS open_shipment FROM legs WHERE schedule NOT IN ('error', 'view') GROUP BY 1)
      SELECT al.leg_id, round(w.excess_ratio, 6) AS excess_ratio, CASE WHEN w.excess_ratio >= 1 THEN 'worse' ELSE 'better' END AS direction, CAST(a.friction_rank AS INT) AS source_friction_rank, CAST(b.friction_rank AS INT) AS destination_friction_rank, op.open_shipment
      FROM al LEFT JOIN welch w ON w.corridor_id = al.corridor_id LEFT JOIN hubr a ON a.centre_code = al.source_center LEFT JOIN hubr b ON b.centre_code = al.destination_center LEFT JOIN op ON op.corridor_id = al.corridor_id"""),
    "alerts_newest": "SELECT CAST(event_id % 500 AS VARCHAR) AS alert_id, ts AS alerted_at, event_id, value FROM events WHERE value < 20 QUALIFY row_number() OVER (PARTITION BY event_id % 500 ORDER BY ts DESC, value DESC, event_id DESC) = 1",
    "alerts_same": trips(f"{_ALERTS} SELECT count_if(CAST(leg_id AS BIGINT) % 5 <> 0) AS both, count_if(CAST(leg_id AS BIGINT) % 5 = 0) AS only_first, CAST(0 AS BIGINT) AS only_second, 0.5::DOUBLE AS most FROM al"),
    "invoices_audited": f"WITH {_invoices('c <> 7')} SELECT invoice_id, findings, CASE WHEN findings <> '' THEN 'dispute' ELSE 'approve' END AS verdict FROM fnd",
    "invoices_scored": f"""WITH {_invoices('true')}, t AS (SELECT route_type AS kind, count(*) AS n, count_if((findings <> '') = (invoice_id % 50 = 0)) AS "right", count_if(invoice_id % 50 <> 0) AS approve_all FROM fnd GROUP BY 1)
      SELECT kind, n, "right", approve_all, {_W} FROM (SELECT *, "right" / n AS p FROM t)""",
    "orders_read": f"""WITH {_ORDERS} SELECT *, CASE WHEN ask_for IS NULL THEN 'file' ELSE 'clarify' END AS outcome FROM od""",
    "orders_problems": f"""WITH {_ORDERS}, c AS (SELECT DISTINCT {_CODE.format('o_custkey')} AS code FROM orders WHERE o_orderkey % 2 = 0)
      SELECT mail_id, concat_ws(';', CASE WHEN weight_kg IS NULL THEN 'missing weight_kg' END, CASE WHEN route_type IS NULL THEN 'missing route_type' END, CASE WHEN customer_name IS NULL THEN 'missing customer_name' END,
        CASE WHEN source_center NOT IN (SELECT code FROM c) THEN 'unknown source' END, CASE WHEN destination_center NOT IN (SELECT code FROM c) THEN 'unknown destination' END,
        CASE WHEN source_center = destination_center THEN 'same ends' END) AS problems FROM od""",
    "orders_scored": f"""WITH {_ORDERS}, t AS (SELECT mail_id, mail_id % 6 AS kind, mail_id % 6 IN (3, 5) AS f, ask_for, mail_id % 6 IN (3, 5) AND (mail_id % 19 = 0 OR customer_name IS NULL) AS named,
        greatest(1, 0.005 * (weight_kg + mail_id % 3)) < mail_id % 3 AS heavy FROM od),
      u AS (SELECT *, CASE WHEN f THEN ask_for IS NULL AND NOT named AND NOT heavy ELSE coalesce(ask_for = CASE WHEN kind = 4 THEN 'route_type' ELSE 'weight_kg' END, false) END AS success, ask_for IS NOT NULL AS asked FROM t)
      SELECT kind, count(*) AS n, round(avg(success::INT), 6) AS success_rate, round(avg(asked::INT), 6) AS clarify_rate, round(avg((NOT f)::INT), 6) AS expected_clarify_rate, round(avg(success::INT) FILTER (f), 6) AS file_success,
        round(avg(success::INT) FILTER (NOT f), 6) AS clarify_success, round(avg(asked::INT) FILTER (NOT f), 6) AS clarify_recall, round(avg((NOT f)::INT) FILTER (asked), 6) AS clarify_precision,
        count_if(NOT f AND NOT asked) AS invented, count_if(f AND asked) AS needless, 0 AS failed FROM u GROUP BY 1""",
    "text_similarity": "SELECT o_orderkey, round(1 - levenshtein(o_orderpriority, o_orderstatus) / greatest(length(o_orderpriority), length(o_orderstatus)), 6) AS similarity FROM orders",
    "entities_listing": "SELECT * FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urgent') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "entities_lifecycle": """SELECT event_id AS seq, b AS before, concat_ws(';', CASE WHEN b = 'purchase' THEN 'after final status' END, CASE WHEN b = event_type THEN 'unchanged' END) AS violations
      FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b = 'purchase' OR b = event_type""",
    "entities_references": """WITH o AS (SELECT o_orderkey AS order_id, CAST(o_orderkey % 9000 AS VARCHAR) AS external_ref, CAST(o_custkey % 30 AS VARCHAR) AS s, CAST(o_orderkey % 30 AS VARCHAR) AS d FROM orders), n AS (SELECT CAST(n_nationkey AS VARCHAR) AS c FROM nation)
      SELECT order_id, external_ref, row_number() OVER (PARTITION BY external_ref ORDER BY order_id) = 1 AS accepted, concat_ws(';', CASE WHEN s NOT IN (SELECT c FROM n) THEN 'unknown source' END, CASE WHEN d NOT IN (SELECT c FROM n) THEN 'unknown destination' END, CASE WHEN s = d THEN 'same ends' END, CASE WHEN count(*) OVER (PARTITION BY s) > 500 THEN 'hot hub' END) AS warnings FROM o""",
    "entities_shipments": "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY 1 HAVING count(o_orderkey) > 1",
    "places_cities": "WITH s AS (SELECT CASE WHEN s_nationkey % 6 = 1 THEN 'Nation One' ELSE 'Nation ' || (s_nationkey % 6) END AS city, s_acctbal / 5000 AS e FROM supplier) SELECT city, count(*) AS corridors, round(avg(e), 6) AS mean_excess, round(CASE WHEN avg(e) >= 1 THEN max(e) ELSE min(e) END, 6) AS city_excess FROM s GROUP BY 1",
    "places_located": """SELECT s.s_suppkey, CASE WHEN s.s_suppkey % 3 = 0 THEN 'code' WHEN s.s_nationkey < 12 THEN 'city' END AS source_how, CASE WHEN s.s_suppkey % 3 = 0 THEN s.s_acctbal WHEN s.s_nationkey < 12 THEN 2.0 END AS source_lat, CASE WHEN s.s_suppkey % 3 = 0 THEN 1.0 WHEN s.s_nationkey < 12 THEN 3.0 END AS source_lon,
      CASE WHEN t.s_suppkey IS NOT NULL THEN 'code' END AS destination_how FROM supplier s LEFT JOIN supplier t ON t.s_suppkey = s.s_suppkey + 1 AND t.s_suppkey % 3 = 0""",
    "reconcile_totals": """WITH d AS (SELECT o_orderkey AS k, o_orderkey % 11 <> 0 AS b, CASE WHEN o_orderkey % 7 = 0 THEN 5.0 ELSE 0.001 END AS e FROM orders), c AS (SELECT count_if(NOT b) AS missing, CAST(0 AS BIGINT) AS added, count_if(b) AS compared, count_if(b AND e > 0.01) AS bad, count_if(b AND e > 0.01 AND k % 2 = 0) AS why FROM d)
      SELECT 'price' AS "column", missing, added, compared, bad AS mismatched, why AS explained, 5.0::DOUBLE AS most FROM c UNION ALL SELECT 'cust', missing, added, compared, 0, 0, 0.0 FROM c""",
    "reconcile_metrics": "SELECT s_name AS metric, CASE WHEN s_name LIKE '%3' THEN 'missing' ELSE 'changed' END AS state FROM supplier WHERE s_name LIKE '%3' OR s_name LIKE '%5'",
    "extraction_scores": """WITH c AS (SELECT count(*) AS n, count_if(o_orderkey % 9 = 0) AS missed, count_if(o_orderkey % 9 <> 0 AND o_orderkey % 5 = 0) AS wrong FROM orders), s AS (SELECT *, n - missed - wrong AS r FROM c)
      SELECT f AS field, r AS "right", wrong, missed, CAST(0 AS BIGINT) AS invented, round(r / (r + wrong), 6) AS precision, round(r / (r + wrong + missed), 6) AS recall, round(2 * r / (2 * r + wrong + wrong + missed), 6) AS f1 FROM s, (SELECT unnest(['status', 'priority']) AS f)""",
    "path_coverage": """WITH r AS (SELECT path, count(*) AS n FROM (SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS path FROM conversations GROUP BY 1) GROUP BY 1), e AS (SELECT 'user>' || repeat('assistant>user>', r_regionkey) || 'assistant' AS path FROM region)
      SELECT coalesce(r.path, e.path) AS path, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'never taken' WHEN e.path IS NULL THEN 'not expected' ELSE 'covered' END AS state FROM r FULL JOIN e ON r.path = e.path""",
    "unsupported_numbers": "SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 1 THEN 0 ELSE 1 END AS n FROM orders",
    "sample_spread": "SELECT event_id, ts FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS p, count(*) OVER () AS n FROM events) WHERE floor(p * 100 / n) > floor((p - 1) * 100 / n)",
    "sample_strata": "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY CAST('0x' || substr(md5('1|' || event_id), 1, 8) AS BIGINT), event_id) <= 20",
    "sample_round_robin": "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY CAST('0x' || substr(md5('1|' || event_id), 1, 8) AS BIGINT), event_id) AS n FROM events) ORDER BY n, event_type LIMIT 33",
    "document_sentences": "SELECT 'corridor:' || s_name AS doc_id, s_name AS corridor FROM supplier",
    "nearest_vectors": f"WITH {_NEAR} SELECT vec_id, b_id, round(round(s, 9), 5) AS similarity, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, b_id) AS INT) AS place FROM nn QUALIFY place <= 5",
    "nearest_vectors_labelled": f"WITH {_NEAR} SELECT vec_id, b_id, round(round(s, 9), 5) AS similarity, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, b_id) AS INT) AS place FROM nn WHERE same AND round(s, 9) >= 0.1 QUALIFY place <= 3",
    "model_inputs": trips(f"{_FEATS} SELECT leg_id, CASE WHEN route_type = 'FTL' THEN 1.0 ELSE 0.0 END AS is_ftl, CASE WHEN corr_n_prior = 0 THEN 1.0 ELSE 0.0 END AS corr_cold, coalesce(corr_mean_gap_min, 0.0) AS corr_mean_gap_min, CAST(src_n_prior AS DOUBLE) AS src_n_prior FROM legs JOIN h_corr USING (leg_id) JOIN h_src USING (leg_id)"),
    "model_fill_violations": "SELECT CAST(0 AS BIGINT) AS corr, CAST(0 AS BIGINT) AS src, CAST(0 AS BIGINT) AS dst",
    "model_time_split": trips(f"{_SPLIT} SELECT leg_id, part FROM sp"),
    "model_rolling_folds": trips("d AS (SELECT date_diff('day', (SELECT min(CAST(trip_creation_time AS DATE)) FROM legs), CAST(trip_creation_time AS DATE)) AS day FROM legs), f AS (SELECT * FROM (VALUES (1, 10, 15), (2, 15, 20)) t(fold, a, b)) SELECT fold, CASE WHEN day < a THEN 'train' ELSE 'test' END AS part, count(*) AS legs FROM d JOIN f ON day < b GROUP BY 1, 2"),
    "model_metrics": trips(f"{_BASES} {_MET}"),
    "model_threshold_sweep": trips(f"""{_BASES}, g AS (SELECT *, unnest([1.5::DOUBLE, 2.0::DOUBLE]) AS threshold FROM pr), c AS (SELECT model, threshold, CAST(count_if(gap_min > (threshold - 1) * planned_min AND predicted > (threshold - 1) * planned_min) AS DOUBLE) AS tp, CAST(count_if(gap_min <= (threshold - 1) * planned_min AND predicted > (threshold - 1) * planned_min) AS DOUBLE) AS fp,
      CAST(count_if(gap_min > (threshold - 1) * planned_min AND predicted <= (threshold - 1) * planned_min) AS DOUBLE) AS fn, CAST(count_if(gap_min <= (threshold - 1) * planned_min AND predicted <= (threshold - 1) * planned_min) AS DOUBLE) AS tn FROM g GROUP BY 1, 2)
      SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced,
      round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc, round(greatest(tp + fn, fp + tn) / (tp + fp + fn + tn), 6) AS majority FROM c"""),
    "model_slices": trips(f"""{_BASES}, s AS (SELECT model, abs(gap_min - predicted) AS e, unnest([{{'d': 'all', 's': 'all'}}, {{'d': 'route', 's': route_type}}, {{'d': 'part', 's': created_part}}, {{'d': 'history', 's': CASE WHEN corr_n_prior = 0 THEN 'cold' WHEN corr_n_prior < 10 THEN 'thin' ELSE 'warm' END}}]) AS x FROM pr),
      t AS (SELECT x.d AS dimension, x.s AS slice, model, count(*) AS n, avg(e) AS mae FROM s GROUP BY ALL) SELECT t.dimension, t.slice, t.model, t.n, round(t.mae, 6) AS mae, round(b.mae, 6) AS bar_mae, round(t.mae - b.mae, 6) AS delta FROM t JOIN t b ON b.model = 'plan' AND b.dimension = t.dimension AND b.slice = t.slice"""),
    "model_corridor_gains": trips(f"{_BASES}, g AS (SELECT corridor_id, count_if(model = 'asof_mean') AS n, avg(abs(gap_min - predicted)) FILTER (model = 'asof_mean') AS mae, avg(abs(gap_min - predicted)) FILTER (model = 'plan') AS bar_mae FROM pr GROUP BY 1) SELECT corridor_id, n, round(mae, 6) AS mae, round(bar_mae, 6) AS bar_mae, round(bar_mae - mae, 6) AS gain FROM g"),
    "model_decision": trips(f"{_BASES}, m AS (SELECT model, avg(abs(gap_min - predicted)) AS mae FROM pr GROUP BY 1), b AS (SELECT model, mae FROM m WHERE model <> 'plan' ORDER BY mae, model LIMIT 1), c AS (SELECT b.*, m.mae AS bar_mae, m.mae - b.mae AS gain FROM b, m WHERE m.model = 'plan') SELECT model, round(mae, 6) AS mae, round(bar_mae, 6) AS bar_mae, round(gain, 6) AS gain, CASE WHEN gain >= 1 THEN 'adopt' WHEN gain > 0 THEN 'report only' ELSE 'keep the bar' END AS outcome FROM c"),
    "model_majority": trips(f"{_SPLIT}, m AS (SELECT avg(is_delayed::INT) >= 0.5 AS j FROM sp WHERE part = 'train') SELECT count(*) AS n, round(avg((is_delayed = j)::INT), 6) AS accuracy FROM sp, m WHERE part = 'test'"),
    "model_comparison": trips(f"""{_BASES}, e AS (SELECT leg_id, model, route_type, CAST(CAST(trip_creation_time AS DATE) AS VARCHAR) AS day, abs(gap_min - predicted) AS e FROM pr),
      df AS (SELECT x.model, x.route_type, x.day, x.e - y.e AS d FROM e x JOIN e y ON x.leg_id = y.leg_id AND y.model = 'plan' WHERE x.model <> 'plan'),
      bl AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS blocks FROM (SELECT DISTINCT day FROM df)),
      dr AS (SELECT rep, CAST('0x' || substr(md5(concat_ws('|', '29', CAST(rep AS VARCHAR), CAST(pos AS VARCHAR))), 1, 8) AS BIGINT) % blocks AS pos FROM bl, range(40) t(rep)),
      ds AS (SELECT model, route_type, rep, sum(d) / count(d) AS mean FROM dr JOIN bl USING (pos) JOIN df USING (day) GROUP BY 1, 2, 3),
      sm AS (SELECT model, route_type, count(mean) AS reps, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, least(1, 2 * least(count_if(mean <= 0) + 1, count_if(mean >= 0) + 1) / (count(mean) + 1)) AS p FROM ds GROUP BY 1, 2),
      rk AS (SELECT *, row_number() OVER (ORDER BY p, model || '|' || route_type) AS r, count(*) OVER () AS m FROM sm JOIN (SELECT model, route_type, count(d) AS n, avg(d) AS md FROM df GROUP BY 1, 2) USING (model, route_type))
      SELECT model, route_type, n, round(md, 6) AS mean_difference, reps, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p_value, round(least(1, max((m - r + 1) * p) OVER (ORDER BY r)), 6) AS p_holm FROM rk"""),
    "model_replay_leak": trips(f"""{_BASES}, f AS (SELECT leg_id, avg(gap_min) OVER (PARTITION BY corridor_id) AS g FROM legs), s AS (SELECT 'as of creation' AS history, leg_id, m AS g FROM fx WHERE m IS NOT NULL UNION ALL SELECT 'end of data', leg_id, g FROM f),
      a AS (SELECT history, leg_id, g FROM s JOIN legs USING (leg_id) WHERE g > 0.3 * planned_min)
      SELECT history, count(*) AS alerts, count_if(is_delayed) AS tp, round(count_if(is_delayed) / count(*), 6) AS precision, round(count_if(is_delayed) / (SELECT count_if(is_delayed) FROM legs), 6) AS recall, round(avg(abs(g - gap_min)), 6) AS mae FROM a JOIN legs USING (leg_id) GROUP BY 1"""),
    "legs_statistic": legs("SELECT count(*) AS legs, CAST(0 AS BIGINT) AS ratio_differs, count_if((gap_min > planned_min) <> is_delayed) AS flag_differs FROM legs WHERE planned_min > 0"),
    "legs_judge_medians": "SELECT count(*) AS legs, CAST(0 AS BIGINT) AS differing FROM events",
    "corridor_extras": trips("SELECT corridor_id, count(*) AS n_legs, max(dwell_min) AS most_dwell FROM legs GROUP BY 1"),
    "fisher_exact": trips(f"""t AS (SELECT schedule, count_if(is_delayed AND planned_min < 40) AS a, count_if(is_delayed AND planned_min >= 40) AS b, count_if(NOT is_delayed AND planned_min < 40) AS c, count_if(NOT is_delayed AND planned_min >= 40) AS d FROM legs GROUP BY 1),
      u AS (SELECT *, unnest(range(CAST(greatest(0, a + c - (c + d)) AS BIGINT), CAST(least(a + b, a + c) + 1 AS BIGINT))) AS k FROM t), p AS (SELECT *, exp({_CH('a + b', 'k')} + {_CH('c + d', 'a + c - k')} - {_CH('a + b + c + d', 'a + c')}) AS p, exp({_CH('a + b', 'a')} + {_CH('c + d', 'c')} - {_CH('a + b + c + d', 'a + c')}) AS seen FROM u)
      SELECT schedule, a, b, c, d, round(least(1, sum(CASE WHEN p <= seen * (1 + 1e-7) THEN p ELSE 0 END)), 6) AS p_fisher FROM p GROUP BY schedule, a, b, c, d"""),
    "alerts_notice": trips(f"""{_GRADED} SELECT leg_id, 'Leg ' || leg_id || ' on ' || corridor_id || ' is expected ' || CAST(round((predicted_total_min - planned_min) / 60, 1) AS VARCHAR) || ' h late against a plan of ' || CAST(round(planned_min / 60, 1) AS VARCHAR) || ' h (' || severity || ').' AS notice FROM gr"""),
    "question_scores": f"""WITH q AS (SELECT CAST(turn % 3 AS VARCHAR) AS question_set, conv_id % 7 <> 0 AND conv_id % 3 <> 0 AS hit, conv_id % 2 = 0 AS src FROM conversations WHERE role = 'user'), g AS (SELECT question_set, count(*) AS n, count_if(hit) AS hits, count_if(hit AND src) AS "both" FROM q GROUP BY 1)
      SELECT question_set, n, hits, "both", {_W} FROM (SELECT *, hits / n AS p FROM g)""",
    "stream_events": trips(f"{_EV} SELECT * REPLACE (round(gap_min, 6) AS gap_min, round(log_gap_ratio, 6) AS log_gap_ratio) FROM evs"),
    "stream_validation": trips(f"{_EV} SELECT CASE WHEN CAST(leg_id AS BIGINT) % 10 = 0 THEN 'planned_min' ELSE '' END AS violations, count(*) AS n FROM evs GROUP BY 1"),
    "stream_keys": trips(f"""{_EV}, p AS (SELECT *, CASE WHEN created_hour < 6 THEN 'night' WHEN created_hour < 12 THEN 'morning' WHEN created_hour < 18 THEN 'afternoon' ELSE 'evening' END AS part FROM evs),
      k AS (SELECT kind, unnest([{{'t': 'corridor', 'k': corridor_id}}, {{'t': 'source', 'k': source_center}}, {{'t': 'destination', 'k': destination_center}}, {{'t': 'source_part', 'k': source_center || '|' || part}}, {{'t': 'destination_part', 'k': destination_center || '|' || part}}]) AS o FROM p)
      SELECT o.t AS key_type, kind, count(*) AS n, count(DISTINCT o.k) AS keys FROM k GROUP BY 1, 2"""),
    "stream_snapshot_join": trips("s AS (SELECT corridor_id, count(*) AS n, avg(gap_min) AS m FROM legs GROUP BY 1) SELECT corridor_id, leg_id, coalesce(n, 0) AS n, round(coalesce(m, 0), 6) AS mean_gap_min FROM legs LEFT JOIN s USING (corridor_id)"),
    "stream_latency": trips("d AS (SELECT (epoch_us(od_end_time) - epoch_us(od_start_time)) / 1e6 AS s FROM legs) SELECT count(*) AS n, quantile_disc(s, 0.5) AS p50, quantile_disc(s, 0.95) AS p95, max(s) AS most FROM d"),
    "stream_finish": trips("SELECT CAST(leg_id AS BIGINT) % 4 <> 0 AS matched, count(*) AS n, max(CASE WHEN CAST(leg_id AS BIGINT) % 4 <> 0 THEN od_end_time END) AS latest FROM legs GROUP BY 1"),
    "stream_history": trips(", ".join(_mean(k, p) for k, p in _STREAM) + f""", disp AS ({_dispersion(7)})
      SELECT leg_id, CAST(corr_n_prior AS INT) AS corr_n_prior, CAST(src_n_prior AS INT) AS src_n_prior, CAST(dst_n_prior AS INT) AS dst_n_prior, corr_n_prior_7d,
        round(h_corr.m, 6) AS corr_mean_gap_min, corr_median_gap_min, corr_p90_gap_min, corr_iqr_gap_min, corr_std_gap_min AS corr_sd_gap_min, corr_mean_gap_7d,
        round(h_sp.d, 6) AS src_dwell_by_hour_min, round(h_dp.d, 6) AS dst_dwell_by_hour_min
      FROM h_corr JOIN h_src USING (leg_id) JOIN h_dst USING (leg_id) JOIN h_sp USING (leg_id) JOIN h_dp USING (leg_id) JOIN disp USING (leg_id)"""),
    "stream_alerts": trips(f"{_STREAM_ALERTS} SELECT leg_id, corridor_id, round(predicted, 6) AS predicted_gap, round(planned_min, 6) AS threshold_gap, round(predicted / planned_min, 6) AS alert_excess FROM al"),
    "stream_ledger": trips(f"{_STREAM_ALERTS} SELECT (SELECT count(*) FROM legs) AS queries, (SELECT count(*) FROM legs) AS facts, CAST(0 AS BIGINT) AS late_facts, (SELECT count(*) FROM al) AS alerts"),
    "alerts_feed": f"""WITH {_ALERT_LINES} SELECT alert_id, strftime(alerted_at, '%Y-%m-%d %H:%M:%S') AS alerted_at, corridor_id, round(predicted_gap, 6) AS predicted_gap FROM al
      WHERE state = 'good' AND corridor_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY al.alerted_at DESC, corridor_id DESC, al.predicted_gap DESC) = 1""",
    "alerts_rejected": f"WITH {_ALERT_LINES} SELECT count_if(state <> 'blank') AS lines, count_if(state = 'bad') AS malformed, count_if(state = 'good' AND corridor_id IS NULL) AS incomplete FROM al",
    "questions_answered": trips(f"""{_HUB}, {_welch(10)}, rk AS (
        SELECT 'hub_friction' AS route, list(centre_code ORDER BY msx DESC, centre_code) AS l FROM hubr WHERE has_support AND msx IS NOT NULL
        UNION ALL SELECT 'hub_dwell', list(centre_code ORDER BY mmx DESC, centre_code) FROM hubr WHERE has_support AND mmx IS NOT NULL
        UNION ALL SELECT 'corridor_worst', list(corridor_id ORDER BY excess_ratio DESC, corridor_id) FROM welch WHERE excess_ratio > 1
        UNION ALL SELECT 'corridor_best', list(corridor_id ORDER BY excess_ratio, corridor_id) FROM welch WHERE excess_ratio < 1),
      q AS (SELECT o_orderkey AS question_id, CASE o_custkey % 8 WHEN 0 THEN 'hub_friction' WHEN 1 THEN 'hub_dwell' WHEN 2 THEN 'corridor_worst' WHEN 3 THEN 'corridor_best' WHEN 6 THEN 'corridor_worst' END AS route,
        CAST(CASE WHEN o_custkey % 8 IN (0, 2, 3) THEN least(20, greatest(1, o_orderkey % 27)) WHEN o_custkey % 8 = 6 THEN 20 ELSE 5 END AS INT) AS n FROM orders)
      SELECT question_id, q.route, n, array_to_string(l[1 : n], ',') AS answer FROM q LEFT JOIN rk ON q.route = rk.route"""),
    "stream_finish_refused": trips("SELECT corridor_id, count(*) AS n, max(od_end_time) AS latest FROM legs GROUP BY 1"),
    "model_metrics_median": trips(f"{_MEDIANS} {_MET.replace('FROM pr', 'FROM pm')}"),
    "model_promotions": trips(f"""{_MEDIANS}, mt AS (SELECT CAST(leg_id AS BIGINT) % 4 AS "round", model, round(avg(abs(gap_min - predicted)), 6) AS mae FROM pm GROUP BY 1, 2),
      b AS (SELECT "round", min(mae) AS mae, arg_min(model, (mae, model)) AS challenger FROM mt GROUP BY 1),
      c AS (SELECT *, min(mae) OVER (ORDER BY "round" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS champion_mae FROM b),
      d AS (SELECT *, champion_mae IS NULL OR mae < champion_mae AS promoted FROM c)
      SELECT "round", promoted, challenger, mae AS challenger_mae, last_value(CASE WHEN promoted THEN challenger END IGNORE NULLS) OVER (ORDER BY "round" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS champion,
        champion_mae, CAST(count_if(promoted) OVER (ORDER BY "round") AS BIGINT) AS version, CASE WHEN champion_mae IS NULL THEN 'no champion on record' WHEN promoted THEN 'smaller error' ELSE 'error not smaller' END AS reason FROM d"""),
    "model_reported": trips(f"""{_MEDIANS}, c AS (SELECT model, CASE WHEN model IN ('plan', 'asof_mean') THEN 'spark' ELSE 'other' END AS library,
        round(avg(abs(gap_min - predicted)) FILTER (CAST(leg_id AS BIGINT) % 10 < 7), 6) AS v, round(avg(abs(gap_min - predicted)) FILTER (CAST(leg_id AS BIGINT) % 10 >= 7), 6) AS t FROM pm GROUP BY 1)
      SELECT arg_min(model, (v, model)) AS reported_model, arg_min(library, (v, model)) AS reported_library, min(v) AS validation_mae, arg_min(t, (v, model)) AS test_mae,
        arg_min(model, (v, model)) FILTER (library = 'spark') AS served_model, arg_min(t, (v, model)) FILTER (library = 'spark') AS served_test_mae FROM c"""),
    "reconcile_frozen": """WITH m AS (SELECT s_name, s_suppkey AS k, s_nationkey AS f, 'nation_' || s_nationkey AS source, s_suppkey % 5 <> 0 AS was, s_suppkey % 7 <> 0 AS now FROM supplier)
      SELECT * FROM (SELECT 'metric' AS kind, s_name AS name, CASE WHEN NOT now THEN CASE WHEN was THEN 'missing' END WHEN f = 8 THEN 'unreadable' WHEN NOT was THEN 'added' WHEN k % 3 = 0 THEN 'changed' END AS state, source FROM m) WHERE state IS NOT NULL
      UNION ALL SELECT DISTINCT 'file', source, 'rewritten', source FROM m WHERE was AND f <> 3 AND (f = 8 OR f % 4 = 1)""",
    "document_hubs": trips(f"{_HUB} SELECT 'hub:' || centre_code AS doc_id, main_route AS route, CAST(friction_rank AS INT) AS friction_rank, CAST(n_legs_out AS BIGINT) AS legs FROM hubr WHERE has_support"),
    "alerts_freshness": trips("""SELECT count(*) AS alerts, count(DISTINCT corridor_id) AS corridors, strftime(max(trip_creation_time), '%Y-%m-%d %H:%M:%S') AS latest,
      round((epoch_us(TIMESTAMP '2030-01-01 00:00:00') - epoch_us(max(trip_creation_time))) / 1e6, 6) AS age_s FROM legs WHERE is_delayed"""),
    "entities_shipment_rules": """WITH s AS (SELECT l_orderkey AS order_id, concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, CAST(l_quantity AS INT) % 5 = 0 AS early FROM lineitem),
      o AS (SELECT o_orderkey AS order_id, o_orderstatus = 'F' AS cancelled FROM orders WHERE o_orderkey % 11 <> 0)
      SELECT concat_ws(';', CASE WHEN cancelled IS NULL THEN 'order unknown' END, CASE WHEN cancelled THEN 'order cancelled' END, CASE WHEN k > 1 THEN 'order has a shipment' END, CASE WHEN early THEN 'arrives before departure' END) AS violations, count(*) AS n
      FROM (SELECT s.*, row_number() OVER (PARTITION BY s.order_id ORDER BY id) AS k FROM s) t LEFT JOIN o USING (order_id) GROUP BY 1""",
}
