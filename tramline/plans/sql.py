"""SQL of the adapted tables, shared by the queries' SQL."""

from __future__ import annotations

GAPS = """SELECT *, actual_time - planned_min AS gap_min, actual_time / planned_min AS gap_ratio,
  ln(actual_time / planned_min) AS log_gap_ratio, actual_time / planned_min > 2 AS is_delayed"""

LEGS = f"""legs0 AS (
  SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS leg_id,
    CAST(l_orderkey AS VARCHAR) AS trip_uuid, 'S' || s_nationkey AS source_center, 'C' || c_nationkey AS destination_center,
    'S' || s_nationkey || '>C' || c_nationkey AS corridor_id, o_orderdate AS trip_creation_time, o_orderdate AS od_start_time,
    l_shipdate AS od_end_time, CAST(l_suppkey AS VARCHAR) AS schedule,
    CASE WHEN l_returnflag = 'R' THEN 'FTL' ELSE 'Carting' END AS route_type, l_quantity AS planned_min,
    l_extendedprice / 1000 AS actual_time, l_quantity AS planned_km, l_discount * 100 AS dwell_min,
    l_extendedprice / 1000 + l_discount * 100 AS start_scan_to_end_scan
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  WHERE l_shipdate > o_orderdate
), legs AS ({GAPS} FROM legs0)"""

TRIPS = f"""ev0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
legs0 AS (
  SELECT CAST(event_id AS VARCHAR) AS leg_id, user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS trip_uuid,
    'H' || (user_id % 12) AS source_center, 'H' || (k % 12) AS destination_center,
    'H' || (user_id % 12) || '>H' || (k % 12) AS corridor_id, ts AS trip_creation_time, ts AS od_start_time,
    ts + to_minutes(CAST(floor(value) + (k % 7) * 3 + 1 AS BIGINT)) AS od_end_time, event_type AS schedule,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'FTL' ELSE 'Carting' END AS route_type,
    CAST(k + 10 AS DOUBLE) AS planned_min, value + 5 AS actual_time, CAST(k + 1 AS DOUBLE) AS planned_km,
    CAST((k % 7) * 3 AS DOUBLE) AS dwell_min, value + 5 + (k % 7) * 3 AS start_scan_to_end_scan FROM ev0
), legs AS ({GAPS} FROM legs0)"""

SEGMENTS = """seg AS (
  SELECT l_orderkey AS leg, row_number() OVER w AS row_index, l_returnflag AS route_type, l_extendedprice / 1000 AS segment_actual_time,
    l_quantity AS segment_osrm_time, sum(l_extendedprice / 1000) OVER r AS actual_time, sum(l_quantity) OVER r AS osrm_time
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice),
    r AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)
)"""


def legs(rest: str) -> str:
    return f"WITH {LEGS}, {rest}" if rest.lstrip()[:6].upper() != "SELECT" else f"WITH {LEGS} {rest}"


def trips(rest: str) -> str:
    return f"WITH {TRIPS}, {rest}" if rest.lstrip()[:6].upper() != "SELECT" else f"WITH {TRIPS} {rest}"


def segments(rest: str) -> str:
    return f"WITH {SEGMENTS}, {rest}" if rest.lstrip()[:6].upper() != "SELECT" else f"WITH {SEGMENTS} {rest}"


def draw(*parts: str) -> str:
    return "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8) AS BIGINT)"
