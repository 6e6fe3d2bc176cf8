"""Legs as a stream of events: a query when a leg is created, a fact when it is finished."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.columns import day_part, micros

SCHEMA = (
    "event_id string, kind string, leg_id string, event_time timestamp_ntz, corridor_id string, source_center string, destination_center string, "
    "created_hour int, planned_min double, gap_min double, log_gap_ratio double, dwell_min double"
)
#: JSON times to the microsecond; Spark writes milliseconds unless told.
MICROSECONDS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
KEY_TYPES = ["corridor", "source", "destination", "source_part", "destination_part"]


def build_events(legs: DataFrame) -> DataFrame:
    """Two ordered events per leg; a query carries no outcome."""
    common = ["leg_id", "corridor_id", "source_center", "destination_center", F.hour("trip_creation_time").alias("created_hour"), "planned_min"]
    none = [F.lit(None).cast("double").alias(c) for c in ("gap_min", "log_gap_ratio", "dwell_min")]
    q = legs.select(F.concat(F.lit("q:"), "leg_id").alias("event_id"), F.lit("query").alias("kind"), F.col("trip_creation_time").alias("event_time"), *common, *none)
    f = legs.select(F.concat(F.lit("f:"), "leg_id").alias("event_id"), F.lit("fact").alias("kind"), F.col("od_end_time").alias("event_time"), *common, "gap_min", "log_gap_ratio", "dwell_min")
    return q.unionByName(f).select([c.split()[0] for c in SCHEMA.split(", ")])


def as_json(events: DataFrame) -> DataFrame:
    """One JSON text per event; null fields are left out."""
    return events.select("corridor_id", F.to_json(F.struct(*events.columns), {"ignoreNullFields": "true", **MICROSECONDS}).alias("value"))


def violations(events: DataFrame) -> DataFrame:
    """Add the list of rules that an event breaks: required, conditional and ranged fields."""
    fact = F.col("kind") == "fact"
    rules = [
        ("kind", ~F.coalesce(F.col("kind").isin("query", "fact"), F.lit(False))), ("event_id", F.col("event_id").isNull()), ("event_time", F.col("event_time").isNull()),
        ("corridor_id", F.col("corridor_id").isNull()), ("created_hour", ~F.coalesce(F.col("created_hour").between(0, 23), F.lit(False))),
        ("planned_min", ~F.coalesce(F.col("planned_min") > 0, F.lit(False))), ("gap_min missing", fact & F.col("gap_min").isNull()),
        ("outcome on a query", (F.col("kind") == "query") & (F.col("gap_min").isNotNull() | F.col("dwell_min").isNotNull())),
        ("dwell_min", F.coalesce(F.col("dwell_min") < 0, F.lit(False))),
    ]
    return events.withColumn("violations", F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules])))


def with_finish(alerts: DataFrame, facts: DataFrame) -> DataFrame:
    """Attach finish time and dwell of each leg; ``matched`` says whether there was a fact."""
    f = facts.select("leg_id", F.col("event_time").alias("od_end_time"), F.col("dwell_min").alias("finish_dwell"), F.lit(True).alias("m"))
    return alerts.join(f, "leg_id", "left").withColumn("matched", F.coalesce("m", F.lit(False))).drop("m")


def refusing_unmatched(alerts: DataFrame) -> DataFrame:
    """Alerts of ``with_finish``, where a row without its finish stops whatever reads it, a stream too: its legs' key has drifted."""
    why = F.concat(F.lit("no finish for leg "), F.coalesce("leg_id", F.lit("null")))
    return alerts.withColumn("od_end_time", F.when(F.col("matched"), F.col("od_end_time")).otherwise(F.raise_error(why).cast("timestamp_ntz"))).drop("matched")


def keys_of(events: DataFrame) -> Column:
    part = day_part(F.col("created_hour"))
    pairs = [("corridor", F.col("corridor_id")), ("source", F.col("source_center")), ("destination", F.col("destination_center")),
             ("source_part", F.concat_ws("|", "source_center", part)), ("destination_part", F.concat_ws("|", "destination_center", part))]
    return F.array(*[F.struct(F.lit(t).alias("key_type"), k.alias("key")) for t, k in pairs])


def keyed(events: DataFrame) -> DataFrame:
    """One row for each of the five keys that an event touches, with its time in microseconds."""
    return events.select("*", F.explode(keys_of(events)).alias("k"), micros("event_time").alias("t")).select("k.key_type", "k.key", *[c for c in events.columns], "t")
