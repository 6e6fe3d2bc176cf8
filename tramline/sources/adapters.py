"""Adapters from the standard tables to legs, segments, events, invoices and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.columns import minutes_between


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_gaps(legs: DataFrame) -> DataFrame:
    """Overrun of a leg against its plan: minutes, ratio, log ratio, and whether it is late at twice the plan."""
    return (
        legs.withColumn("gap_min", F.col("actual_time") - F.col("planned_min"))
        .withColumn("gap_ratio", F.col("actual_time") / F.col("planned_min"))
        .withColumn("log_gap_ratio", F.log("gap_ratio"))
        .withColumn("is_delayed", F.col("gap_ratio") > 2)
    )


def legs_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as legs from a supplier's to a customer's nation, created on the order date and finished on the ship
    date.  Lines shipped on or before the order date are no legs: a leg must not finish before it is created."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    # Customers meet orders, of which there are fewer than lines.
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = line.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate > o_orderdate").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    actual, dwell = F.col("l_extendedprice") / 1000, F.col("l_discount") * 100
    source, destination = F.concat(F.lit("S"), "s_nationkey"), F.concat(F.lit("C"), "c_nationkey")
    legs = joined.select(
        F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents).alias("leg_id"),
        F.col("l_orderkey").cast("string").alias("trip_uuid"),
        source.alias("source_center"), destination.alias("destination_center"),
        F.concat(source, F.lit(">"), destination).alias("corridor_id"),
        F.col("o_orderdate").alias("trip_creation_time"), F.col("o_orderdate").alias("od_start_time"),
        F.col("l_shipdate").alias("od_end_time"), F.col("l_suppkey").cast("string").alias("schedule"),
        F.when(F.col("l_returnflag") == "R", "FTL").otherwise("Carting").alias("route_type"),
        F.col("l_quantity").alias("planned_min"), actual.alias("actual_time"), F.col("l_quantity").alias("planned_km"),
        dwell.alias("dwell_min"), (actual + dwell).alias("start_scan_to_end_scan"),
    )
    return with_gaps(legs)


def legs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as legs between hubs, with microsecond clocks and legs still under way when others are created."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    source, destination = F.concat(F.lit("H"), F.col("user_id") % 12), F.concat(F.lit("H"), F.col("k") % 12)
    dwell = ((F.col("k") % 7) * 3).cast("double")
    legs = e.select(
        F.col("event_id").cast("string").alias("leg_id"),
        F.concat_ws("-", "user_id", F.col("ts").cast("date")).alias("trip_uuid"),
        source.alias("source_center"), destination.alias("destination_center"),
        F.concat(source, F.lit(">"), destination).alias("corridor_id"),
        F.col("ts").alias("trip_creation_time"), F.col("ts").alias("od_start_time"),
        F.expr("timestampadd(MINUTE, cast(floor(value) + (k % 7) * 3 + 1 as int), ts)").alias("od_end_time"),
        F.col("event_type").alias("schedule"),
        F.when(F.col("event_type").isin("purchase", "signup"), "FTL").otherwise("Carting").alias("route_type"),
        (F.col("k") + 10).cast("double").alias("planned_min"), (F.col("value") + 5).alias("actual_time"),
        (F.col("k") + 1).cast("double").alias("planned_km"), dwell.alias("dwell_min"),
        (F.col("value") + 5 + dwell).alias("start_scan_to_end_scan"),
    )
    return with_gaps(legs)


def segments_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as segments of one leg per order; actual_time and osrm_time are running totals in row order."""
    from pyspark.sql import Window

    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "leg")
    order = Window.partitionBy("leg").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return line.select(
        "leg", F.row_number().over(order).alias("row_index"),
        F.col("l_returnflag").alias("route_type"), (F.col("l_extendedprice") / 1000).alias("segment_actual_time"),
        F.col("l_quantity").alias("segment_osrm_time"),
        F.sum(F.col("l_extendedprice") / 1000).over(order).alias("actual_time"),
        F.sum("l_quantity").over(order).alias("osrm_time"),
    )


def as_legs(trips: DataFrame, source: Column, destination: Column, started: str, finished: str, distance: Column, pace: Column) -> DataFrame:
    """Foreign trip records as legs: the plan is distance divided by a stand-in pace; unusable trips are left out."""
    rows = trips.select(
        source.cast("string").alias("source_center"), destination.cast("string").alias("destination_center"),
        F.col(started).alias("od_start_time"), F.col(finished).alias("od_end_time"), distance.alias("planned_km"),
        minutes_between(started, finished).alias("actual_time"), (distance / pace).alias("planned_min"),
    )
    rows = rows.where("actual_time > 0 and planned_min > 0 and source_center is not null and destination_center is not null")
    return with_gaps(rows.withColumn("corridor_id", F.concat_ws(">", "source_center", "destination_center")))
