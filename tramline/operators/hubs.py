"""Legs from segments, hubs from legs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.columns import micros, ratio


def reconstruct(segments: DataFrame, leg: str = "leg", row: str = "row_index") -> DataFrame:
    """Legs from segments whose columns are running totals: totals of the last row, sums and counts of all, in one aggregate."""
    last = F.max_by(F.struct("actual_time", "osrm_time", "route_type"), row).alias("last")
    legs = segments.groupBy(leg).agg(
        last, F.count("*").alias("n_segments"), F.sum("segment_actual_time").alias("sum_actual"), F.sum("segment_osrm_time").alias("sum_osrm")
    )
    return legs.select(
        leg, "last.*", "n_segments", "sum_actual", "sum_osrm",
        (F.col("last.actual_time") - F.col("last.osrm_time")).alias("gap_min"), ratio(F.col("last.actual_time"), F.col("last.osrm_time")).alias("gap_ratio"),
    )


def constants(segments: DataFrame, leg: str, columns: list[str]) -> DataFrame:
    """One row: legs on which a column that should be constant is not, by column."""
    varied = segments.groupBy(leg).agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns])
    return varied.agg(F.count("*").alias("legs"), *[F.count_if(c).alias(f"{c}_varies") for c in columns])


def first_maximum(segments: DataFrame, leg: str = "leg") -> DataFrame:
    """The other last-row rule: the first row with the largest running total."""
    w = Window.partitionBy(leg).orderBy(F.col("actual_time").desc(), "row_index")
    return segments.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(leg, "row_index", "actual_time", "osrm_time")


def reconstruction_summary(legs: DataFrame) -> DataFrame:
    return legs.agg(
        F.count("*").alias("legs"), F.expr("percentile(gap_ratio, 0.5)").alias("median_ratio"), F.expr("percentile(gap_min, 0.5)").alias("median_gap"),
        F.avg((F.col("gap_ratio") > 2).cast("double")).alias("late_share"), F.avg("n_segments").alias("mean_segments"),
    )


def sides(legs: DataFrame) -> DataFrame:
    """Per hub, statistics of the legs that leave (_out) and arrive (_in): both ends are exploded once, one conditional aggregate."""
    ends = F.array(F.struct(F.col("source_center").alias("centre_code"), F.lit("out").alias("side")), F.struct(F.col("destination_center").alias("centre_code"), F.lit("in").alias("side")))
    share = F.when(F.col("start_scan_to_end_scan") > 0, F.col("dwell_min") / F.col("start_scan_to_end_scan"))
    rows = legs.select(F.explode(ends).alias("e"), "corridor_id", "dwell_min", "gap_ratio", share.alias("dwell_share")).select("e.*", "*")
    out = []
    for s in ("out", "in"):
        of = lambda c, s=s: F.when(F.col("side") == s, F.col(c))
        out += [
            F.count(of("corridor_id")).alias(f"n_legs_{s}"), F.count_distinct(of("corridor_id")).alias(f"n_corridors_{s}"),
            F.percentile(of("dwell_min"), 0.5).alias(f"median_dwell_min_{s}"), F.avg(of("dwell_min")).alias(f"mean_dwell_min_{s}"),
            F.percentile(of("dwell_min"), 0.9).alias(f"p90_dwell_min_{s}"), F.percentile(of("dwell_share"), 0.5).alias(f"median_dwell_share_{s}"),
            F.percentile(of("gap_ratio"), 0.5).alias(f"median_gap_ratio_{s}"),
        ]
    return rows.groupBy("centre_code").agg(*out)


def leg_chain(legs: DataFrame) -> DataFrame:
    """Number of each leg in its trip, and where and when the next one starts."""
    w = Window.partitionBy("trip_uuid").orderBy("od_start_time", "od_end_time", "leg_id")
    return legs.select(
        "leg_id", "trip_uuid", "source_center", "destination_center", "od_end_time", F.row_number().over(w).alias("leg_seq"),
        F.lead("source_center").over(w).alias("next_source"), F.lead("od_start_time").over(w).alias("next_start"),
    )


def handoffs(legs: DataFrame) -> DataFrame:
    """Per hub where a leg was followed by another of its trip: handoffs, chain breaks, and the unobserved gap at breaks."""
    chain = leg_chain(legs).where("next_source is not null")
    gap = F.when(F.col("destination_center") != F.col("next_source"), (micros("next_start") - micros("od_end_time")) / 60e6)
    return chain.withColumn("gap", gap).groupBy(F.col("destination_center").alias("centre_code")).agg(
        F.count("*").alias("n_handoffs"), F.count("gap").alias("n_chain_breaks"), F.percentile("gap", 0.5).alias("median_unobserved_gap_min"), F.avg("gap").alias("mean_unobserved_gap_min")
    )


def directory(legs: DataFrame) -> DataFrame:
    """Each hub's most frequent route type (ties by name) among the legs at either end."""
    ends = F.array("source_center", "destination_center")
    votes = legs.select(F.explode(ends).alias("centre_code"), "route_type").groupBy("centre_code", "route_type").agg(F.count("*").alias("n"))
    best = Window.partitionBy("centre_code").orderBy(F.col("n").desc(), "route_type")
    return votes.withColumn("r", F.row_number().over(best)).where("r = 1").select("centre_code", F.col("route_type").alias("main_route"))


def hub_table(legs: DataFrame, min_support: int = 30) -> DataFrame:
    """Directory, both sides and handoffs; friction ranks run densely over supported hubs only."""
    d = directory(legs).join(sides(legs), "centre_code", "left").join(handoffs(legs), "centre_code", "left")
    d = d.fillna(0, ["n_legs_out", "n_legs_in", "n_corridors_out", "n_corridors_in", "n_handoffs", "n_chain_breaks"])
    d = d.withColumn("n_legs_total", F.col("n_legs_out") + F.col("n_legs_in")).withColumn("chain_break_rate", ratio(F.col("n_chain_breaks"), F.col("n_handoffs")))
    d = d.withColumn("has_support", F.col("n_legs_out") >= min_support)
    w = Window.partitionBy("has_support").orderBy(F.col("median_dwell_share_out").desc_nulls_last(), "centre_code")
    return d.withColumn("friction_rank", F.when(F.col("has_support"), F.row_number().over(w)))


def metric_diagnostics(hubs: DataFrame, n: int = 5) -> DataFrame:
    """One row: how far outgoing and incoming dwell agree, and how far two rankings of hubs do (hubs are few rows)."""
    s = hubs.where("has_support")
    by = lambda c: Window.partitionBy("has_support").orderBy(F.col(c).desc_nulls_last(), "centre_code")
    r = s.withColumn("a", F.row_number().over(by("median_dwell_share_out"))).withColumn("b", F.row_number().over(by("median_dwell_min_out")))
    return r.agg(
        F.count("*").alias("hubs"), F.corr("median_dwell_share_out", "median_dwell_share_in").alias("corr_share"), F.corr("a", "b").alias("rank_corr"),
        F.count_if((F.col("a") <= n) & (F.col("b") <= n)).alias("top_overlap"),
    )


def leaderboard(hubs: DataFrame, n: int = 20) -> DataFrame:
    """Supported hubs by friction rank, rounded for export."""
    return hubs.where(F.col("friction_rank") <= n).select(
        "friction_rank", "centre_code", "n_legs_out", F.round("median_dwell_share_out", 4).alias("median_dwell_share_out"), F.round("median_dwell_min_out", 2).alias("median_dwell_min_out")
    )


def hubs_and_corridors(hubs: DataFrame, audited: DataFrame) -> DataFrame:
    """Per supported hub, the mean excess of its outgoing corridors and how many are confirmed slow."""
    out = audited.groupBy(F.col("source_center").alias("centre_code")).agg(
        F.count("*").alias("corridors"), F.avg("excess_ratio").alias("mean_excess"), F.count("bottleneck_rank").alias("slow_corridors")
    )
    return hubs.where("has_support").select("centre_code", "median_dwell_share_out").join(out, "centre_code")
