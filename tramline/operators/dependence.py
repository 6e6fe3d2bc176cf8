"""Why legs of one corridor aren't independent: intraclass correlations after the corridor's mean is taken out, and what they cost.

Residuals are made by a join of corridor sums; each clustering (creation day, trip, corridor and schedule) is a sum per
cluster and then an analysis of variance over clusters, in the JVM, with partial sums before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import icc

#: Creation days, trips and schedule cells: name, cluster columns, and whether clusters of one leg are left out.
CLUSTERS = [("day", ["day"], False), ("trip", ["trip_uuid"], True), ("cell", ["corridor_id", "schedule"], True)]


def tested_legs(legs: DataFrame, floor: int = 10) -> tuple[DataFrame, DataFrame]:
    """Legs of corridors with at least ``floor`` legs, with creation day and corridor-demeaned log ratio res; and these corridors."""
    d = legs.withColumn("day", F.col("trip_creation_time").cast("date"))
    keys = ["corridor_id"]
    pairs = lambda *c: d.groupBy(*keys, *c).agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("*").alias(f"n_{c[0]}s"))
    corridors = d.groupBy(*keys).agg(F.count("*").alias("n_legs"), F.avg("log_gap_ratio").alias("mean_r")).where(F.col("n_legs") >= floor)
    for c in ("trip_uuid", "day", "schedule"):
        corridors = corridors.join(pairs(c), keys)
    rows = d.join(corridors.select(*keys, "mean_r"), keys).withColumn("res", F.col("log_gap_ratio") - F.col("mean_r")).drop("mean_r")
    return rows, corridors


def cluster_iccs(rows: DataFrame) -> DataFrame:
    """(what, groups, n0, rho): of corridors by log ratio, and of days, trips and schedule cells by the demeaned one."""
    out = icc(rows, "log_gap_ratio", "corridor_id").select(F.lit("corridor").alias("what"), "groups", "n0", "rho")
    for name, by, several in CLUSTERS:
        d = rows.withColumn("_g", F.struct(*by))
        if several:
            d = d.join(d.groupBy("_g").agg(F.count("*").alias("_n")).where("_n > 1"), "_g")
        out = out.unionByName(icc(d, "res", "_g").select(F.lit(name).alias("what"), "groups", "n0", "rho"))
    return out


def _spread(df: DataFrame, what: str, x: Column) -> DataFrame:
    at = lambda q: F.percentile(x.cast("double"), q)
    return df.agg(
        F.lit(what).alias("what"), F.count("*").alias("units"), F.min(x).cast("double").alias("least"), at(0.25).alias("p25"), at(0.5).alias("median"),
        F.avg(x).alias("mean"), at(0.75).alias("p75"), F.max(x).cast("double").alias("most"),
    )


def diagnostics(legs: DataFrame, floor: int = 10) -> DataFrame:
    """(what, units, least, p25, median, mean, p75, most): legs, trips, days and schedule cells per corridor, legs per trip and cell,
    design effects 1 + (m - 1) rho of days and schedule cells within a corridor, and the effective numbers of legs they leave.

    Percentiles are over corridors, trips or cells, not over legs.
    """
    rows, corridors = tested_legs(legs, floor)
    rho = cluster_iccs(rows).agg(*[F.greatest(F.lit(0.0), F.max(F.when(F.col("what") == w, F.col("rho")))).alias(f"rho_{w}") for w in ("day", "cell")])
    size = lambda c: F.greatest(F.col("n_legs") / F.col(c), F.lit(1.0))
    c = corridors.join(F.broadcast(rho))  # one row
    c = c.withColumn("de_day", 1 + (size("n_days") - 1) * F.col("rho_day")).withColumn("de_cell", 1 + (size("n_schedules") - 1) * F.col("rho_cell"))
    parts = [
        _spread(corridors, "legs per corridor", F.col("n_legs")), _spread(corridors, "trips per corridor", F.col("n_trip_uuids")),
        _spread(corridors, "days per corridor", F.col("n_days")), _spread(corridors, "schedule cells per corridor", F.col("n_schedules")),
        _spread(legs.groupBy("trip_uuid").agg(F.count("*").alias("n")), "legs per trip", F.col("n")),
        _spread(rows.groupBy("corridor_id", "day").agg(F.count("*").alias("n")), "legs per corridor and day", F.col("n")),
        _spread(rows.groupBy("corridor_id", "schedule").agg(F.count("*").alias("n")), "legs per schedule cell", F.col("n")),
        _spread(c, "design effect of days", F.col("de_day")), _spread(c, "effective legs under days", F.col("n_legs") / F.col("de_day")),
        _spread(c, "design effect of schedule cells", F.col("de_cell")), _spread(c, "effective legs under schedule cells", F.col("n_legs") / F.col("de_cell")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeats(legs: DataFrame, floor: int = 10) -> DataFrame:
    """One row: legs, trips, creation days and their range, corridors tested and their legs, corridors that a trip visits twice, most
    repeats, corridor-days, corridors of one schedule, and the design effect of trips on the rest of the network."""
    rows, corridors = tested_legs(legs, floor)
    trips = legs.groupBy("trip_uuid").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_trips"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("size"))
    day = F.col("trip_creation_time").cast("date")
    days = legs.groupBy(day.alias("day")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_legs"), F.count("*").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    repeat = F.col("n_legs") - F.col("n_trip_uuids")
    per = corridors.agg(
        F.count("*").alias("corridors_tested"), F.sum("n_legs").alias("tested_legs"), F.count_if(repeat > 0).alias("corridors_repeated"),
        F.max(repeat).alias("most_repeats"), F.sum("n_days").alias("corridor_days"), F.count_if(F.col("n_schedules") == 1).alias("one_schedule"),
    )
    rho = cluster_iccs(rows).where("what = 'trip'").select(F.greatest(F.lit(0.0), F.col("rho")).alias("rho_trip"))
    d = days.join(trips).join(per).join(rho)  # one row each
    return d.withColumn("trip_design_effect", 1 + (F.col("size") - 1) * F.col("rho_trip")).drop("size", "rho_trip")
