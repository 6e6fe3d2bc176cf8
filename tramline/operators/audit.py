"""Corridor audit: each corridor against the rest of the network, with false-discovery control, at any support floor.

Corridors are compared with the network without themselves, by subtraction of sums, so one aggregate serves all tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.tails import t_two_sided


def usable_legs(legs: DataFrame) -> DataFrame:
    """Legs on which the audited statistic is defined: a positive plan and a finite log ratio."""
    r = F.col("log_gap_ratio")
    return legs.where((F.col("planned_min") > 0) & r.isNotNull() & ~F.isnan(r) & (F.abs(r) < float("inf")))


def statistic_agrees(legs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: legs, and those whose stored log ratio or late flag differs from a recomputation."""
    again = F.log(F.col("actual_time") / F.col("planned_min"))
    late = F.col("gap_min") > F.col("planned_min")
    return legs.agg(
        F.count("*").alias("legs"), F.count_if(F.abs(again - F.col("log_gap_ratio")) > tolerance).alias("ratio_differs"), F.count_if(late != F.col("is_delayed")).alias("flag_differs")
    )


def with_extras(corridors: DataFrame, extras: list[DataFrame]) -> DataFrame:
    """Corridors with optional tables of more columns; a table that isn't there (None) is left out."""
    for e in extras:
        if e is not None:
            corridors = corridors.join(e, "corridor_id", "left")
    return corridors


def network_baseline(legs: DataFrame) -> DataFrame:
    """One row: number, sum and sum of squares of the log ratios, and total gap."""
    r = F.col("log_gap_ratio")
    return legs.agg(F.count(r).alias("net_n"), F.sum(r).alias("net_sum"), F.sum(r * r).alias("net_sumsq"), F.sum("gap_min").alias("net_gap"))


def corridor_aggregate(legs: DataFrame) -> DataFrame:
    """One row per corridor: support, sums, centre and spread of gaps and plans, share late, distinct schedules and trips.

    Attributes that a corridor should have once are taken as its least value, not as whichever comes first.
    """
    r = F.col("log_gap_ratio")
    # One buffer of a corridor's gaps serves both percentiles.
    gaps = F.percentile("gap_min", [0.5, 0.9])
    stats = legs.groupBy("corridor_id").agg(
        F.min("source_center").alias("source_center"), F.min("destination_center").alias("destination_center"),
        F.count(r).alias("n_legs"), F.sum(r).alias("sum_log"), F.sum(r * r).alias("sumsq_log"),
        F.avg("gap_min").alias("mean_gap_min"), gaps[0].alias("median_gap_min"), gaps[1].alias("p90_gap_min"),
        F.sum("gap_min").alias("sum_gap_min"), F.avg("gap_ratio").alias("mean_gap_ratio"), F.percentile("gap_ratio", 0.5).alias("median_gap_ratio"),
        F.avg("planned_min").alias("mean_planned_min"), F.avg("planned_km").alias("mean_km"), F.avg("actual_time").alias("mean_actual_min"),
        F.avg("dwell_min").alias("mean_dwell_min"), F.avg(F.col("is_delayed").cast("double")).alias("delayed_share"),
        F.avg((F.col("route_type") == "FTL").cast("double")).alias("ftl_share"),
        F.min("od_end_time").alias("first_end"), F.max("od_end_time").alias("last_end"),
    )
    # Distinct counts go apart: beside percentiles, every distinct pair would carry percentile buffers of its own.
    distinct = legs.groupBy("corridor_id").agg(F.count_distinct("trip_uuid").alias("n_trips"), F.count_distinct("schedule").alias("n_schedules"))
    return stats.join(distinct, "corridor_id", "left")  # goes away where the counts are not used


def welch(corridors: DataFrame, baseline: DataFrame, with_p: bool = True) -> DataFrame:
    """Welch's comparison of each corridor with the others: means, excess ratio, t, degrees of freedom, effect size, p.

    Needs n_legs, sum_log, sumsq_log; a corridor of one leg, or the whole network, has nulls.
    """
    out = welch_beside(corridors.join(F.broadcast(baseline)), corridors.columns)  # one row
    return out.withColumn("p_value", t_two_sided(F.col("t_stat"), F.col("dof"))) if with_p else out


def welch_beside(d: DataFrame, keep: list[str]) -> DataFrame:
    """The comparison where net_n, net_sum and net_sumsq already stand beside each corridor."""
    n, m = F.col("n_legs"), F.col("net_n") - F.col("n_legs")
    none = F.nullif
    mean, rest = F.col("sum_log") / n, (F.col("net_sum") - F.col("sum_log")) / none(m, F.lit(0))
    var = F.greatest(F.lit(0.0), (F.col("sumsq_log") - n * mean * mean) / none(n - 1, F.lit(0)))
    rest_var = F.greatest(F.lit(0.0), (F.col("net_sumsq") - F.col("sumsq_log") - m * rest * rest) / none(m - 1, F.lit(0)))
    var, rest_var = F.when(n > 1, var), F.when(m > 1, rest_var)
    a, b = var / n, rest_var / none(m, F.lit(0))
    pooled = F.sqrt(((n - 1) * var + (m - 1) * rest_var) / none(n + m - 2, F.lit(0)))
    return d.select(
        *keep, mean.alias("mean_log"), var.alias("var_log"), rest.alias("rest_mean_log"), F.exp(mean - rest).alias("excess_ratio"),
        ((mean - rest) / none(F.sqrt(a + b), F.lit(0.0))).alias("t_stat"),
        ((a + b) * (a + b) / none(a * a / none(n - 1, F.lit(0)) + b * b / none(m - 1, F.lit(0)), F.lit(0.0))).alias("dof"),
        ((mean - rest) / none(pooled, F.lit(0.0))).alias("cohens_d"),
    )


def adjusted(df: DataFrame, p: str, family: list[str], kind: str = "bh", key: str = "corridor_id", name: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg (bh), Benjamini-Yekutieli (by) or Holm (holm) adjusted p within each family; null p counts as 1."""
    value = F.coalesce(F.col(p), F.lit(1.0))
    up = Window.partitionBy(*family).orderBy(value, key) if family else Window.partitionBy(F.lit(0)).orderBy(value, key)
    whole = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    d = df.withColumn("_r", F.row_number().over(up)).withColumn("_m", F.count("*").over(whole))
    if kind == "holm":
        upto = up.rowsBetween(Window.unboundedPreceding, 0)
        out = F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_r") + 1) * value).over(upto))
    else:
        # Ranks are 1 .. m, so the harmonic number is the family's sum of their inverses: once a family.
        c = F.sum(1.0 / F.col("_r")).over(whole) if kind == "by" else F.lit(1.0)
        down = Window.partitionBy(*(family or [F.lit(0)])).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
        out = F.least(F.lit(1.0), F.min(value * F.col("_m") * c / F.col("_r")).over(down))
    return d.withColumn(name, out).drop("_r", "_m")


def ranked(tested: DataFrame, alpha: float = 0.05, family: list[str] | None = None) -> DataFrame:
    """Significance, direction, and a dense rank of the confirmed slower corridors by excess ratio."""
    d = adjusted(tested, "p_value", family or [])
    slow = (F.col("q_value") <= alpha) & (F.col("excess_ratio") >= 1)
    w = Window.partitionBy(*(family or []), slow).orderBy(F.col("excess_ratio").desc(), "corridor_id")
    return (
        d.withColumn("is_significant", F.col("q_value") <= alpha)
        .withColumn("direction", F.when(F.col("excess_ratio") >= 1, "worse").otherwise("better"))
        .withColumn("bottleneck_rank", F.when(slow, F.row_number().over(w)))
    )


def audit(legs: DataFrame, floor: int = 10, alpha: float = 0.05) -> DataFrame:
    """The whole audit at one floor: only supported corridors are tested, and corrected among themselves."""
    return ranked(welch(corridor_aggregate(legs).where(F.col("n_legs") >= floor), network_baseline(legs)), alpha)


def audit_floors(legs: DataFrame, floors: list[int], alpha: float = 0.05) -> DataFrame:
    """All floors in one plan: each corridor is repeated for the floors it reaches, and each floor is its own family."""
    tested = welch(corridor_aggregate(legs), network_baseline(legs))
    grid = F.filter(F.array(*[F.lit(f) for f in floors]), lambda f: f <= F.col("n_legs"))
    return ranked(tested.withColumn("floor", F.explode(grid)), alpha, ["floor"])


def floor_summary(at_floors: DataFrame) -> DataFrame:
    return at_floors.groupBy("floor").agg(
        F.count("*").alias("tested"), F.count_if("is_significant").alias("significant"), F.count("bottleneck_rank").alias("slower")
    )


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows; Spark keeps n per task and merges them."""
    return df.orderBy(*order).limit(n)


#: Variants of the audit, and the order in which equals are preferred.
VARIANTS = ["by_perm", "bh_perm", "by_welch", "bh_welch"]


def variants(tested: DataFrame, alpha: float = 0.05, key: str = "corridor_id") -> DataFrame:
    """Rows of ``tested`` (key, excess_ratio, p_welch, p_perm) with q and significance of the four variants, and direction."""
    for name in VARIANTS:
        kind, p = name.split("_")
        tested = adjusted(tested, f"p_{p}", [], kind, key, f"q_{name}").withColumn(f"sig_{name}", F.col(f"q_{name}") <= alpha)
    return tested.withColumn("direction", F.when(F.col("excess_ratio") >= 1, "worse").otherwise("better"))


def variant_counts(table: DataFrame) -> DataFrame:
    """(variant, slower, faster): significant corridors of each variant by direction."""
    side = lambda v, way: F.count_if(F.col(f"sig_{v}") & (F.col("direction") == way))
    rows = [F.struct(F.lit(v).alias("variant"), F.col(f"_{v}_s").alias("slower"), F.col(f"_{v}_f").alias("faster")) for v in VARIANTS]
    counts = table.agg(*[side(v, w).alias(f"_{v}_{n}") for v in VARIANTS for n, w in (("s", "worse"), ("f", "better"))])
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def headline(table: DataFrame) -> DataFrame:
    """The table of ``variants`` with headline_variant and status.

    The headline is the variant with the fewest slower corridors, then the fewest faster ones, then the first of VARIANTS.
    A corridor is robust if it and bh_welch find it, fragile if only bh_welch does, headline_only if only the headline does.
    """
    place = F.array_position(F.array(*[F.lit(v) for v in VARIANTS]), F.col("variant"))
    head = variant_counts(table).agg(F.min_by("variant", F.struct("slower", "faster", place.alias("place"))).alias("headline_variant"))
    t = table.join(F.broadcast(head))  # one row
    by_head = F.element_at(F.create_map(*[x for v in VARIANTS for x in (F.lit(v), F.col(f"sig_{v}"))]), F.col("headline_variant"))
    first = F.col("sig_bh_welch")
    status = F.when(by_head & first, "robust").when(first, "fragile").when(by_head, "headline_only").otherwise("not_significant")
    return t.withColumn("status", status)


def severity(excess: Column, direction: Column) -> Column:
    """Label of an excess ratio by direction; a step holds its upper end."""
    # The steps and their labels.
    worse = F.when(excess <= 1.20, "mildly worse").when(excess <= 1.50, "clearly worse").when(excess <= 2.50, "severe").otherwise("extreme")
    better = F.when(excess <= 0.60, "extreme").when(excess <= 0.75, "much better").when(excess <= 0.90, "clearly better").otherwise("mildly better")
    return F.when(direction == "worse", worse).otherwise(better)
