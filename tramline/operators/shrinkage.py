"""Empirical-Bayes rankings of corridors at several floors of support, under several fits, all as rows.

A family is one floor with one kind of variance; the between-corridor variance of every family is fitted at once: moments in
one aggregate, (restricted) likelihood by a grid that is refined round each family's best point, one aggregate a round.  Only
families and grid points are small; corridors stay rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.rank import global_rank
from tramline.functions.tails import normal_cdf
from tramline.operators import audit
from tramline.sources.shared import written

#: Support floors, factor over the network's mean, and intraclass correlation of a corridor's legs of one schedule: fixed values.
FLOORS = [5, 10, 20, 30]
FACTOR = 1.5
SCHEDULE_ICC = 0.0953
#: Name, estimator, whether a corridor's variance is raised by its design effect, and factor: the main fit, two others, and two other thresholds.
FITS = [("reml", "reml", False, FACTOR), ("clustered", "reml", True, FACTOR), ("moments", "dl", False, FACTOR), ("reml_1.25", "reml", False, 1.25), ("reml_2", "reml", False, 2.0)]
POINTS, ROUNDS = 33, 8
_Z90 = 1.6448536269514722


def design_effects(legs: DataFrame, icc: float = SCHEDULE_ICC) -> DataFrame:
    """(corridor_id, cells, design_effect): 1 + (legs per schedule cell - 1) * icc, at least 1 leg a cell."""
    c = legs.groupBy("corridor_id", "schedule").agg(F.count("*").alias("n")).groupBy("corridor_id").agg(F.sum("n").alias("n"), F.count("*").alias("cells"))
    size = F.greatest(F.col("n") / F.col("cells"), F.lit(1.0))
    return c.select("corridor_id", "cells", (1 + (size - 1) * icc).alias("design_effect"))


def _loss(s: DataFrame, reml: Column) -> Column:
    """Twice the negative (restricted) log likelihood, up to a constant."""
    return s["lv"] + s["wyy"] - s["wy"] * s["wy"] / s["w"] + F.when(reml, F.log(s["w"])).otherwise(0.0)


def between_variances(df: DataFrame, family: list[str], y: str = "y", v: str = "v") -> DataFrame:
    """Per family: k units, dl (moments), ml and reml, each at least 0.

    The likelihoods' search goes from 0 to four times the variance of y; the grid's step after the last round is about 1e-12 of that.
    """
    w = 1 / F.col(v)
    t = df.groupBy(*family).agg(
        F.count("*").alias("k"), F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * F.col(y)).alias("wy"), F.sum(w * F.col(y) * F.col(y)).alias("wyy"),
        F.greatest(4 * F.var_pop(y), F.lit(1e-6)).alias("high"),
    )
    q = F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w") - (F.col("k") - 1)
    dl = F.greatest(F.lit(0.0), F.coalesce(q / F.nullif(F.col("w") - F.col("ww") / F.col("w"), F.lit(0.0)), F.lit(0.0)))
    moments = written(t.select(*family, "k", dl.alias("dl"), F.lit(0.0).alias("low"), "high"), "families")
    state = moments.withColumn("reml", F.explode(F.array(F.lit(True), F.lit(False))))
    rows = df.select(*family, F.col(y).alias("_y"), F.col(v).alias("_v"))
    for k in range(ROUNDS):
        step = (F.col("high") - F.col("low")) / (POINTS - 1)
        grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.col("low") + step * i))
        points = state.select(*family, "reml", step.alias("step"), grid.alias("tau2"))  # a few dozen rows a family
        u = 1 / (F.col("_v") + F.col("tau2"))
        s = rows.join(F.broadcast(points), family).groupBy(*family, "reml", "step", "tau2").agg(
            F.sum(F.log(F.col("_v") + F.col("tau2"))).alias("lv"), F.sum(u).alias("w"), F.sum(u * F.col("_y")).alias("wy"), F.sum(u * F.col("_y") * F.col("_y")).alias("wyy")
        )
        best = s.groupBy(*family, "reml").agg(F.min(F.struct(_loss(s, F.col("reml")).alias("loss"), "tau2", "step")).alias("b"))
        at, by = F.col("b.tau2"), F.col("b.step")
        state = written(best.select(*family, "reml", at.alias("best"), F.greatest(F.lit(0.0), at - by).alias("low"), (at + by).alias("high")), f"grid-{k}")
    fits = state.groupBy(*family).agg(F.max(F.when(F.col("reml"), F.col("best"))).alias("reml"), F.max(F.when(~F.col("reml"), F.col("best"))).alias("ml"))
    return moments.select(*family, "k", "dl").join(fits, family)


def posteriors(df: DataFrame, family: list[str], y: str = "y", v: str = "v", with_p: bool = True) -> DataFrame:
    """Shrunken mean, deviation with that of the common mean, 90 % interval, z and probability above the threshold, where
    tau2 and threshold stand beside each row."""
    u = 1 / (F.col(v) + F.col("tau2"))
    common = df.groupBy(*family).agg(F.sum(u).alias("_u"), (F.sum(u * F.col(y)) / F.sum(u)).alias("mu"))
    d = df.join(F.broadcast(common), family)  # one row a family
    b = F.col(v) / (F.col(v) + F.col("tau2"))
    d = d.withColumn("shrink", b).withColumn("post_mean", (1 - b) * F.col(y) + b * F.col("mu"))
    d = d.withColumn("post_sd", F.sqrt((1 - b) * F.col(v) + b * b / F.col("_u"))).drop("_u")
    d = d.withColumn("lo90", F.col("post_mean") - _Z90 * F.col("post_sd")).withColumn("hi90", F.col("post_mean") + _Z90 * F.col("post_sd"))
    d = d.withColumn("z", (F.col("post_mean") - F.col("threshold")) / F.nullif(F.col("post_sd"), F.lit(0.0)))
    return d.withColumn("p_exceed", normal_cdf(F.col("z"))) if with_p else d


def fitted(corridors: DataFrame, baseline: DataFrame, effects: DataFrame, floors: list[int] = FLOORS, fits: list[tuple] = FITS) -> DataFrame:
    """(fit, floor, corridor_id, y, v, k, tau2, threshold): every corridor that reaches a floor, under every fit.

    y is the mean log ratio, v its variance over legs (by the design effect, where the fit is clustered); the threshold is the
    network's mean and the logarithm of the fit's factor.  Corridors of one leg have no variance and are left out.
    """
    n, y = F.col("n_legs"), F.col("sum_log") / F.col("n_legs")
    v = F.greatest(F.lit(0.0), (F.col("sumsq_log") - n * y * y) / F.nullif(n - 1, F.lit(0))) / n
    base = corridors.select("corridor_id", "n_legs", y.alias("y"), v.alias("v")).where("v > 0").join(effects.select("corridor_id", "design_effect"), "corridor_id")
    grid = F.filter(F.array(*[F.lit(f) for f in floors]), lambda f: f <= F.col("n_legs"))
    kinds = F.array(F.struct(F.lit(False).alias("clustered"), F.lit(1.0).alias("by")), F.struct(F.lit(True).alias("clustered"), F.col("design_effect").alias("by")))
    rows = base.withColumn("floor", F.explode(grid)).withColumn("kind", F.explode(kinds))
    rows = written(rows.select("floor", "kind.clustered", "corridor_id", "y", (F.col("v") * F.col("kind.by")).alias("v")), "corridors")
    tau2 = between_variances(rows, ["floor", "clustered"])
    which = F.array(*[
        F.struct(F.lit(name).alias("fit"), F.lit(c).alias("c"), F.col(estimator).alias("tau2"), F.lit(math.log(factor)).alias("over")) for name, estimator, c, factor in fits
    ])
    tau2 = tau2.withColumn("f", F.explode(which)).where("f.c = clustered").select("floor", "clustered", "k", "f.fit", "f.tau2", "f.over")
    mean = baseline.select((F.col("net_sum") / F.col("net_n")).alias("net_mean"))
    d = rows.join(F.broadcast(tau2), ["floor", "clustered"]).join(F.broadcast(mean))  # rows of fits and floors; one row
    return d.select("fit", "floor", "corridor_id", "y", "v", "k", "tau2", (F.col("net_mean") + F.col("over")).alias("threshold"))


def floor_rankings(corridors: DataFrame, baseline: DataFrame, effects: DataFrame, floors: list[int] = FLOORS, fits: list[tuple] = FITS, alpha: float = 0.05) -> DataFrame:
    """(fit, floor, ranking, corridor_id, pos, eligible): four orders of the corridors that reach each floor, under every fit.

    raw_published: confirmed slower ones first, by excess ratio, and only these eligible; raw_mean: by mean; eb_prob: by z
    above the threshold (the order of the probability), then by posterior mean; eb_postmean: by posterior mean.  Positions
    are ranks in one range exchange over all orders.
    """
    post = posteriors(fitted(corridors, baseline, effects, floors, fits), ["fit", "floor"], with_p=False)
    grid = F.filter(F.array(*[F.lit(f) for f in floors]), lambda f: f <= F.col("n_legs"))
    tested = audit.ranked(audit.welch(corridors, baseline).withColumn("floor", F.explode(grid)), alpha, ["floor"])
    slow = F.col("is_significant") & (F.col("direction") == "worse")
    d = post.join(tested.select("floor", "corridor_id", "excess_ratio", slow.alias("slow")), ["floor", "corridor_id"])
    none, yes = F.lit(0.0), F.lit(True)
    score = lambda name, first, then, may: F.struct(F.lit(name).alias("ranking"), first.alias("first"), then.alias("then"), may.alias("eligible"))
    ways = F.array(
        score("raw_published", F.col("slow").cast("double"), F.col("excess_ratio"), F.col("slow")), score("raw_mean", F.col("y"), none, yes),
        score("eb_prob", F.col("z"), F.col("post_mean"), yes), score("eb_postmean", F.col("post_mean"), none, yes),
    )
    long = d.select("fit", "floor", "corridor_id", F.explode(ways).alias("s")).select("fit", "floor", "corridor_id", "s.*")
    # Scores to nine digits: where nothing differs between corridors, shrunken means are equal but for the last bits.
    long = long.withColumn("first", F.round("first", 9)).withColumn("then", F.round("then", 9))
    order = [F.col("fit"), F.col("floor"), F.col("ranking"), F.col("first").desc_nulls_last(), F.col("then").desc_nulls_last(), F.col("corridor_id")]
    ranks = written(global_rank(long, order, "_rank"), "ranks")
    begins = ranks.groupBy("fit", "floor", "ranking").agg((F.min("_rank") - 1).alias("_before"))
    ranks = ranks.join(F.broadcast(begins), ["fit", "floor", "ranking"])  # one row an order
    return ranks.select("fit", "floor", "ranking", "corridor_id", (F.col("_rank") - F.col("_before")).alias("pos"), "eligible")


def pair_stability(ranks: DataFrame, n: int = 20) -> DataFrame:
    """Per fit, ranking and pair of floors: Jaccard of the first n eligible, the same within the corridors of both floors, the rank
    correlation of positions over these, and their number.

    Floors nest, so a corridor of the higher floor is in both; its place among them is its order at the lower one, which
    again is a rank over all orders at once.
    """
    by = ["fit", "ranking"]
    a = ranks.select(*by, "corridor_id", F.col("floor").alias("a"), F.col("pos").alias("pa"), F.col("eligible").alias("ea"))
    b = ranks.select(*by, "corridor_id", F.col("floor").alias("b"), F.col("pos").alias("pb"), F.col("eligible").alias("eb"))
    shared = a.join(b, [*by, "corridor_id"]).where("a < b")
    placed = written(global_rank(shared, [*map(F.col, [*by, "a", "b", "pa"])], "_rank"), "shared")
    begins = placed.groupBy(*by, "a", "b").agg((F.min("_rank") - 1).alias("_before"))
    placed = placed.join(F.broadcast(begins), [*by, "a", "b"]).withColumn("ca", F.col("_rank") - F.col("_before"))
    top = lambda e, p: F.count_if(F.col(e) & (F.col(p) <= n))
    # The common set's first n are those of the lower floor that are eligible and among its first n corridors of both.
    sums = placed.withColumn("ia", F.col("ea") & (F.col("pa") <= n)).withColumn("ic", F.col("ea") & (F.col("ca") <= n)).withColumn("ib", F.col("eb") & (F.col("pb") <= n))
    sums = sums.groupBy(*by, "a", "b").agg(
        F.count_if(F.col("ia") & F.col("ib")).alias("both"), F.count_if(F.col("ic") & F.col("ib")).alias("both_c"), F.count_if("ic").alias("size_c"),
        F.corr("pa", "pb").alias("_r"), F.corr("ca", "pb").alias("rho"), F.count("*").alias("corridors"),
    )
    size = ranks.groupBy(*by, "floor").agg(top("eligible", "pos").alias("size"))
    sums = sums.join(size.withColumnsRenamed({"floor": "a", "size": "na"}), [*by, "a"]).join(size.withColumnsRenamed({"floor": "b", "size": "nb"}), [*by, "b"])
    jaccard = lambda both, x, y: F.col(both) / F.nullif(F.col(x) + F.col(y) - F.col(both), F.lit(0))
    return sums.select(*by, "a", "b", jaccard("both", "na", "nb").alias("jaccard"), jaccard("both_c", "size_c", "nb").alias("common_jaccard"), "rho", "corridors")


def mean_jaccard(stability: DataFrame) -> DataFrame:
    """Per fit and ranking: the mean of the pairs' Jaccard similarities (pairs without any eligible corridor left out)."""
    return stability.groupBy("fit", "ranking").agg(F.avg("jaccard").alias("mean_jaccard"), F.count("jaccard").alias("pairs"))
