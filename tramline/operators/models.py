"""Delay models on MLlib: preparation, splits, baselines, fits, evaluation and decision rules."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.columns import micros, ratio

HISTORY = ["corr_mean_gap_min", "src_mean_gap_min", "dst_mean_gap_min", "corr_std_log_ratio", "corr_last_log_ratio"]
BASE = ["planned_min", "planned_km", "created_hour", "is_ftl"]
COUNTS = ["corr_n_prior", "src_n_prior", "dst_n_prior"]
INPUTS = BASE + COUNTS + HISTORY + ["corr_cold", "src_cold", "dst_cold"]


def prepared(features: DataFrame) -> DataFrame:
    """Model inputs: route flag, cold indicators, and zeros for history that doesn't exist yet."""
    d = features.withColumn("is_ftl", (F.col("route_type") == "FTL").cast("double"))
    for p in ("corr", "src", "dst"):
        d = d.withColumn(f"{p}_cold", (F.col(f"{p}_n_prior") == 0).cast("double"))
    return d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in HISTORY + COUNTS + BASE})


def fill_violations(features: DataFrame) -> DataFrame:
    """One row: null histories of legs that do have history, which the zero fill would hide."""
    return features.agg(*[F.count_if(F.col(f"{p}_mean_gap_min").isNull() & (F.col(f"{p}_n_prior") > 0)).alias(p) for p in ("corr", "src", "dst")])


#: Spans into which a range of times is cut in one round of ``time_cut``.
SPANS = 4096


def time_cut(legs: DataFrame, share: float) -> float | None:
    """The share's exact quantile of creation times in microseconds, interpolated as ``percentile`` does; none without times.

    Rows are counted in equal spans of time, and the span that holds the quantile's place is cut again until it is one microsecond
    wide.  The driver sees at most SPANS counts a round; ``percentile`` would hold every distinct time in one task.
    """
    t = legs.select(micros("trip_creation_time").alias("t")).where("t is not null")
    first, last, n = t.agg(F.min("t"), F.max("t"), F.count("*")).first()
    if not n:
        return None
    place = share * (n - 1)
    below, at = 0, n
    while first < last:
        width = (last - first) // SPANS + 1
        span = F.expr(f"(t - {first}L) div {width}L")
        for r in sorted(t.where(F.col("t").between(first, last)).groupBy(span.alias("span")).agg(F.count("*").alias("rows")).collect()):
            at = r["rows"]
            if below + at > math.floor(place):
                break
            below += at
        first += r["span"] * width
        last = min(last, first + width - 1)
    if below + at > math.ceil(place):
        return float(first)
    after = t.where(F.col("t") > first).agg(F.min("t")).first()[0]
    return (math.ceil(place) - place) * first + (place - math.floor(place)) * after


def time_split(legs: DataFrame, share: float = 0.8) -> DataFrame:
    """Add part: train up to the share's quantile of creation time, test after it.  The quantile is taken once, now, so that no pass
    of a fit takes it again."""
    cut = F.lit(time_cut(legs, share)).cast("double")
    return legs.withColumn("part", F.when(micros("trip_creation_time") <= cut, "train").otherwise("test"))


def rolling_folds(legs: DataFrame, folds: list[tuple[int, int, int]]) -> DataFrame:
    """Rows of (fold, part): days from the first one on; a fold trains before ``a`` and tests in [a, b)."""
    first = legs.agg(F.min(F.col("trip_creation_time").cast("date")).alias("_first"))
    d = legs.join(F.broadcast(first)).withColumn("day", F.datediff(F.col("trip_creation_time").cast("date"), "_first")).drop("_first")  # one row
    grid = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(a).alias("a"), F.lit(b).alias("b")) for f, a, b in folds])
    d = d.withColumn("f", F.explode(grid)).where("day < f.b")
    return d.withColumn("fold", F.col("f.fold")).withColumn("part", F.when(F.col("day") < F.col("f.a"), "train").otherwise("test")).drop("f")


def baselines(features: DataFrame) -> DataFrame:
    """Long (leg_id, model, predicted): the plan itself, the as-of mean of the corridor, and the plan's share of it."""
    rows = {"plan": F.lit(0.0), "asof_mean": F.coalesce("corr_mean_gap_min", F.lit(0.0)), "asof_ratio": F.coalesce((F.exp("corr_mean_log_ratio") - 1) * F.col("planned_min"), F.lit(0.0))}
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), e.alias("predicted")) for n, e in rows.items()]))
    return features.select("leg_id", one.alias("m")).select("leg_id", "m.*")


def majority_class(train: DataFrame, test: DataFrame, label: str = "is_delayed") -> DataFrame:
    """One row: share of the training majority's class in the test rows."""
    m = train.agg((F.avg(F.col(label).cast("double")) >= 0.5).alias("majority"))
    return test.join(F.broadcast(m)).agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col("majority")).cast("double")).alias("accuracy"))  # one row


def regression_metrics(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.percentile(F.abs(e), 0.5).alias("median_error"))


def class_metrics(df: DataFrame, label: Column, flag: Column, by: list[str]) -> DataFrame:
    """Confusion counts and what follows from them, in one aggregate per group."""
    tp, fp, fn, tn = (F.count_if(x).cast("double") for x in (label & flag, ~label & flag, label & ~flag, ~label & ~flag))
    d = df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    a, b, c, e = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return (
        d.withColumn("precision", ratio(a, a + b)).withColumn("recall", ratio(a, a + c)).withColumn("accuracy", ratio(a + e, a + b + c + e))
        .withColumn("f1", ratio(2 * a, 2 * a + b + c)).withColumn("balanced", (ratio(a, a + c) + ratio(e, e + b)) / 2)
        .withColumn("mcc", (a * e - b * c) / F.nullif(F.sqrt((a + b) * (a + c) * (e + b) * (e + c)), F.lit(0.0)))
        .withColumn("majority", F.greatest(a + c, b + e) / (a + b + c + e))
    )


def threshold_sweep(predictions: DataFrame, thresholds: list[float]) -> DataFrame:
    """Class metrics of every model at every threshold of lateness: label and prediction cross it strictly."""
    d = predictions.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    limit = (F.col("threshold") - 1) * F.col("planned_min")
    return class_metrics(d, F.col("gap_min") > limit, F.col("predicted") > limit, ["model", "threshold"])


def slice_table(predictions: DataFrame, bar: str) -> DataFrame:
    """Mean absolute error of each model on slices (all, route, part of day, cold corridor) and its difference to the bar's."""
    of = F.array(
        F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("slice")), F.struct(F.lit("route").alias("dimension"), F.col("route_type").alias("slice")),
        F.struct(F.lit("part").alias("dimension"), F.col("created_part").alias("slice")),
        F.struct(F.lit("history").alias("dimension"), F.when(F.col("corr_n_prior") == 0, "cold").when(F.col("corr_n_prior") < 10, "thin").otherwise("warm").alias("slice")),
    )
    t = predictions.select("model", F.abs(F.col("gap_min") - F.col("predicted")).alias("e"), F.explode(of).alias("s")).groupBy("model", "s.dimension", "s.slice").agg(F.count("*").alias("n"), F.avg("e").alias("mae"))
    b = t.where(F.col("model") == bar).select("dimension", "slice", F.col("mae").alias("bar_mae"))
    return t.join(b, ["dimension", "slice"]).withColumn("delta", F.col("mae") - F.col("bar_mae"))


def corridor_gains(predictions: DataFrame, model: str, bar: str) -> DataFrame:
    e = F.abs(F.col("gap_min") - F.col("predicted"))
    of = lambda m: F.avg(F.when(F.col("model") == m, e))
    return predictions.groupBy("corridor_id").agg(F.count_if(F.col("model") == model).alias("n"), of(model).alias("mae"), of(bar).alias("bar_mae")).withColumn("gain", F.col("bar_mae") - F.col("mae"))


def decision(metrics: DataFrame, bar: str, least_gain: float) -> DataFrame:
    """One row: the model with the least error, and whether it beats the bar by enough to be adopted."""
    best = metrics.where(F.col("model") != bar).agg(F.min(F.struct("mae", "model")).alias("b"))
    base = metrics.where(F.col("model") == bar).select(F.col("mae").alias("bar_mae"))
    d = best.join(base).select("b.model", "b.mae", "bar_mae")  # one row each
    return d.withColumn("gain", F.col("bar_mae") - F.col("mae")).withColumn("outcome", F.when(F.col("gain") >= least_gain, "adopt").when(F.col("gain") > 0, "report only").otherwise("keep the bar"))


# ---- fits -----------------------------------------------------------------------------------------------------------
def _assembled(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error")


def linear(train: DataFrame, columns: list[str] = INPUTS, target: str = "gap_min") -> PipelineModel:
    return Pipeline(stages=[_assembled(columns), LinearRegression(labelCol=target, predictionCol="predicted", regParam=1e-6)]).fit(train)


def logistic(train: DataFrame, columns: list[str] = INPUTS, label: str = "label") -> PipelineModel:
    d = train.withColumn(label, F.col("is_delayed").cast("double"))
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    return Pipeline(stages=[_assembled(columns), scale, LogisticRegression(featuresCol="scaled", labelCol=label, regParam=1e-4)]).fit(d)


def coefficients(model: PipelineModel, columns: list[str] = INPUTS) -> list[tuple[str, float]]:
    c = model.stages[-1].coefficients
    return [(n, float(v)) for n, v in zip(columns, c, strict=True)]


def tuned(train: DataFrame, kind: str = "rf", folds: int = 3, columns: list[str] = INPUTS, target: str = "gap_min", seed: int = 5):
    """Random forest or boosted trees by a small grid and k-fold cross-validation on mean absolute error."""
    est = (RandomForestRegressor if kind == "rf" else GBTRegressor)(labelCol=target, predictionCol="predicted", seed=seed)
    grid = ParamGridBuilder().addGrid(est.maxDepth, [3, 5])
    grid = grid.addGrid(est.numTrees, [20]) if kind == "rf" else grid.addGrid(est.maxIter, [10])
    judge = RegressionEvaluator(labelCol=target, predictionCol="predicted", metricName="mae")
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid.build(), evaluator=judge, numFolds=folds, seed=seed, parallelism=2)
    inputs = _assembled(columns)
    # Folds are cached: they hold what a fit reads, not the table's other columns and the inputs a second time.
    return PipelineModel(stages=[inputs, cv.fit(inputs.transform(train).select("features", target))])


def residual_boosting(train: DataFrame, base: str, columns: list[str] = INPUTS, target: str = "gap_min", step: float = 0.1, rounds: int = 20, seed: int = 5) -> PipelineModel:
    """Boosted trees with absolute loss on what a baseline column leaves over; ``residual_prediction`` adds it back."""
    d = train.withColumn("residual", F.col(target) - F.col(base))
    g = GBTRegressor(labelCol="residual", predictionCol="residual_hat", lossType="absolute", stepSize=step, maxIter=rounds, checkpointInterval=10, seed=seed)
    return Pipeline(stages=[_assembled(columns), g]).fit(d)


def residual_prediction(model: PipelineModel, df: DataFrame, base: str) -> DataFrame:
    return model.transform(df).withColumn("predicted", F.col(base) + F.col("residual_hat")).drop("features", "residual_hat")


def choose_step(train: DataFrame, valid: DataFrame, base: str, steps: list[float]) -> tuple[float, float]:
    """Step size with the least error on validation rows; one small aggregate per step."""
    scores = []
    for s in steps:
        p = residual_prediction(residual_boosting(train, base, step=s, rounds=10), valid, base)
        scores.append((p.agg(F.avg(F.abs(F.col("gap_min") - F.col("predicted")))).first()[0], s))
    mae, step = min(scores)
    return step, mae


def importances(model, columns: list[str] = INPUTS) -> list[tuple[str, float]]:
    last = model.stages[-1]
    best = getattr(last, "bestModel", last)
    return sorted(zip(columns, (float(x) for x in best.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


def ablation(train: DataFrame, test: DataFrame, blocks: dict[str, list[str]], target: str = "gap_min") -> list[tuple[str, float]]:
    """Error of a linear model without each block of inputs, at fixed parameters."""
    out = []
    for name, gone in {"none": [], **blocks}.items():
        cols = [c for c in INPUTS if c not in gone]
        p = linear(train, cols, target).transform(test)
        out.append((name, p.agg(F.avg(F.abs(F.col(target) - F.col("predicted")))).first()[0]))
    return out


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Batch scoring that keeps the row's own key; no order is relied on."""
    return model.transform(df).select("leg_id", "predicted")


def rolling_origin(features: DataFrame, folds: list[tuple[int, int, int]]) -> list[tuple[int, float]]:
    """Error of a linear model per fold: fitted on what came before, judged on what follows."""
    rows = rolling_folds(features, folds)
    out = []
    for f, _, _ in folds:
        d = rows.where(F.col("fold") == f)
        p = linear(d.where("part = 'train'")).transform(d.where("part = 'test'"))
        out.append((f, p.agg(F.avg(F.abs(F.col("gap_min") - F.col("predicted")))).first()[0]))
    return out
