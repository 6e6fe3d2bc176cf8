"""A champion model on record: a challenger takes its place only if it is better, and only from the version it was judged against.

The record is a folder of versions, each written once.  Whoever wants to write version n + 1 first creates its claim, which
the file system grants once (on stores without exclusive creation, one promoter at a time).  Every judgement goes to the
history, promoted or not, so the history doesn't read as if every run won.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "version long, model string, mae double"
HISTORY = "round long, promoted boolean, challenger string, challenger_mae double, champion string, champion_mae double, version long, reason string"


class Outpaced(RuntimeError):
    """Another promotion took the version meanwhile; judge again against the new champion."""


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def champion(spark: SparkSession, path: str) -> tuple[int, str | None, float | None]:
    """Version, model and error of the champion on record; version 0 and nothing, if there is none."""
    at, fs = _path(spark, f"{path}/record")
    if not fs.exists(at):
        return 0, None, None
    last = spark.read.schema(RECORD).parquet(f"{path}/record").orderBy(F.col("version").desc()).first()
    return (last["version"], last["model"], last["mae"]) if last else (0, None, None)


def _claim(spark: SparkSession, path: str, version: int) -> None:
    at, fs = _path(spark, f"{path}/claims/{version}")
    try:
        fs.create(at, False).close()
    except Exception as e:
        raise Outpaced(f"version {version} of {path} is taken") from e


def promote(spark: SparkSession, path: str, metrics: DataFrame, number: int, against: tuple[int, str | None, float | None] | None = None) -> bool:
    """Judge the best of ``metrics`` (model, mae; ties by name) against the champion, record the outcome, and replace the
    champion if the challenger's error is smaller or there is none.

    ``against`` is the champion that the caller has seen (by default the one now on record); if another promotion came
    between, Outpaced is raised and nothing is recorded.
    """
    version, name, error = against or champion(spark, path)
    best = metrics.where("mae is not null").agg(F.min(F.struct("mae", "model")).alias("b")).first()["b"]
    if best is None:
        raise ValueError("no challenger has an error")
    better = error is None or best["mae"] < error
    reason = "no champion on record" if error is None else "smaller error" if better else "error not smaller"
    if better:
        _claim(spark, path, version + 1)
        spark.createDataFrame([(version + 1, best["model"], best["mae"])], RECORD).coalesce(1).write.mode("append").parquet(f"{path}/record")
    row = (number, better, best["model"], best["mae"], name, error, version + better, reason)
    spark.createDataFrame([row], HISTORY).coalesce(1).write.mode("append").parquet(f"{path}/history")
    return better


def history(spark: SparkSession, path: str) -> DataFrame:
    """All judgements: round, whether promoted, challenger and champion before it, the version then on record, and why."""
    return spark.read.schema(HISTORY).parquet(f"{path}/history")


def reporting_rule(candidates: DataFrame, served: str) -> DataFrame:
    """One row: of candidates (model, library, validation_mae, test_mae), the one to report, the least validation error whatever its
    library (ties by name), with its test error whatever that is; and the best of the library ``served``."""
    key = F.struct("validation_mae", "model", "library", "test_mae")
    best = candidates.agg(F.min(key).alias("a"), F.min(F.when(F.col("library") == served, key)).alias("b"))
    return best.select(
        F.col("a.model").alias("reported_model"), F.col("a.library").alias("reported_library"), F.col("a.validation_mae").alias("validation_mae"),
        F.col("a.test_mae").alias("test_mae"), F.col("b.model").alias("served_model"), F.col("b.test_mae").alias("served_test_mae"),
    )


def as_of_medians(predictions: DataFrame, medians: DataFrame, model: str = "asof_median") -> DataFrame:
    """Reference predictions with one more model: the median gap known at creation (0 where there is no history).

    ``predictions`` has a row per leg and model; ``medians`` (leg_id, n, median) a row per leg.
    """
    base = predictions.withColumn("_r", F.row_number().over(Window.partitionBy("leg_id").orderBy("model"))).where("_r = 1").drop("_r", "model", "predicted")
    own = medians.select("leg_id", F.when(F.col("n") > 0, F.col("median")).otherwise(0.0).alias("predicted"))
    return predictions.unionByName(base.join(own, "leg_id").withColumn("model", F.lit(model)).select(predictions.columns))
