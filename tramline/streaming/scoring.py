"""Scoring and alerts inside the micro-batch, booked when finished.

A batch writes its scored rows, then its alerts, then one line in the ledger.  Each part goes to the batch's own folder and
replaces what an interrupted attempt left there, and readers only see batches that the ledger has: a batch that is
killed at any point and run again is neither lost nor doubled.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators.business import flag_alerts

from .job import assembled

LEDGER = "batch_id long, queries long, facts long, late_facts long, alerts long, seconds double"


def baseline(features: DataFrame, least: int = 5) -> DataFrame:
    """Predicted gap by the corridor's median where it has ``least`` facts, else the source's mean, else none."""
    corridor = F.when(F.col("corr_n_prior") >= least, F.col("corr_median_gap_min"))
    return features.withColumn("predicted_gap", F.coalesce(corridor, "src_mean_gap_min", F.lit(0.0)))


class ScoringSink:
    """A sink for ``job.drain`` over ``job.histories``: features, predictions and alerts of each batch under ``path``."""

    def __init__(self, path: str, predict: Callable[[DataFrame], DataFrame] = baseline, threshold: float = 2.0):
        self.path, self.predict, self.threshold = path, predict, threshold

    def _write(self, df: DataFrame, what: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{what}/batch_id={batch_id}")

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        spark, began = rows.sparkSession, time.monotonic()
        # Read from the written rows on, so that the state is computed once.
        self._write(rows, "history", batch_id)
        rows = spark.read.schema(rows.schema).parquet(f"{self.path}/history/batch_id={batch_id}")
        self._write(self.predict(assembled(rows)), "scored", batch_id)
        scored = spark.read.parquet(f"{self.path}/scored/batch_id={batch_id}")
        self._write(flag_alerts(scored, self.threshold), "alerts", batch_id)
        alerts = spark.read.parquet(f"{self.path}/alerts/batch_id={batch_id}").agg(F.count("*").alias("alerts"))
        # The corridor's row counts each fact once.
        facts = rows.where("row_kind = 'summary' and key_type = 'corridor'")
        facts = facts.agg(F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"), F.coalesce(F.sum("late_facts"), F.lit(0)).alias("late_facts"))
        booked = scored.agg(F.count("*").alias("queries")).join(facts).join(alerts)
        self._write(booked.select("queries", "facts", "late_facts", "alerts", F.lit(time.monotonic() - began).alias("seconds")).coalesce(1), "ledger", batch_id)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per finished batch: batch_id, queries, facts, late_facts, alerts and seconds of work before booking."""
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger").select([c.split()[0] for c in LEDGER.split(", ")])


def finished(spark: SparkSession, path: str, what: str) -> DataFrame:
    """The ``scored`` or ``alerts`` rows of batches that the ledger has; with their batch_id."""
    rows = spark.read.parquet(f"{path}/{what}").withColumn("batch_id", F.col("batch_id").cast("long"))
    return rows.join(ledger(spark, path).select("batch_id"), "batch_id", "left_semi")
