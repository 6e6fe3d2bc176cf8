"""A session with the settings that the operators expect: UTC, adaptive execution, Arrow."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession | None) -> None:
    """Let Python workers import this package wherever the driver was started."""
    if spark is None:
        return
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def session(name: str = "tramline", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution sizes and splits shuffle partitions; give a cluster's own settings as conf."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
