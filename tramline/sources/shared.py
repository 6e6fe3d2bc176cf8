"""Tables written to the folder that the driver and all executors share, to cut lineage or to be read several times alike."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, as a cluster names it; a local one only where it is unset, on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"/tmp/tramline-{spark.sparkContext.applicationId}"
    return named.rstrip("/")


#: Spark then removes the shuffle files of a query when it ends, not when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """The same rows, from Parquet: what follows sees one copy, however often it is read.

    ``lean`` is for wide or many rows behind large shuffles: they take less disk, and the shuffles go as soon as the rows are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if lean:
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
