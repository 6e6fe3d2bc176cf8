"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_COLUMNS = {
    "data": "string", "trip_creation_time": "string", "route_schedule_uuid": "string", "route_type": "string", "trip_uuid": "string",
    "source_center": "string", "source_name": "string", "destination_center": "string", "destination_name": "string",
    "od_start_time": "string", "od_end_time": "string", "start_scan_to_end_scan": "double", "is_cutoff": "string", "cutoff_factor": "double",
    "cutoff_timestamp": "string", "actual_distance_to_destination": "double", "actual_time": "double", "osrm_time": "double", "osrm_distance": "double",
    "factor": "double", "segment_actual_time": "double", "segment_osrm_time": "double", "segment_osrm_distance": "double", "segment_factor": "double",
}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in columns.items())


def read_pinned_csv(spark: SparkSession, path: str, columns: dict[str, str] = SEGMENT_COLUMNS) -> DataFrame:
    """CSV with a fixed schema; a file with another header is refused; lines that don't parse are kept in _corrupt_record."""
    header = spark.read.option("header", True).csv(path).columns
    if header != list(columns):
        raise ValueError(f"columns changed: missing {sorted(set(columns) - set(header))}, extra {sorted(set(header) - set(columns))}")
    return spark.read.schema(f"{ddl(columns)}, _corrupt_record string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)


def with_row_index(df: DataFrame, name: str = "source_row_index") -> DataFrame:
    """A stable number of each row: file, place of its block in the file, and order within the block."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    d = df.select("*", place.alias("_p"))
    blocks = d.groupBy("_p.file", "_p.block").agg(F.min("_p.n").alias("first"), F.count("*").alias("rows"))
    from pyspark.sql import Window

    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(F.struct("file", "block").alias("_b"), "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    on = (F.col("_p.file") == F.col("_b.file")) & (F.col("_p.block") == F.col("_b.block"))
    return d.join(F.broadcast(starts), on).withColumn(name, F.col("base") + F.col("_p.n") - F.col("first")).drop("_p", "_b", "first", "base")


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_lookup(df: DataFrame, path: str) -> None:
    """A small table as one file."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str, *order: str) -> None:
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file under a path."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def read_json_log(spark: SparkSession, path: str, schema: T.StructType | str, newest: str, n: int | None = None, **equal: str) -> DataFrame:
    """Lines of JSON, broken ones skipped, newest first, filtered by equal values, n at most."""
    fields = schema if isinstance(schema, str) else schema.simpleString()
    d = spark.read.schema(f"{fields}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    d = d.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record") if not isinstance(schema, str) else d.where("_corrupt_record is null").drop("_corrupt_record")
    for c, v in equal.items():
        d = d.where(F.col(c) == v)
    d = d.orderBy(F.col(newest).desc())
    return d.limit(n) if n else d
