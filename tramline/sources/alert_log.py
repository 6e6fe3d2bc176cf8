"""Alert files of JSON lines, of which some are cut off or of another shape: good rows and set-aside lines in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

_BAD = "_malformed"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of ``schema`` from every file under ``path``, with the file and the line itself in _malformed where it is no such JSON.

    Blank lines are no lines.  A line is malformed if it isn't one JSON object or if a value has another type; fields that a
    line lacks are null, others are ignored.
    """
    whole = StructType.fromDDL(schema).add(_BAD, StringType())
    lines = spark.read.text(path).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).where(F.trim("value") != "")
    row = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    return lines.select(row.alias("r"), "file").select("r.*", "file")


def feed(rows: DataFrame, required: list[str], key: str, at: str) -> DataFrame:
    """The newest good row of each ``key`` by ``at`` (ties by all columns); rows that lack a required value don't count."""
    good = rows.where(F.col(_BAD).isNull()).dropna(subset=required).drop(_BAD, "file")
    rest = [c for c in good.columns if c not in (key, at)]
    newest = good.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("r"))
    return newest.select(key, "r.*").select(good.columns)


def rejected(rows: DataFrame, required: list[str]) -> DataFrame:
    """Per file: its lines, those that are malformed, and good ones that lack a required value."""
    bad = F.col(_BAD).isNotNull()
    lacking = ~bad & F.greatest(*[F.col(c).isNull() for c in required], F.lit(False))
    return rows.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(bad).alias("malformed"), F.count_if(lacking).alias("incomplete"))


def set_aside(rows: DataFrame) -> DataFrame:
    """The malformed lines themselves, with their file, to be written apart."""
    return rows.where(F.col(_BAD).isNotNull()).select("file", F.col(_BAD).alias("line"))
