"""Sources, sinks and the scoring job."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.sources.shared import shared_dir

from .events import KEY_TYPES, MICROSECONDS, SCHEMA, keyed
from .state import history_stream

WATERMARK = "1 hour"
#: Rows of a replay's file, below which a part isn't cut into several.
LEAST_ROWS = 10_000


def read_files(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Event files as a stream, oldest first; emitted_at is the file's time."""
    d = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).json(path)
    return d.select("*", F.col("_metadata.file_modification_time").alias("emitted_at"))


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Events from Kafka; needs the spark-sql-kafka package on the cluster."""
    d = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return d.select(F.from_json(F.col("value").cast("string"), SCHEMA).alias("e"), F.col("timestamp").alias("emitted_at")).select("e.*", "emitted_at")


def to_kafka(json_events: DataFrame, servers: str, topic: str) -> None:
    """Events (corridor_id, value) to Kafka, keyed by corridor so that a corridor stays in order."""
    rows = json_events.select(F.col("corridor_id").alias("key"), "value")
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write_replay(events: DataFrame, path: str, parts: int, files: int = 1) -> int:
    """Events as JSON files in time order, one write per part, so that modification times follow event times.

    Events are dealt to parts by time in one pass; each part then becomes as many files as all others: ``files``, or one if
    a part is small.  That number is returned: a batch must take whole parts.
    Times keep their microseconds: cut to milliseconds, as JSON has them by default, a fact and a query could change places.
    """
    t = F.unix_micros(F.col("event_time").cast("timestamp"))
    bounds = events.agg(F.percentile_approx(t, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] or [] if parts > 1 else []
    part = sum((F.coalesce(t > b, F.lit(False)).cast("int") for b in bounds), F.lit(0))
    dealt = f"{shared_dir(events.sparkSession)}/replay-{uuid.uuid4().hex}"
    events.withColumn("part", part).write.partitionBy("part").parquet(dealt)
    stored = events.sparkSession.read.schema(f"{SCHEMA}, part int").parquet(dealt)
    sizes = {r["part"]: r["count"] for r in stored.groupBy("part").count().collect()} or {0: 0}  # one number a part
    files = files if min(sizes.values()) >= files * LEAST_ROWS else 1
    for p in sorted(sizes):
        rows = stored.where(F.col("part") == p).drop("part")
        rows = rows.coalesce(1) if files == 1 else rows.repartition(files)
        rows.write.mode("append").options(**MICROSECONDS).json(path)
    return files


def histories(events: DataFrame) -> DataFrame:
    """Stream of events to the stream of per-key history rows."""
    watched = events.withColumn("watermark_time", F.col("event_time").cast("timestamp")).withWatermark("watermark_time", WATERMARK)
    rows = keyed(watched.drop("emitted_at"))
    # Python workers get what the state reads.
    return history_stream(rows.drop("event_id", "event_time", "source_center", "destination_center", "created_hour"))


def assembled(rows: DataFrame) -> DataFrame:
    """One feature row per leg from its five key rows; a leg that lacks one is left out."""
    of = lambda k, c: F.max(F.when(F.col("key_type") == k, F.col(c)))
    keys = (("corridor", "corr"), ("source", "src"), ("destination", "dst"))
    spread = ["median_gap_min", "p90_gap_min", "iqr_gap_min", "sd_gap_min", "mean_gap_7d", "n_prior_7d"]
    d = rows.where("row_kind = 'query'").groupBy("leg_id").agg(
        F.count_distinct("key_type").alias("keys"), F.max("corridor_id").alias("corridor_id"), F.max("planned_min").alias("planned_min"), F.max("t").alias("t"),
        *[of(k, c).alias(f"{p}_{c}") for k, p in keys for c in ("n_prior", "mean_gap_min")], *[of("corridor", c).alias(f"corr_{c}") for c in spread],
        of("source_part", "mean_dwell_min").alias("src_dwell_by_hour_min"), of("destination_part", "mean_dwell_min").alias("dst_dwell_by_hour_min"),
    )
    return d.where(F.col("keys") == len(KEY_TYPES)).drop("keys")


def write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """Idempotent: a batch that is run again replaces its own partition."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _started(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], trigger: dict):
    """Start with the RocksDB state store; a query takes the session's settings when it starts, so the session gets its own back."""
    conf = stream.sparkSession.conf
    before = conf.get(_STORE, None)
    conf.set(_STORE, ROCKSDB)
    try:
        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        conf.unset(_STORE) if before is None else conf.set(_STORE, before)


def drain(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Process what is there and stop; a later call on the same checkpoint goes on from there."""
    _started(stream, checkpoint, sink, {"availableNow": True}).awaitTermination()


def run_continuously(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], every: str = "10 seconds"):
    return _started(stream, checkpoint, sink, {"processingTime": every})


def with_snapshot(queries: DataFrame, snapshot: DataFrame, key_type: str = "corridor", key: str = "corridor_id") -> DataFrame:
    """Queries with the snapshot of their key, zeros where it is unknown; works on streams and tables alike."""
    s = snapshot.where(F.col("key_type") == key_type).select(F.col("key").alias(key), "n", "mean_gap_min")
    return queries.join(s, key, "left").fillna(0, ["n"]).fillna(0.0, ["mean_gap_min"])


def latency(rows: DataFrame, start: str, end: str) -> DataFrame:
    """One row: nearest-rank p50, p95 and the largest latency in seconds."""
    d = rows.withColumn("s", F.expr(f"timestampdiff(MICROSECOND, {start}, {end})") / 1e6)
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by s)")
    return d.agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("s").alias("most"))


def stage_times(progress: list[dict]) -> list[tuple[str, float]]:
    """Seconds by stage over a query's progress reports (``StreamingQuery.recentProgress``)."""
    total: dict[str, float] = {}
    for p in progress:
        for k, v in (p.get("durationMs") or {}).items():
            total[k] = total.get(k, 0.0) + v / 1000
    return sorted(total.items(), key=lambda x: -x[1])
