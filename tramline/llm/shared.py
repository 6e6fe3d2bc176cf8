"""Folders that all executors share, and small helpers that the operators have in common."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])


#: Bytes of an Arrow batch that Spark sends to a Python worker, unless the session names a bound of its own.
BATCH_BYTES = 8 << 20
#: Bytes of a row group of an intermediate table: a task holds one while it writes.
ROW_GROUP_BYTES = 16 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What a Python worker keeps between tasks: the tables of one operator at a time.
_KEPT: dict[Hashable, object] = {}
#: Whose folders ``written`` makes now, the innermost last.
_OPEN: ContextVar[tuple[Scratch, ...]] = ContextVar("scratch", default=())


class Scratch:
    """The folders that ``written`` makes inside ``with scratch:``, to be deleted once what reads them is written.

    Folders made outside any scratch belong to their caller's result and stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self._token = _OPEN.set((*_OPEN.get(), self))
        return self

    def __exit__(self, *error: object) -> None:
        _OPEN.reset(self._token)

    def delete(self) -> None:
        while self.paths:
            _delete(self.spark, self.paths.pop())


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def kept(key: Hashable, build: Callable[[], object]) -> object:
    """What ``build`` gives, once per worker until another operator needs the room."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of bounded bytes; at its end a task hands the memory it has freed back to the system, as
    workers outlive tasks and sit beside the executor's heap."""
    spark = df.sparkSession
    importable(spark)
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return df.mapInArrow(lean, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, as a cluster names it; one for this application only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(f"/tmp/tramline-{sc.applicationId}")
        named = sc._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet into the shared folder and read them back.

    A lost executor then costs a re-read, not a recomputation of what came before.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    for own in _OPEN.get()[-1:]:
        own.paths.append(path)
    out = df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``needed`` under names that clash with none, and what gives them their names back."""
    names = [c if c in needed else f"_own{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows (null counts as empty)."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans_of_rows(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most_bytes`` bytes each, or one row if that is longer."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def tables_by_key(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 1) -> Iterator[pa.Table]:
    """Cut batches that are sorted by ``keys`` where the key changes; tables hold whole keys and at least ``least_rows`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = _last_change(table, keys)
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def key_changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins, the first row left out."""
    changed = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        v = table.column(k).to_numpy()
        changed |= v[1:] != v[:-1]
    return np.flatnonzero(changed) + 1


def _last_change(table: pa.Table, keys: list[str]) -> int:
    at = key_changes(table, keys)
    return int(at[-1]) if len(at) else 0
