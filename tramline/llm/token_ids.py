"""Token-ID output: fixed-width bit packing in blocks with offsets.

A token file set is a Parquet folder (Spark's writer commits it whole, on any file system).  One row is one block:

    shard, block       part of the doc_id order, and the block's number in it
    first, n_ids       offset of the block's first id in the shard, and its number of ids (BLOCK_IDS, but for the last)
    width              bits of an id: the fewest that hold the vocabulary
    pieces             of each document in the block: doc_id, doc_start and n_tokens in the shard, from and n in the block
    payload            the ids, ``width`` bits each, least significant bit first

Ids at any position are found by shard base, ``position // BLOCK_IDS`` and one vectorised unpack.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow_map, column_of, key_changes, new_path, shuffle_width, tables_by_key
from .tokenizing import encoded_chunks

BLOCK_IDS = 1 << 16

_PIECE = pa.struct(
    [("doc_id", pa.int64()), ("doc_start", pa.int64()), ("n_tokens", pa.int64()), ("from", pa.int32()), ("n", pa.int32())]
)
_BLOCK = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32()),
     ("pieces", pa.list_(_PIECE)), ("payload", pa.binary())]
)
BLOCK_DDL = (
    "shard int, block int, first long, n_ids int, width int, "
    "pieces array<struct<doc_id:long,doc_start:long,n_tokens:long,from:int,n:int>>, payload binary"
)


def id_width(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit into {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, n: int, start: int = 0) -> np.ndarray:
    """Ids ``start`` .. ``start + n - 1`` of a payload, without touching the others."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", n, start * width // 8).astype(np.uint32)
    raw = np.frombuffer(payload + bytes(8), np.uint8)
    lanes = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    bit = (np.arange(n, dtype=np.int64) + start) * width
    return ((lanes[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def _blocks(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    shard, block, first, filled, done = TaskContext.get().partitionId(), 0, 0, 0, 0
    held: list[np.ndarray] = []
    pieces: list[dict] = []

    def close() -> pa.RecordBatch:
        nonlocal block, first, filled
        ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
        row = [shard], [block], [first], [filled], [width], [list(pieces)], [pack(ids, width)]
        held.clear()
        pieces.clear()
        block, first, filled = block + 1, first + filled, 0
        return pa.record_batch([pa.array(v, f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

    for batch in batches:
        doc_ids = column_of(batch, "doc_id").to_pylist()
        for at, ids, lengths in encoded_chunks(tokenizer, column_of(batch, "text"), end_id):
            ends = np.cumsum(lengths)
            for k, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
                start, begin = done, end - n
                while begin < end:
                    take = min(end - begin, BLOCK_IDS - filled)
                    held.append(ids[begin : begin + take])
                    pieces.append({"doc_id": doc_ids[at + k], "doc_start": start, "n_tokens": n, "from": filled, "n": take})
                    begin, filled = begin + take, filled + take
                    if filled == BLOCK_IDS:
                        yield close()
                done += n
    if filled:
        yield close()


def write_token_ids(
    docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int = 1, shards: int | None = None
) -> None:
    """Encode the whole texts of ``docs`` (doc_id, text; null text: empty) in ascending doc_id order and write a file set.

    Every document ends with ``end_id``, so an empty text has one id.  Rows with a null doc_id come first; repeated
    doc_ids stay separate documents, ordered by text.  Other columns are ignored.  An empty table gives an empty set.
    One range exchange of the text; a shard is one range.
    """
    spark = docs.sparkSession
    width = id_width(vocabulary)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(shards or shuffle_width(spark), "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
    )
    blocks = arrow_map(ordered, lambda batches: _blocks(batches, tokenizer, end_id, width), BLOCK_DDL)
    blocks.write.mode("overwrite").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_DDL).parquet(path)


def shard_bases(blocks: DataFrame) -> DataFrame:
    """(shard, base): ids in all shards before it.  One row per shard, so the window over them is small."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))


_READ = pa.schema(
    [("shard", pa.int32()), ("doc_start", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("at", pa.int64()),
     ("crc", pa.int64()), ("raw", pa.binary())]
)
_READ_DDL = "shard int, doc_start long, doc_id long, n_tokens long, at long, crc long, raw binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unpack blocks; a document that lies in one block gets its checksum here, a piece of a longer one its bytes."""
    for batch in batches:
        for b in batch.to_pylist():
            ids = unpack(b["payload"], b["width"], b["n_ids"]).astype("<u4")
            rows = []
            for p in b["pieces"]:
                raw = ids[p["from"] : p["from"] + p["n"]].tobytes()
                whole = p["n"] == p["n_tokens"]
                rows.append((b["shard"], p["doc_start"], p["doc_id"], p["n_tokens"], b["first"] + p["from"],
                             zlib.crc32(raw) if whole else None, None if whole else raw))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


_SUM = pa.schema([("shard", pa.int32()), ("doc_start", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by document and position; checksums run on over the pieces of a document."""
    for table in tables_by_key(batches, ["shard", "doc_start"], 1000):
        cols = {n: table.column(n).to_pylist() for n in ("crc", "raw")}
        begins = np.concatenate([[0], key_changes(table, ["shard", "doc_start"])])
        ends = np.append(begins[1:], table.num_rows)
        sums = []
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            c = cols["crc"][a]
            if c is None:
                c = 0
                for k in range(a, b):
                    c = zlib.crc32(cols["raw"][k], c)
            sums.append(c)
        kept = table.take(pa.array(begins))
        out = [kept.column(n).combine_chunks() for n in ("shard", "doc_start", "doc_id", "n_tokens")]
        yield pa.record_batch([*out, pa.array(sums, pa.int64())], schema=_SUM)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a file set: doc_id, start, n_tokens, ids_crc32, shard, all taken from the blocks."""
    blocks = read_blocks(spark, path)
    pieces = arrow_map(blocks, _pieces, _READ_DDL)
    dealt = pieces.repartition(shuffle_width(spark), "shard", "doc_start").sortWithinPartitions("shard", "doc_start", "at")
    docs = arrow_map(dealt, _checksums, "shard int, doc_start long, doc_id long, n_tokens long, ids_crc32 long")
    bases = shard_bases(blocks)
    return docs.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32", "shard"
    )


def ids_at(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """Random access: ids ``start`` .. ``start + n - 1`` of the whole set (fewer at its end); reads only their blocks."""
    blocks = read_blocks(spark, path)
    begin = F.col("base") + F.col("first")
    hit = blocks.join(F.broadcast(shard_bases(blocks)), "shard").where((begin < start + n) & (begin + F.col("n_ids") > start))
    out = []
    for b in hit.select("width", "n_ids", "payload", begin.alias("at")).orderBy("at").collect():
        a, e = max(0, start - b["at"]), min(b["n_ids"], start + n - b["at"])
        out.append(unpack(bytes(b["payload"]), b["width"], e - a, a))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def token_ids(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 1) -> DataFrame:
    """Write the documents' ids into the shared folder and read them back, one row per document."""
    path = new_path(docs.sparkSession, "token_ids")
    write_token_ids(docs, path, tokenizer, vocabulary, end_id)
    return read_documents(docs.sparkSession, path)
