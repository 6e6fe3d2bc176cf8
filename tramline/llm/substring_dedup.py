"""Removal of repeated passages with a count-min prefilter.

A window is N consecutive words of one document.  Its anchor is the least hash among its G-word runs, so equal windows have
equal anchors, and neighbouring windows share one: a document has about 14 times fewer anchors than windows.

1. Every partition adds its documents' distinct anchors to a count-min sketch (DEPTH rows of 2**BITS cells); the sketches are
   merged cell by cell.  A window's estimate, the least of its anchor's cells, is never below the number of documents that
   have the window.
2. Second pass: windows that repeat inside a batch are settled there; one of each kind and the others go on to be grouped
   exactly if their anchor is estimated in two documents or more.  Windows estimated once can't repeat elsewhere.
3. Exact grouping by dealing key and window hash, 128 bits together; the repeated ones go back to their documents.
4. Documents meet their repeated windows; words covered by one are removed.

The broadcast cells take DEPTH * 2**BITS / 8 bytes whatever the input.  With more text more anchors collide and more
windows are grouped exactly; the result stays the same.  BITS is the parameter to raise with the corpus.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .near_dedup import digests
from .shared import arrow_map, column_of, key_changes, shuffle_width, spans_of_rows, tables_by_key, text_buffer, written

GRAM = 8
BITS, DEPTH, BLOCK_BITS = 26, 2, 16
_CHUNK = 8 << 20


def _windows(data: np.ndarray, offsets: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Anchors, dealing keys, hashes, first words and rows of all windows of a span of rows, and the rows' digests.

    The dealing key is the anchor with the largest hash among the window's runs: equal for equal windows, but other for
    most windows that only share a common line, so that such a line doesn't meet in one task.
    """
    starts, lens, before = W.split(data, offsets)
    h = W.hashes(data, starts, lens, 3)
    at, row = W.whole_rows(before, n)
    gram = W.grams(h, min(GRAM, n))
    width = n - min(GRAM, n) + 1
    anchor = W.sliding_min(gram, width)[at] if len(at) else h[:0]
    deal = W.joined(anchor, ~W.sliding_min(~gram, width)[at]) if len(at) else h[:0]
    window = W.grams(W.hashes(data, starts, lens, 4), n)[at] if len(at) else h[:0]
    return {"anchor": anchor, "deal": deal, "window": window, "first": at - before[:-1][row], "row": row, "digest": digests(h, before)}


def _cells(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(W.mix(anchor ^ np.uint64(0xA5A5 + r)) >> np.uint64(64 - bits)).astype(np.int64) for r in range(DEPTH)]


def _runs(w: dict[str, np.ndarray]) -> np.ndarray:
    """Positions at which a run of windows with one anchor and row begins."""
    a, r = w["anchor"], w["row"]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    return np.flatnonzero(new)


_SKETCH = pa.schema([("block", pa.int32()), ("cells", pa.binary())])


def _sketch(batches: Iterator[pa.RecordBatch], n: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Cells that documents of this partition touch, cut into blocks: 16 bits each, one entry for each document and anchor."""
    for batch in batches:
        data, off = text_buffer(column_of(batch, "text"))
        for a, b in spans_of_rows(off, _CHUNK):
            w = _windows(data[off[a] : off[b]], off[a : b + 1] - off[a], n)
            at = _runs(w)
            anchor, row = w["anchor"][at], w["row"][at]
            order = np.lexsort((anchor, row))
            anchor, row = anchor[order], row[order]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
            blocks, packed = [], []
            for r, cell in enumerate(_cells(anchor[new], bits)):
                # Two entries say "at least twice"; more of the same would add nothing.
                cell = np.sort(cell)
                keep = np.ones(len(cell), bool)
                keep[2:] = cell[2:] != cell[:-2]
                cell = cell[keep]
                block = cell >> BLOCK_BITS
                begins = np.flatnonzero(np.diff(block, prepend=-1))
                for x, y in zip(begins.tolist(), np.append(begins, len(cell))[1:].tolist(), strict=True):
                    blocks.append((r << (bits - BLOCK_BITS)) + int(block[x]))
                    packed.append((cell[x:y] & ((1 << BLOCK_BITS) - 1)).astype("<u2").tobytes())
            yield pa.record_batch([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], schema=_SKETCH)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block: the sum of the sketches' cells, as one bit "two or more" for each cell."""
    count, now = np.zeros(1 << BLOCK_BITS, np.uint8), None

    def close() -> pa.RecordBatch:
        bits = zlib.compress(np.packbits(count > 1, bitorder="little").tobytes(), 1)
        return pa.record_batch([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], schema=_SKETCH)

    for batch in batches:
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if block != now:
                if now is not None:
                    yield close()
                now = block
                count[:] = 0
            own = np.frombuffer(cells, "<u2")
            count += np.minimum(np.bincount(own, minlength=1 << BLOCK_BITS), 2).astype(np.uint8)
            np.minimum(count, 2, out=count)
    if now is not None:
        yield close()


def repeated_cells(text: DataFrame, n: int, bits: int) -> bytes:
    """The merged sketch: DEPTH * 2**bits bits, set where the estimate is two documents or more."""
    spark = text.sparkSession
    rows = arrow_map(text.select("text"), lambda b: _sketch(b, n, bits), "block int, cells binary")
    rows = rows.repartition(min(shuffle_width(spark), DEPTH << (bits - BLOCK_BITS)), "block").sortWithinPartitions("block")
    merged = arrow_map(rows, _merged, "block int, cells binary")
    size = (1 << BLOCK_BITS) // 8
    out = bytearray(DEPTH * (1 << bits) // 8)
    for r in merged.toLocalIterator(prefetchPartitions=True):
        out[r["block"] * size : (r["block"] + 1) * size] = zlib.decompress(r["cells"])
    return bytes(out)


_PASS = pa.schema(
    [("settled", pa.bool_()), ("deal", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("first", pa.int32()), ("windows", pa.binary())]
)
_PASS_DDL = "settled boolean, deal long, doc_id long, digest long, first int, windows binary"


def _stretches(first: np.ndarray, row: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Positions at which consecutive windows of one row and equal keys begin anew."""
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1] + 1) | (row[1:] != row[:-1])
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _second_pass(batches: Iterator[pa.RecordBatch], n: int, bits: int, held) -> Iterator[pa.RecordBatch]:
    """Repeats inside a span of rows are settled; candidates for repeats elsewhere are sent, one of each kind.

    settled rows: consecutive repeated windows from ``first`` on, as many as ``windows`` has bytes.  Other rows: hashes of
    consecutive windows with one dealing key.
    """
    flags = np.frombuffer(held.value, np.uint8)
    for batch in batches:
        data, off = text_buffer(column_of(batch, "text"))
        ids = column_of(batch, "doc_id")
        for a, b in spans_of_rows(off, _CHUNK):
            w = _windows(data[off[a] : off[b]], off[a : b + 1] - off[a], n)
            if not len(w["anchor"]):
                continue
            order = np.lexsort((w["deal"], w["window"]))
            wa, ww = w["deal"][order], w["window"][order]
            new = np.ones(len(order), bool)
            new[1:] = (wa[1:] != wa[:-1]) | (ww[1:] != ww[:-1])
            group = np.cumsum(new) - 1
            again = np.zeros(len(order), bool)
            again[order] = np.bincount(group)[group] > 1
            one = np.zeros(len(order), bool)
            one[order] = new
            often = np.ones(len(order), bool)
            for r, cell in enumerate(_cells(w["anchor"], bits)):
                cell += r << bits
                often &= (flags[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
            columns: list[list] = [[], [], [], [], [], []]
            for settled, chosen in ((True, np.flatnonzero(again)), (False, np.flatnonzero(one & often))):
                first, row, deal, window = (w[k][chosen] for k in ("first", "row", "deal", "window"))
                begins = _stretches(first, row) if settled else _stretches(first, row, deal)
                ends = np.append(begins, len(first))[1:]
                columns[0] += [settled] * len(begins)
                columns[1].append(np.zeros(len(begins), np.int64) if settled else deal[begins].view(np.int64))
                columns[2].append(row[begins] + a)
                columns[3].append(w["digest"][row[begins]].view(np.int64))
                columns[4].append(first[begins].astype(np.int32))
                raw = window.astype("<u8").tobytes()
                columns[5] += [bytes(y - x) if settled else raw[8 * x : 8 * y] for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
            rows = pa.array(np.concatenate(columns[2]))
            if len(rows):
                yield pa.record_batch(
                    [pa.array(columns[0]), pa.array(np.concatenate(columns[1])), ids.take(rows), pa.array(np.concatenate(columns[3])),
                     pa.array(np.concatenate(columns[4])), pa.array(columns[5], pa.binary())], schema=_PASS
                )


_FOUND = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])
_FOUND_DDL = "doc_id long, digest long, first int, n int"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by dealing key: windows with an equal one among the rows of their key, as stretches."""
    for table in tables_by_key(batches, ["deal"], 20_000):
        blobs = table.column("windows").combine_chunks()
        lens = np.diff(np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]) // 8
        window = np.frombuffer(b"".join(blobs.to_pylist()), "<u8")
        row = np.repeat(np.arange(len(lens)), lens)
        deal = table.column("deal").to_numpy()[row]
        first = table.column("first").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
        order = np.lexsort((window, deal))
        wd, ww = deal[order], window[order]
        new = np.ones(len(order), bool)
        new[1:] = (wd[1:] != wd[:-1]) | (ww[1:] != ww[:-1])
        group = np.cumsum(new) - 1
        hit = np.sort(order[np.bincount(group, minlength=1)[group] > 1]) if len(order) else order
        row, first = row[hit], first[hit]
        begins = _stretches(first, row)
        n = np.diff(np.append(begins, len(first))).astype(np.int32)
        kept = table.select(["doc_id", "digest"]).take(pa.array(row[begins])).combine_chunks()
        columns = [kept.column(0).combine_chunks(), kept.column(1).combine_chunks(), pa.array(first[begins].astype(np.int32)), pa.array(n)]
        yield pa.record_batch(columns, schema=_FOUND)


def repeated_windows(docs: DataFrame, n: int = 35, bits: int = BITS) -> DataFrame:
    """(doc_id, digest of the row's words, first, n): stretches of n windows from word ``first`` on that occur elsewhere too."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = spark.sparkContext.broadcast(repeated_cells(text, n, bits))
    passed = written(arrow_map(text, lambda b: _second_pass(b, n, bits, held), _PASS_DDL), "windows", "settled")
    sent = passed.where("not settled").select("deal", "doc_id", "digest", "first", "windows")
    dealt = sent.repartition(shuffle_width(spark), "deal").sortWithinPartitions("deal")
    found = arrow_map(dealt, _grouped, _FOUND_DDL)
    settled = passed.where("settled").select("doc_id", "digest", "first", F.octet_length("windows").cast("int").alias("n"))
    return settled.unionByName(found)


_DONE = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
)


def _removed(batches: Iterator[pa.RecordBatch], n: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[], [], [], []]
        found = column_of(batch, "found").to_pylist()
        for text, stretches in zip(column_of(batch, "text").to_pylist(), found, strict=True):
            words = (text or "").encode().split()
            total = len(words)
            if stretches:
                gone = np.zeros(total + 1, np.int32)
                for s in stretches:
                    gone[s["first"]] += 1
                    gone[min(total, s["first"] + s["n"] + n - 1)] -= 1
                stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                words = [words[k] for k in stay.tolist()]
            line = b" ".join(words)
            columns[0].append(total)
            columns[1].append(total - len(words))
            columns[2].append(hashlib.sha256(line).hexdigest())
            columns[3].append(line.decode() if texts else None)
        out = [column_of(batch, "doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(_DONE)[1:], strict=True))]
        yield pa.record_batch(out, schema=_DONE)


_KEY = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("text", pa.string())])


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = column_of(batch, "text"), column_of(batch, "doc_id")
        data, off = text_buffer(texts)
        parts = []
        for a, b in spans_of_rows(off, _CHUNK):
            part, cut = data[off[a] : off[b]], off[a : b + 1] - off[a]
            starts, lens, before = W.split(part, cut)
            parts.append(digests(W.hashes(part, starts, lens, 3), before))
        digest = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield pa.record_batch([ids, pa.array(digest.view(np.int64)), texts.cast(pa.string())], schema=_KEY)


def remove_repeats(docs: DataFrame, n: int = 35, bits: int = BITS, texts: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, kept_sha256, kept_text (null unless ``texts``).

    Words are runs of bytes outside space and 0x09-0x0D, unchanged.  A word goes if a window of ``n`` words covers it whose
    words also start anywhere else, in another row or the same one; windows are judged on the input.  kept_text: the other
    words joined by one space.  Null and empty texts have no words; texts under n words lose none.  Rows that repeat a
    doc_id are told apart by their words (equal rows repeat each other).  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    found = repeated_windows(docs, n, bits)
    mine = found.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("first", "n")).alias("found"))
    mine = mine.withColumnsRenamed({"doc_id": "f_doc", "digest": "f_digest"})
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = arrow_map(text, _with_digest, "doc_id long, digest long, text string")
    on = F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("digest") == F.col("f_digest"))
    joined = keyed.join(mine, on, "left").select("doc_id", "text", "found")
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return arrow_map(joined, lambda b: _removed(b, n, texts), ddl)
