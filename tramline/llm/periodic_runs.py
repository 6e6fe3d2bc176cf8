"""Runs of periodic words, found by catchers over completed blocks of 1, 2, 4, ... words.

A run is a stretch of consecutive words with smallest period q and length >= max(LEAST_WORDS, LEAST_PERIODS * q) that
neither neighbour extends with that period.

Level k watches the periods m <= q < 2m for m = 2**k.  A block of m words begins at every multiple of m; when it is
complete, its catcher waits for the block's words to come again m to 2m - 1 words later, so it is alive for the m words
whose window begins there and exactly one catcher of a level is alive for each appended word.  The word that completes
such a repeat reports a square's half with its period; repeats caught by neighbouring catchers with one period are
chained, suffix comparisons carry the chain to the first word that breaks the period on either side, and squares that
lie inside a run known from a smaller period are part of that run and aren't followed.

Why nothing is lost: a run of four periods holds a whole block of m <= q words within its first two periods, and that
block's repeat q words later.  Why the period is the smallest: a stretch of p + m words that lies inside a run of period
q < p has, by Fine and Wilf, a period that divides both, so its maximal stretch is that run; equal stretches of several
periods keep the least.

Work is n words times log n levels of array comparisons, in one task per batch of rows; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import arrow_map, column_of, spans_of_rows, text_buffer, whole_text

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text whose words are compared together; a longer text is a span of its own.
_SPAN = 4 << 20
#: Below this block size the chains of a level are extended together, a word at a time; above it each by itself.
_SMALL = 64


def _chains(at: np.ndarray, period: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last block and the period of every chain of neighbouring blocks caught with one period."""
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + m)
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1], period[first]


def _extended(h: np.ndarray, first: np.ndarray, last: np.ndarray, p: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal stretches [start, end) with period p around chains of blocks; they end within m words of the chain."""
    n = len(h)
    start, end = first.copy(), last + p + m
    if m <= _SMALL:
        live = np.arange(len(p))
        while len(live):
            go = start[live] > 0
            go[go] = h[start[live[go]] - 1] == h[start[live[go]] - 1 + p[live[go]]]
            live = live[go]
            start[live] -= 1
        live = np.arange(len(p))
        while len(live):
            go = end[live] < n
            go[go] = h[end[live[go]]] == h[end[live[go]] - p[live[go]]]
            live = live[go]
            end[live] += 1
        return start, end
    for k, (a, b, q) in enumerate(zip(first.tolist(), last.tolist(), p.tolist(), strict=True)):
        low = max(0, a - m)
        broken = np.flatnonzero(h[low:a] != h[low + q : a + q])
        start[k] = low + broken[-1] + 1 if len(broken) else low
        high = min(n, b + q + 2 * m)
        broken = np.flatnonzero(h[b + q + m : high] != h[b + m : high - q])
        end[k] = b + q + m + broken[0] if len(broken) else high
    return start, end


def caught_runs(h: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs among the word hashes ``h``; ``longest``: words of the longest text in it."""
    n = len(h)
    known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    reach = np.zeros(n + 1, np.int64)  # how far the runs reach that begin at or before a word
    window, m = h, 1
    while m * LEAST_PERIODS <= longest:
        # The window at i meets the block that was completed m to 2m - 1 words before.
        usable = len(window) // m * m
        blocks = window[:usable:m]
        size = min(len(window), usable + m) - m
        if size > 0:
            twins = np.repeat(blocks, m)[:size] == window[m : m + size]
            i = np.flatnonzero(twins) + m
            at = (i // m - 1) * m
            open_ = reach[at] < i + m
            i, at = i[open_], at[open_]
            if len(i):
                first, last, p = _chains(at, i - at, m)
                start, end = _extended(h, first, last, p, m)
                known.append((start, end, p))
                np.maximum.at(reach, start, end)
                reach = np.maximum.accumulate(reach)
        if len(window) <= m:
            break
        window = W.joined(window[:-m], window[m:])
        m *= 2
    if not known:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, end, p = (np.concatenate(x) for x in zip(*known, strict=True))
    long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
    start, end, p = start[long], end[long], p[long]
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    new = np.ones(len(p), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], p[new]


def _strongest(start: list[int], length: list[int], period: list[int]) -> int:
    """The run with the greatest length / period; of equal ones the smallest start, then period (they come in that order)."""
    best = 0
    for k in range(1, len(start)):
        if length[k] * period[best] > length[best] * period[k]:
            best = k
    return best


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.string()), ("collapsed", pa.string()),
])
_DDL = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, runs string, collapsed string"
)


def _span_runs(data: np.ndarray, offsets: np.ndarray):
    """Per row of a span: its words (as spans of bytes) and its runs, in word numbers of the row."""
    starts, lens, before = W.split(data, offsets)
    n_rows = len(before) - 1
    counts = np.diff(before)
    # One separator after each text, equal to nothing else, so that no stretch of two periods crosses it.
    h = np.empty(len(starts) + n_rows, np.uint64)
    edge = before[1:] + np.arange(n_rows)
    inside = np.ones(len(h), bool)
    inside[edge] = False
    h[inside] = W.hashes(data, starts, lens, 12)
    h[edge] = W.mix(np.arange(n_rows, dtype=np.uint64) ^ np.uint64(0x5EA2A70250000000))
    start, end, period = caught_runs(h, int(counts.max()) if n_rows else 0)
    row = np.searchsorted(edge, start)
    first = before[:-1] + np.arange(n_rows)
    return starts, lens, before, row, start - first[row], end - start, period


def _judge(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = column_of(batch, "doc_id")
        data, off = text_buffer(column_of(batch, "text"))
        for a, b in spans_of_rows(off, _SPAN):
            raw = data[off[a] : off[b]]
            starts, lens, before, row, first, length, period = _span_runs(raw, off[a : b + 1] - off[a])
            body = raw.tobytes()
            begins = np.searchsorted(row, np.arange(b - a + 1))
            columns: list[list] = [[] for _ in range(10)]
            for r in range(b - a):
                x, y = int(begins[r]), int(begins[r + 1])
                ws, wl = starts[before[r] : before[r + 1]], lens[before[r] : before[r + 1]]
                n, best = len(ws), [None] * 4
                s, ln, q = first[x:y].tolist(), length[x:y].tolist(), period[x:y].tolist()
                if s:
                    gone = np.zeros(n + 1, np.int32)
                    np.add.at(gone, first[x:y] + period[x:y], 1)
                    np.add.at(gone, first[x:y] + length[x:y], -1)
                    stay = np.cumsum(gone[:-1]) == 0
                    ws, wl = ws[stay], wl[stay]
                    k = _strongest(s, ln, q)
                    best = [s[k], ln[k], q[k], 1000 * ln[k] // q[k]]
                kept = b" ".join([body[i : i + w] for i, w in zip(ws.tolist(), wl.tolist(), strict=True)])
                runs = "".join(f"{i},{w},{p}\n" for i, w, p in zip(s, ln, q, strict=True))
                row_out = [n, len(s), *best, hashlib.sha256(runs.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()]
                row_out += [runs, kept.decode()] if texts else [None, None]
                for c, v in zip(columns, row_out, strict=True):
                    c.append(v)
            out = [ids.slice(a, b - a), *(pa.array(c, f.type) for c, f in zip(columns, list(_OUT)[1:], strict=True))]
            yield pa.record_batch(out, schema=_OUT)


def periodic_runs(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_runs; start, length, period and exponent_milli (floor of 1000 * length /
    period) of the run with the greatest exact length / period (ties: smallest start, then period; without a run: nulls);
    runs_sha256 over every run's "start,length,period" and a line feed, by start, then period; collapsed_sha256 over the
    words that stay, joined by one space; with ``texts`` these two texts themselves (runs, collapsed).

    Words are runs of bytes outside space and 0x09-0x0D, numbered from 0 within their text.  A word goes if any run holds
    it after that run's first period.  Null and empty texts have no words and no runs; any length of text is judged whole.
    Rows are judged one by one: a null or repeated doc_id is passed on.  An empty table gives no rows; other columns are
    ignored, whatever their names.  Words are told apart by 64-bit hashes.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return arrow_map(d, lambda b: _judge(b, texts), _DDL)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where a tenth of the documents is made periodic from some word on.

    With h = crc32 of the decimal doc_id and g = h // 10: where h % 10 = 0 and there are n > 0 words, each word i >= a becomes
    word a + (i - a) % p, for a = g % n and p = 1 + (n - a) // (3 + g % 8).  Other texts, and those of null doc_ids, stay.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    w, g = F.col("_w"), F.floor(h / 10)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), (h % 10 == 0).alias("_on"), g.alias("_g"))
    some = some.withColumn("_w", F.when(F.col("_on"), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    n = F.size(w)
    a = F.pmod(F.col("_g"), n)
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8))
    i = lambda x: F.when(x < F.col("_a"), x).otherwise(F.col("_a") + F.pmod(x - F.col("_a"), F.col("_p")))
    some = some.withColumns({"_a": a.cast("int"), "_p": p.cast("int")})
    periodic = F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda x: F.get(w, i(x))), " ")
    return some.select("doc_id", F.when(F.col("_on") & (F.size(w) > 0), periodic).otherwise(F.col("text")).alias("text"))
