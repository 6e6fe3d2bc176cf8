"""A hierarchical Pitman-Yor language model: every word is a restaurant for the words that follow it, and all share one parent.

A restaurant seats a customer for each time a word (a dish) follows its context in the training texts.  Tables of one dish
are customers of the parent restaurant, whose own tables come from the uniform base over the V words seen and one more for
all others (two levels: a word is predicted from the one before it).  With c customers and t tables the predictive probability is

    P(w | u) = (c_uw - d t_uw) / (theta + c_u) + (theta + d t_u) / (theta + c_u) * P(w),

and P(w) likewise over the base.  Seatings are sampled by Gibbs sweeps in blocks of all customers of a dish.  The number of their tables is drawn
from its exact conditional, which is proportional to a power of the weight of a new table times a generalised Stirling number: by a
table of these up to EXACT customers and TABLES tables; beyond, by a Poisson number with the mean of the Pitman-Yor process
of that discount whose next table would have the same weight.  The dishes of a
task are drawn side by side, given the tables of the last sweep.  The predictive is linear in the tables, so it is averaged
over samples by averaging tables.

Flow, one plan: chunks of documents send each bucket of contexts the pairs (context, word) that they hold, whole and counted
(training or not); buckets seat their restaurants and send each part of the parent its words with customers; parts seat
the parent and answer in the order of the question, without keys; buckets seat again under the parent's averaged
predictive and answer each chunk with sums per document.  The number of buckets grows with the text, the model is never in
one place, and what travels again is reused from the same shuffle files.  A context with more than half a bucket's
share of all tokens is dealt to several buckets by following word (at most two for each bucket).  Random numbers are hashes of (pair,
sweep, step): a lost task gives the same seating again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import arrow_map, column_of, importable, shuffle_width, spans_of_rows, text_buffer, whole_text

#: Discount and strength of the parent and of the contexts' restaurants.
DISCOUNTS, STRENGTHS = (0.6, 0.8), (1.0, 2.0)
#: Gibbs sweeps before the parent is told, before samples count, and samples.
SWEEPS, BURN_IN, SAMPLES = 2, 2, 4
#: Customers of a dish up to which, and tables for which, tables are drawn from their exact distribution.
EXACT, TABLES = 4096, 512
#: Bytes of text whose pairs meet in one bucket, and the fewest buckets; parts of the parent at most.
BUCKET_BYTES, LEAST_BUCKETS, MOST_PARTS = 12 << 20, 8, 256
#: A chunk's documents are numbered in 15 bits.
_CHUNK, _CHUNK_ROWS = 8 << 20, 30_000
_TRAIN = np.uint16(1 << 15)
_START, _END = np.uint64(0x51A27), np.uint64(0xE4D)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unpack(body: bytes, *types: str) -> list[np.ndarray]:
    sizes = np.frombuffer(body, "<i8", len(types), 8)
    at = 8 * (len(types) + 1) + np.cumsum(sizes) - sizes
    return [np.frombuffer(body, t, int(n) // np.dtype(t).itemsize, int(a)) for t, n, a in zip(types, sizes, at, strict=True)]


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Positions at which a new combination of (sorted) keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


# Seatings


def _lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    below = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z / 1260)) / y - np.log(below)


def _uniform(key: np.ndarray, sweep: int, step: int) -> np.ndarray:
    h = W.mix(key ^ np.uint64((sweep << 40) + step + 1))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@lru_cache(maxsize=4)
def _log_stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of up to EXACT customers at up to TABLES tables; -inf where there are more tables."""
    s = np.full((EXACT + 1, TABLES + 1), -np.inf)
    s[1, 1] = 0.0
    t = np.arange(1, TABLES + 1)
    with np.errstate(divide="ignore"):
        for n in range(1, EXACT):
            s[n + 1, 1:] = np.logaddexp(np.log(np.maximum(n - d * t, 0.0)) + s[n, 1:], s[n, :-1])
    return s


def exact_tables(c: np.ndarray, rate: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Tables of c customers (sorted, 2 to EXACT) of a dish each, at the quantile u: P(t) ~ rate**t S(c, t)."""
    out = np.empty(len(c))
    first = _changes(c) if len(c) else np.zeros(0, np.int64)
    for x, y in zip(first.tolist(), np.append(first, len(c))[1:].tolist(), strict=True):
        most = min(int(c[x]), TABLES)
        t = np.arange(1, most + 1)
        for a in range(x, y, 1 + (1 << 21) // most):
            b = min(y, a + 1 + (1 << 21) // most)
            log_p = _log_stirling(d)[int(c[x]), 1 : most + 1] + np.log(rate[a:b])[:, None] * t
            p = np.cumsum(np.exp(log_p - log_p.max(axis=1, keepdims=True)), axis=1)
            out[a:b] = 1 + (p < u[a:b, None] * p[:, -1:]).sum(axis=1)
    return out


def mean_tables_of_many(c: np.ndarray, rate: np.ndarray, d: float) -> np.ndarray:
    """Mean tables of many customers c of a dish, where a new table has weight ``rate``.

    A Pitman-Yor process of strength s has on average E tables with s + d E = G(s + 1) G(c + s + d) / (G(s + d) G(c + s)), G
    the gamma function, and that is the weight of its next table: s is found by bisection between -d (one table) and ``rate``.
    """
    low, high = np.full(len(c), -d), np.maximum(rate, 0.0)
    for _ in range(60):
        s = (low + high) / 2
        more = _lgamma(s + 1) + _lgamma(c + s + d) - _lgamma(s + d) - _lgamma(c + s) < np.log(rate)
        low, high = np.where(more, s, low), np.where(more, high, s)
    return np.clip((rate - (low + high) / 2) / d, 1.0, c)


def poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson numbers at the quantile u; above a mean of 500, by the normal law."""
    z = np.sqrt(2) * _erfinv(2 * u - 1)
    out = np.maximum(0.0, np.rint(mean + z * np.sqrt(mean)))
    live = np.flatnonzero(mean <= 500)
    out[live], p, k = 0.0, np.exp(-mean), 0
    left = u - p
    while len(live := live[left[live] > 0]) and k < 1000:
        k += 1
        p[live] *= mean[live] / k
        left[live] -= p[live]
        out[live] += 1
    return out


def _erfinv(x: np.ndarray) -> np.ndarray:
    """Winitzki's approximation, within 0.2 %."""
    a = 0.147
    w = np.log(np.maximum(1 - x * x, 1e-300))
    b = 2 / (np.pi * a) + w / 2
    return np.sign(x) * np.sqrt(np.sqrt(b * b - w / a) - b)


class Restaurants:
    """Dishes side by side: customers c of dish i in restaurant of[i]; one customer sits at one table, more are sampled."""

    def __init__(self, c: np.ndarray, of: np.ndarray, key: np.ndarray, d: float, theta: float, copies: np.ndarray):
        self.c, self.of, self.key, self.d, self.theta, self.copies = c, of, key, d, theta, copies
        some = np.flatnonzero(c > 1)
        self.some = some[np.argsort(c[some], kind="stable")]
        self.sweep = 0
        self.t = (c > 0).astype(np.float64)

    def sample(self, base: np.ndarray) -> np.ndarray:
        """One sweep under the parent's probabilities ``base``; the tables of all dishes."""
        tables = np.bincount(self.of, self.t, len(self.copies)) * self.copies
        k = self.some
        rate = np.maximum((self.theta + self.d * tables[self.of[k]]) * base[k], 1e-12)
        c, u = self.c[k], _uniform(self.key[k], self.sweep, 0)
        exact = (c <= TABLES) | ((c <= EXACT) & (rate / self.d < TABLES / 2))
        t = np.empty(len(k))
        t[exact] = exact_tables(c[exact], rate[exact], self.d, u[exact])
        many = ~exact
        t[many] = np.minimum(c[many], 1 + poisson(mean_tables_of_many(c[many].astype(np.float64), rate[many], self.d) - 1, u[many]))
        self.t = self.t.copy()
        self.t[k] = t
        self.sweep += 1
        return self.t

    def mean_tables(self, base: np.ndarray, burn_in: int, samples: int) -> np.ndarray:
        for _ in range(burn_in):
            self.sample(base)
        return sum(self.sample(base) for _ in range(samples)) / samples


# Chunks ask


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and one end for each row: hash, hash of what precedes (a start mark at first), row."""
    data = W.lower(data)
    starts, lens, before = W.split(data, offsets)
    n = np.diff(before)
    word = np.empty(len(starts) + len(n), np.uint64)
    end = np.cumsum(n + 1) - 1
    inside = np.ones(len(word), bool)
    inside[end] = False
    word[inside] = W.hashes(data, starts, lens, 11)
    word[end] = _END
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[:1] = _START
    context[end[:-1] + 1] = _START
    return word, context, np.repeat(np.arange(len(n)), n + 1)


def _chunks(off: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in spans_of_rows(off, _CHUNK):
        for x in range(a, b, _CHUNK_ROWS):
            yield x, min(b, x + _CHUNK_ROWS)


def _common(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Contexts with half a bucket's share or more of a chunk's tokens; and, as context 0, the number of all tokens."""
    for batch in batches:
        data, off = text_buffer(column_of(batch, "text"))
        for a, b in _chunks(off):
            _, context, _ = _tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])
            u, n = np.unique(context, return_counts=True)
            keep = 2 * buckets * n >= len(context)
            u, n = np.append(u[keep], np.uint64(0)), np.append(n[keep], len(context))
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(n)], names=["context", "n"])


def _dealt(context: np.ndarray, word: np.ndarray, hot: dict[int, int]) -> np.ndarray:
    """Keys of restaurants; a hot context has one for each of its parts, by word."""
    out = context.copy()
    for u, parts in hot.items():
        at = np.flatnonzero(context == np.uint64(u))
        out[at] = W.joined(context[at], W.mix(word[at]) % np.uint64(parts))
    return W.mix(out)


def _hot_restaurants(hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the restaurants of hot contexts (sorted), their contexts and numbers of parts."""
    u = np.repeat(np.array(list(hot), np.uint64), list(hot.values()))
    part = np.concatenate([np.arange(n, dtype=np.uint64) for n in hot.values()]) if hot else u
    key = W.mix(W.joined(u, part))
    order = np.argsort(key)
    return key[order], u[order], np.repeat(list(hot.values()), list(hot.values())).astype(np.float64)[order]


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


_ASKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])
_ASK_TYPES = ("<u8", "<u4", "<u8", "<u4", "<u2", "<u4")


def _ask(batches: Iterator[pa.RecordBatch], buckets: int, hot: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Per chunk and bucket: contexts, their numbers of words, the words, their numbers of documents, documents and counts;
    and the chunk's documents themselves, to a bucket beyond."""
    task = TaskContext.get()
    chunk = (task.partitionId() if task else 0) << 32
    for batch in batches:
        data, off = text_buffer(column_of(batch, "text"))
        ids, held = column_of(batch, "doc_id"), column_of(batch, "held_out").to_numpy(zero_copy_only=False).astype(bool)
        for a, b in _chunks(off):
            word, context, row = _tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])
            key = _dealt(context, word, hot)
            keys, key = np.unique(key, return_inverse=True)
            words, word = np.unique(word, return_inverse=True)
            # Context, word and document as one number: numbers within a chunk need 61 bits at most.
            low, mid = int(b - a - 1).bit_length(), int(len(words) - 1).bit_length()
            one = (key.astype(np.uint64) << np.uint64(mid + low)) | (word.astype(np.uint64) << np.uint64(low)) | row.astype(np.uint64)
            one, n = np.unique(one, return_counts=True)
            n = n.astype("<u4")
            doc = (one & np.uint64((1 << low) - 1)).astype(np.uint16)
            pair = _changes(one >> np.uint64(low))
            ctx = _changes(one >> np.uint64(mid + low))
            word = words[((one >> np.uint64(low)) & np.uint64((1 << mid) - 1)).astype(np.int64)]
            key = keys[(one >> np.uint64(mid + low)).astype(np.int64)]
            mark = np.where(held[a:b][doc], np.uint16(0), _TRAIN)
            bucket = _bucket_of(key[ctx], buckets)
            first = _changes(bucket)
            out: list[list] = [[], [], []]
            for x, y in zip(first.tolist(), np.append(first, len(ctx))[1:].tolist(), strict=True):
                e0, e1 = ctx[x], ctx[y] if y < len(ctx) else len(key)
                p0, p1 = np.searchsorted(pair, (e0, e1))
                pairs = pair[p0:p1]
                words_of = np.diff(np.append(np.searchsorted(pairs, ctx[x:y]), len(pairs)))
                docs_of = np.diff(np.append(pairs, e1))
                out[0].append(int(bucket[x]))
                out[2].append(_pack(key[ctx[x:y]], words_of.astype("<u4"), word[pairs], docs_of.astype("<u4"), doc[e0:e1] | mark[e0:e1], n[e0:e1]))
            out[0].append(buckets + chunk % buckets)
            mine = ids.slice(a, b - a)
            known = np.asarray(mine.is_valid())
            out[2].append(_pack(mine.fill_null(0).to_numpy(), known, held[a:b], np.bincount(row, minlength=b - a).astype("<i8")))
            yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array([chunk] * len(out[0]), pa.int64()), pa.array(out[2], pa.binary())], schema=_ASKED)
            chunk += 1


class _Bucket:
    """The pairs of a bucket over all chunks, sorted by restaurant and word."""

    def __init__(self, bodies: list[bytes], hot: dict[int, int], discounts, strengths):
        key, word, c, self.entries = [], [], [], []
        for body in bodies:
            v, words_of, w, docs_of, doc, n = _unpack(body, *_ASK_TYPES)
            train = np.where(doc & _TRAIN, n, 0).astype(np.int64)
            key.append(np.repeat(v, words_of))
            word.append(w)
            c.append(np.add.reduceat(train, np.cumsum(docs_of, dtype=np.int64) - docs_of))
            self.entries.append((np.repeat(np.arange(len(w)), docs_of), doc & ~_TRAIN, n))
        at = np.cumsum([0, *map(len, word)])
        key, word, c = np.concatenate(key), np.concatenate(word), np.concatenate(c)
        keys, key = np.unique(key, return_inverse=True)
        self.words, word = np.unique(word, return_inverse=True)
        one, place = np.unique(key.astype(np.int64) * len(self.words) + word, return_inverse=True)
        self.entries = [(place[a + pair], doc, n) for a, (pair, doc, n) in zip(at[:-1].tolist(), self.entries, strict=True)]
        self.c = np.bincount(place, c, len(one)).astype(np.int64)
        self.of, self.word_at = one // len(self.words), one % len(self.words)
        self.key, self.word = keys[self.of], self.words[self.word_at]
        hot_key, hot_context, parts = _hot_restaurants(hot)
        self.copies, self.hot = np.ones(len(keys)), np.zeros(0, np.int64)
        if len(hot_key):
            found = np.minimum(np.searchsorted(hot_key, keys), len(hot_key) - 1)
            self.hot = np.flatnonzero(hot_key[found] == keys)
            self.hot_context = hot_context[found[self.hot]]
            self.copies[self.hot] = parts[found[self.hot]]
        self.d, self.theta = discounts[1], strengths[1]
        self.seats = Restaurants(self.c, self.of, W.joined(self.key, self.word), self.d, self.theta, self.copies)

    def of_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, x, len(self.copies))

    def parts(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The parent's parts of the words and of the hot contexts."""
        return _parts_of(self.words, parts), _parts_of(self.hot_context, parts) if len(self.hot) else np.zeros(0, np.int64)

    def probabilities(self, answers: list[dict], parts: int, discounts, strengths) -> tuple[np.ndarray, np.ndarray, float, float]:
        """P(word | context) of all pairs, training counts of the words, training tokens and distinct ones."""
        where, hot_where = self.parts(parts)
        count, rest, c_u = np.zeros(len(self.words), np.int64), np.zeros(len(self.words)), self.of_context(self.c)
        hot_t, told_t, sums = np.zeros(len(self.hot)), np.zeros(len(self.hot)), np.zeros(4)
        for r in answers:
            k, h = np.flatnonzero(where == r["part"]), np.flatnonzero(hot_where == r["part"])
            count[k], rest[k], c_u[self.hot[h]], hot_t[h], told_t[h], own = _unpack(r["body"], *_ANSWER_TYPES)
            sums += own
        customers, tables, seen, total = sums.tolist()
        parent = ((rest + (strengths[0] + discounts[0] * tables) / (seen + 1)) / (strengths[0] + customers))[self.word_at]
        # A piece of a hot context stands for the whole by its share of the tables that all pieces told.
        self.copies[self.hot] = hot_t / np.maximum(told_t, 1.0)
        t = self.seats.mean_tables(parent, BURN_IN, SAMPLES)
        t_u = self.of_context(t) * self.copies
        t_u[self.hot] = np.where(told_t > 0, t_u[self.hot], hot_t)
        own = np.maximum(self.c - self.d * t, 0.0)
        return (own + (self.theta + self.d * t_u[self.of]) * parent) / (self.theta + c_u[self.of]), count, total, seen


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (W.mix(keys ^ np.uint64(0x9A47)) % np.uint64(parts)).astype(np.int64)


_TOLD = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
_TOLD_TYPES = ("<u8", "<u4", "<u4", "<u8", "<i8", "<f8")


def _by_key(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each key of batches that are sorted by it."""
    now, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r[name] != now:
                if held:
                    yield now, held
                now, held = r[name], []
            held.append(r)
    if held:
        yield now, held


def _tell(batches: Iterator[pa.RecordBatch], buckets: int, parts: int, hot: dict[int, int], discounts, strengths) -> Iterator[pa.RecordBatch]:
    """Per bucket and part of the parent: its words in order with training counts and customers (the bucket's tables), and its
    pieces of hot contexts.  The bucket's own contexts stand for the parent here: a word's share of all pairs."""
    for bucket, rows in _by_key(batches, "bucket"):
        if bucket >= buckets:
            continue
        b = _Bucket([r["body"] for r in rows], hot, discounts, strengths)
        seen = np.bincount(b.word_at, b.c > 0, len(b.words)) + 1.0
        base = (seen / seen.sum())[b.word_at]
        for _ in range(SWEEPS):
            t = b.seats.sample(base)
        count = np.bincount(b.word_at, b.c, len(b.words)).astype(np.int64)
        customers = np.bincount(b.word_at, t, len(b.words)).astype(np.int64)
        where, hot_where = b.parts(parts)
        c_u, t_u = b.of_context(b.c)[b.hot].astype(np.int64), b.of_context(t)[b.hot]
        out = []
        for p in range(parts):
            k, h = np.flatnonzero(where == p), np.flatnonzero(hot_where == p)
            if len(k) or len(h):
                u = b.hot_context[h] if len(h) else np.zeros(0, np.uint64)
                out.append((p, _pack(b.words[k], count[k].astype("<u4"), customers[k].astype("<u4"), u, c_u[h], t_u[h])))
        yield pa.record_batch([pa.array([p for p, _ in out], pa.int32()), pa.array([bucket] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], schema=_TOLD)


_ANSWER_TYPES = ("<i8", "<f8", "<i8", "<f8", "<f8", "<f8")


def _answer(batches: Iterator[pa.RecordBatch], buckets: int, parts: int, discounts, strengths) -> Iterator[pa.RecordBatch]:
    """Each part of the parent seats its customers and answers every bucket, in the order asked: training counts, averaged
    c - d t, totals of hot contexts and what the bucket told of them; and the part's sums, to all buckets: customers, tables, words seen, training tokens."""
    d, theta = discounts[0], strengths[0]
    for part, rows in _by_key(batches, "part"):
        asked = [(r["bucket"], *_unpack(r["body"], *_TOLD_TYPES)) for r in rows]
        word, at = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
        count = np.bincount(at, np.concatenate([a[2] for a in asked]), len(word)).astype(np.int64)
        c = np.bincount(at, np.concatenate([a[3] for a in asked]), len(word)).astype(np.int64)
        hot, hot_at = np.unique(np.concatenate([a[4] for a in asked]), return_inverse=True)
        hot_c = np.bincount(hot_at, np.concatenate([a[5] for a in asked]), len(hot)).astype(np.int64)
        hot_t = np.bincount(hot_at, np.concatenate([a[6] for a in asked]), len(hot))
        # This part's dishes stand for all dishes of the parent: tables per dish are alike in every part.
        seats = Restaurants(c, np.zeros(len(c), np.int64), W.mix(word), d, theta / parts, np.ones(1))
        t = seats.mean_tables(np.full(len(c), 1.0 / ((c > 0).sum() + 1.0)), BURN_IN, SAMPLES)
        rest = np.maximum(c - d * t, 0.0)
        sums = np.array([c.sum(), t.sum(), (count > 0).sum(), count.sum()], np.float64)
        bodies, to, at_word, at_hot = [], [], 0, 0
        for a in asked:
            k, h = at[at_word : at_word + len(a[1])], hot_at[at_hot : at_hot + len(a[4])]
            at_word, at_hot = at_word + len(a[1]), at_hot + len(a[4])
            bodies.append(_pack(count[k], rest[k], hot_c[h], hot_t[h], a[6], sums))
            to.append(a[0])
        nothing = np.zeros(0)
        for other in sorted(set(range(buckets)) - set(to)):
            bodies.append(_pack(nothing.astype("<i8"), nothing, nothing.astype("<i8"), nothing, nothing, sums))
            to.append(other)
        yield pa.record_batch([pa.array([part] * len(to), pa.int32()), pa.array(to, pa.int32()), pa.array(bodies, pa.binary())], schema=_TOLD)


_SCORED = pa.schema([("chunk", pa.int64()), ("docs", pa.bool_()), ("body", pa.binary())])
_SCORE_TYPES = ("<u2", "<f8", "<f8", "<u4", "<f8")


def _score(asked: pa.Table, told: pa.Table, buckets: int, parts: int, hot: dict[int, int], discounts, strengths) -> pa.Table:
    """One bucket: seats its restaurants under the parent's answer; sums over each chunk's documents of log10 P(word | context),
    log10(count + 1) and tokens that training has."""
    if not asked.num_rows:
        return _SCORED.empty_table()
    chunks, bodies = asked.column("chunk").to_pylist(), asked.column("body").to_pylist()
    if asked.column("bucket")[0].as_py() >= buckets:
        return pa.table([pa.array(chunks, pa.int64()), pa.array([True] * len(chunks)), pa.array(bodies, pa.binary())], schema=_SCORED)
    b = _Bucket(bodies, hot, discounts, strengths)
    p, count, total, seen = b.probabilities(told.to_pylist(), parts, discounts, strengths)
    p = np.log10(p)
    plain, known = np.log10(count + 1.0)[b.word_at], (count > 0)[b.word_at]
    out = []
    for pair, doc, n in b.entries:
        size = int(doc.max()) + 1
        here = np.flatnonzero(np.bincount(doc, minlength=size))
        lane = lambda x: np.bincount(doc, n * x[pair], size)[here]  # noqa: E731, B023
        out.append(_pack(here.astype("<u2"), lane(p), lane(plain), lane(known).astype("<u4"), np.array([total, seen])))
    return pa.table([pa.array(chunks, pa.int64()), pa.array([False] * len(chunks)), pa.array(out, pa.binary())], schema=_SCORED)


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64()),
])
_OUT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by chunk: sums of its documents over all buckets."""
    for _, rows in _by_key(batches, "chunk"):
        ids, known_id, held, n = _unpack(next(r["body"] for r in rows if r["docs"]), "<i8", "?", "?", "<i8")
        score, plain, known = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), np.int64)
        for r in rows:
            if not r["docs"]:
                doc, p, q, k, (total, seen) = _unpack(r["body"], *_SCORE_TYPES)
                score[doc] += p
                plain[doc] += q
                known[doc] += k
        base = plain - n * np.log10(total + seen + 1)
        columns = [
            pa.array(ids, mask=~known_id), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(n), int(total))), pa.array(base),
            pa.array(score), pa.array(10.0 ** np.minimum(-score / n, 300.0)),
        ]
        yield pa.record_batch(columns, schema=_OUT)


def score_texts(docs: DataFrame, held_out: Column, discounts=DISCOUNTS, strengths=STRENGTHS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    Tokens are runs of bytes outside space and 0x09-0x0D, A-Z lower-cased, and one end for each text.  Rows where ``held_out``
    isn't true are learned from (null counts as not held out); all rows are scored, whole.  n_known: tokens that
    training has; train_tokens: tokens of training texts; base_score: sum of log10((c + 1) / (train_tokens + V + 1)) over
    tokens, c their training counts and V the distinct training tokens; score: the model's log10 probability of the text, end
    included; perplexity: 10 ** (-score / n_tokens), at most 1e300.  The probabilities of all words and "any other" add
    up to 1 in every context (but for contexts dealt to several buckets, where each piece estimates all tables from its own).
    Null and empty texts have the end alone.  Without training texts every token has probability 1 / (V + 1) = 1.  Null and
    repeated doc_ids are passed on, row by row; an empty table gives no rows; other columns are ignored.  Words are told apart by 64 bits.
    """
    spark = docs.sparkSession
    importable(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = text.agg(F.sum(F.octet_length("text").cast("long") + 1).alias("n")).first()["n"] or 0
    buckets = max(LEAST_BUCKETS, -(-size // bucket_bytes))
    parts = min(buckets, MOST_PARTS)
    # At most 2 * buckets contexts have half a bucket's share each.
    common = arrow_map(text.select("text"), lambda b: _common(b, buckets), "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
    total = common.where("context = 0")
    common = common.join(F.broadcast(total.select(F.col("n").alias("total")))).where("context != 0").where(F.col("n") * 2 * buckets >= F.col("total"))
    hot = {r["context"] & (1 << 64) - 1: -(-2 * buckets * r["n"] // r["total"]) for r in common.collect()}

    width = max(shuffle_width(spark), 2 * buckets)
    asked = arrow_map(text, lambda b: _ask(b, buckets, hot), "bucket int, chunk long, body binary").repartition(width, "bucket")
    told = arrow_map(asked.sortWithinPartitions("bucket"), lambda b: _tell(b, buckets, parts, hot, discounts, strengths), "part int, bucket int, body binary")
    told = told.repartition(max(shuffle_width(spark), parts), "part").sortWithinPartitions("part", "bucket")
    answers = arrow_map(told, lambda b: _answer(b, buckets, parts, discounts, strengths), "part int, bucket int, body binary").repartition(width, "bucket")
    scored = asked.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
        lambda left, right: _score(left, right, buckets, parts, hot, discounts, strengths), "chunk long, docs boolean, body binary"
    )
    return arrow_map(scored.repartition(shuffle_width(spark), "chunk").sortWithinPartitions("chunk"), _gather, _OUT_DDL)
