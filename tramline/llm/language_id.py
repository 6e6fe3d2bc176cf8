"""Language identification with a linear-chain conditional random field over words.

Features of a word: its character runs of 2 to 4 bytes, those at its ends marked as affixes, and the word itself (lexicon),
each hashed into a table of weights for every language.  Transitions between the languages of neighbouring words are learned
too.  Forward-backward gives every word's probabilities; a text's are their mean.  Sentences are the chains.

Training runs on the driver over a bounded sample of labelled rows: each word starts from its document's language, and
sequences are put together from sentences of different documents, so that transitions see switches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import arrow_map, column_of, set_aside, spans_of_rows, text_buffer
from .words import mix

BUCKET_BITS, GRAMS = 17, (2, 3, 4)
#: Rows of each language and bytes of a row that training may use; words of a piece of a chain; rounds over the sample.
MOST_ROWS, MOST_BYTES, CHAIN, EPOCHS = 400, 8_000, 64, 3
_CHUNK = 1 << 20
_SHARP = 4.0

# 0: no letter, dropped.  32: word boundary.  Other bytes: ASCII letters in lower case and all bytes beyond ASCII.
_BYTE = np.zeros(256, np.uint8)
_BYTE[[0x20, 9, 10, 11, 12, 13]] = 32
for _k in range(26):
    _BYTE[65 + _k] = _BYTE[97 + _k] = 97 + _k
_BYTE[128:] = np.arange(128, 256)
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True


def word_units(data: np.ndarray, offsets: np.ndarray, places: bool = False) -> tuple[np.ndarray, ...]:
    """(bytes of all words, each begun by a boundary; where each begins; row of each; whether a sentence ends before it);
    with ``places`` also the first byte of each in ``data`` and the one after its last."""
    byte = _BYTE[data]
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    capital = after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    byte[capital] += 0x20
    stops = np.cumsum(_ENDS[data])
    at = np.flatnonzero(byte != 0)
    # A boundary of its own before every row.
    row = np.searchsorted(offsets, at, side="right") - 1
    head = np.ones(len(at), bool)
    head[1:] = row[1:] != row[:-1]
    place = np.arange(len(at)) + np.cumsum(head)
    size = int(place[-1]) + 1 if len(at) else 0
    seq, of, stop = np.full(size, 32, np.uint8), np.zeros(size, np.int64), np.zeros(size, np.int64)
    seq[place], of[place], stop[place] = byte[at], row, stops[at]
    of[place[head] - 1], stop[place[head] - 1] = row[head], stops[at[head]]
    source = np.zeros(size, np.int64)
    source[place] = at
    edge = seq == 32
    keep = np.ones(size, bool)
    if size:
        keep[:-1] = ~(edge[:-1] & edge[1:])
        keep[-1] = not edge[-1]
    seq, of, stop, source = seq[keep], of[keep], stop[keep], source[keep]
    begin = np.flatnonzero(seq == 32)
    of, stop = of[begin], stop[begin]
    new = np.ones(len(begin), bool)
    new[1:] = (of[1:] != of[:-1]) | (stop[1:] != stop[:-1])
    if places:
        return seq, begin, of, new, source[begin + 1], source[np.append(begin, len(seq))[1:] - 1] + 1
    return seq, begin, of, new


def _buckets(seq: np.ndarray, begin: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every kind of feature: bucket and word of each occurrence."""
    word = np.zeros(len(seq), np.int64)
    word[begin] = 1
    word = np.cumsum(word) - 1
    padded = np.concatenate([seq, np.full(4, 32, np.uint8)]).astype(np.uint32)
    edge = padded == 32
    out = []
    for n in GRAMS:
        code = np.full(len(seq), n, np.uint32)
        ok = np.ones(len(seq), bool)
        for k in range(n):
            code = code * np.uint32(0x01000193) ^ padded[k : k + len(seq)]
            if 0 < k < n - 1:
                ok &= ~edge[k : k + len(seq)]
        if n == 2:
            ok &= ~(edge[: len(seq)] & edge[1 : 1 + len(seq)])
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
        out.append((code[ok].astype(np.int64), word[ok]))
    h = mix(seq.astype(np.uint64) + (np.arange(len(seq)) - begin[word]).astype(np.uint64) * np.uint64(257)) if len(seq) else np.zeros(0, np.uint64)
    whole = mix(np.add.reduceat(h, begin)) if len(begin) else h
    out.append(((whole >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.arange(len(begin))))
    return out


def distinct_words(seq: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the distinct words, where each begins, number of the distinct word of every word), told apart by a 64-bit hash."""
    word = np.zeros(len(seq), np.int64)
    word[begin] = 1
    word = np.cumsum(word) - 1
    h = mix(seq.astype(np.uint64) + (np.arange(len(seq)) - begin[word]).astype(np.uint64) * np.uint64(257))
    _, one, which = np.unique(np.add.reduceat(h, begin), return_index=True, return_inverse=True)
    order = np.argsort(one, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    chosen = np.zeros(len(begin), bool)
    chosen[one] = True
    mine = chosen[word]
    sub = seq[mine]
    return sub, np.flatnonzero(sub == 32), rank[which]


def emissions(seq: np.ndarray, begin: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Scores of every word and language: the mean weight of each kind of feature; each distinct word is scored once."""
    seq, begin, which = distinct_words(seq, begin)
    total = np.zeros((len(begin), tables.shape[2]), np.float32)
    for table, (bucket, word) in zip(tables, _buckets(seq, begin), strict=True):
        if len(bucket):
            at = np.flatnonzero(np.diff(word, prepend=-1))
            count = np.diff(np.append(at, len(word)))[:, None].astype(np.float32)
            total[word[at]] += np.add.reduceat(table[bucket], at, axis=0) / count
    return _SHARP * total[which]


def chains(new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of every piece of a chain, and whether a piece goes on from the one before it.

    Chains are sentences of any length; pieces have at most CHAIN words, so that long chains are worked on side by side too.
    """
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(new)))
    parts = -(-length // CHAIN)
    which = np.repeat(np.arange(len(begin)), parts)
    number = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    return begin[which] + number * CHAIN, np.minimum(CHAIN, length[which] - number * CHAIN), number > 0


def forward_backward(emit: np.ndarray, first: np.ndarray, length: np.ndarray, follows: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probabilities of every word's language."""
    return marginals(emit, first, length, follows, moves)[0]


def _live(length: np.ndarray) -> list[int]:
    """For every step, how many of the pieces (longest first) still have a word."""
    return [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]) if len(length) else 0)]


def _norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _messages(p: np.ndarray, a: np.ndarray, first: np.ndarray, length: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What every piece gets from the words before it (a factor of its first word) and after it (a factor of its last word).

    A piece's words together are one matrix; the messages run along a chain over these matrices, all chains side by side.
    """
    ahead, behind = np.ones((len(first), p.shape[1]), np.float32), np.ones((len(first), p.shape[1]), np.float32)
    joined = follows | np.append(follows[1:], False)
    if not joined.any():
        return ahead, behind
    mine = np.flatnonzero(joined)
    order = mine[np.argsort(-length[mine], kind="stable")]
    whole = np.zeros((len(order), len(a), len(a)), np.float32)
    whole[:, np.arange(len(a)), np.arange(len(a))] = p[first[order]]
    for t, n in enumerate(_live(length[order])):
        if t:
            whole[:n] = (whole[:n] @ a) * p[first[order[:n]] + t][:, None, :]
        whole[:n] /= whole[:n].sum(axis=(1, 2), keepdims=True)
    at = np.zeros(len(first), np.int64)
    at[order] = np.arange(len(order))
    number = np.arange(len(first)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(first))))
    by = np.argsort(number, kind="stable")
    steps = np.split(by, np.searchsorted(number[by], np.arange(1, int(number.max()) + 1)))[1:]
    for k in steps:
        ahead[k] = _norm(np.einsum("ni,nij->nj", ahead[k - 1], whole[at[k - 1]]) @ a)
    for k in reversed(steps):
        behind[k - 1] = _norm(np.einsum("nij,nj->ni", whole[at[k]], behind[k]) @ a.T)
    return ahead, behind


def marginals(
    emit: np.ndarray, first: np.ndarray, length: np.ndarray, follows: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of every word's language, and expected number of moves between the languages of neighbouring words:
    forward-backward over all pieces side by side (scaled, longest first), with messages between the pieces of a chain."""
    p = np.exp(emit - emit.max(1, keepdims=True)).astype(np.float32) + np.float32(1e-20)
    a = np.exp(moves - moves.max()).astype(np.float32)
    enter, leave = _messages(p, a, first, length, follows)
    order = np.argsort(-length, kind="stable")
    first, length, follows = first[order], length[order], follows[order]
    live = _live(length)
    ahead = np.empty_like(p)
    now = None
    for t, n in enumerate(live):
        now = _norm((enter[order] if t == 0 else now[:n] @ a) * p[first[:n] + t])
        ahead[first[:n] + t] = now
    ends = first + length - 1
    last = ahead[ends]
    back = leave[order]
    moved = np.zeros(a.shape)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = first[:n] + t
        # The word before still has its forward probabilities; a pair's are before * move * (own score * backward).
        some = np.arange(n) if t else np.flatnonzero(follows)
        if len(some):
            before = ahead[at[some] - 1] if t else last[_place(ends, at[some] - 1)]
            after = p[at[some]] * back[some]
            total = ((before @ a) * after).sum(1, keepdims=True)
            moved += a * (before.T @ (after / np.maximum(total, np.float32(1e-30))))
        ahead[at] = _norm(ahead[at] * back[:n])
        back[:n] = _norm((back[:n] * p[at]) @ a.T)
    return ahead, moved


def _place(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in distinct unsorted values that have it."""
    order = np.argsort(values)
    return order[np.searchsorted(values, wanted, sorter=order)]


class Model:
    def __init__(self, names: list[str], tables: np.ndarray, moves: np.ndarray):
        self.names, self.tables, self.moves = names, tables, moves

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of the words of every row; a row without letters has zeros."""
        n = len(offsets) - 1
        seq, begin, row, new = word_units(data, offsets)
        out = np.zeros((n, len(self.names)))
        if len(begin):
            words = forward_backward(emissions(seq, begin, self.tables), *chains(new), self.moves)
            count = np.maximum(np.bincount(row, minlength=n), 1)
            for k in range(len(self.names)):
                out[:, k] = np.bincount(row, words[:, k], n) / count
        return out


def fit(texts: list[bytes], langs: list[str], seed: int = 11) -> Model:
    """Adagrad on the conditional log-likelihood; the gradient comes from forward-backward."""
    names = sorted(set(langs))
    k = len(names)
    tables = np.zeros((len(GRAMS) + 1, 1 << BUCKET_BITS, max(k, 1)), np.float32)
    moves = np.zeros((k, k))
    if k < 2:
        return Model(names, tables, moves)
    square, square_moves = np.full_like(tables, 1e-4), np.full((k, k), 1e-4)
    draw = np.random.default_rng(seed)
    gold_of = {n: i for i, n in enumerate(names)}
    # Sentences, so that those of different documents can stand side by side.
    pieces = [(s + b". ", gold_of[lang]) for t, lang in zip(texts, langs, strict=True) for s in t.replace(b".", b"\n").split(b"\n") if s.strip()]
    for _ in range(EPOCHS):
        order = draw.permutation(len(pieces))
        for low in range(0, len(order), 3000):
            part = [pieces[i] for i in order[low : low + 3000]]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s, _ in part])]).astype(np.int64)
            seq, begin, row, new = word_units(np.frombuffer(b"".join(s for s, _ in part), np.uint8), offsets)
            if not len(begin):
                continue
            gold = np.array([g for _, g in part])[row]
            # Two or three sentences of any documents make one chain, so that switches occur.
            joint = new & (draw.random(len(new)) < 0.5)
            joint[0] = True
            first, length, follows = chains(joint)
            buckets = _buckets(seq, begin)
            word_p, moved = marginals(emissions(seq, begin, tables), first, length, follows, moves)
            error = word_p.copy()
            error[np.arange(len(gold)), gold] -= 1
            for f, (bucket, word) in enumerate(buckets):
                count = np.maximum(np.bincount(word, minlength=len(begin)), 1)
                step = _SHARP * error / count[:, None]
                for j in range(k):
                    g = np.bincount(bucket, step[word, j], 1 << BUCKET_BITS) + 1e-3 * tables[f, :, j]
                    square[f, :, j] += g * g
                    tables[f, :, j] -= (0.5 * g / np.sqrt(square[f, :, j])).astype(np.float32)
            inner = np.ones(len(gold), bool)
            inner[first[~follows]] = False
            after = np.flatnonzero(inner)
            seen = np.bincount(gold[after - 1] * k + gold[after], minlength=k * k).reshape(k, k)
            g = (moved - seen) / max(1, len(after)) + 1e-4 * moves
            square_moves += g * g
            moves -= 0.5 * g / np.sqrt(square_moves)
    return Model(names, tables, moves)


def training_sample(docs: DataFrame, most: int = MOST_ROWS) -> tuple[list[bytes], list[str]]:
    """Whole texts and languages of at most ``most`` rows of each language outside the held-out fold, chosen by a hash of
    doc_id; of a text over MOST_BYTES a piece of MOST_BYTES / 4 code points at a hashed place.  Every language is learned,
    however many there are and however long their texts."""
    spark = docs.sparkSession
    piece, h = MOST_BYTES // 4, F.xxhash64("doc_id")
    at = F.pmod(h, F.greatest(F.lit(1), F.length("text") - piece + 1)).cast("int") + 1
    text = F.when(F.octet_length("text") <= MOST_BYTES, F.col("text")).otherwise(F.substr("text", at, F.lit(piece)))
    rows = docs.where("lang is not null and text is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    rows = rows.select("doc_id", text.alias("text"), "lang", h.alias("h"))
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not count:
        return [], []
    # The hashes below a bound that twice as many rows as wanted should pass; a language where too few did is sorted alone.
    bounds = spark.createDataFrame([(n, (2 * most + 64) / c) for n, c in count.items()], "lang string, bound double")
    near = rows.join(F.broadcast(bounds), "lang").where(F.col("h") / 2.0**64 + 0.5 <= F.col("bound"))
    order = "h", "doc_id", "text"
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("k") <= most)
    got = ranked.select("doc_id", "text", "lang").collect()
    found = Counter(r["lang"] for r in got)
    few = {n for n, c in count.items() if found[n] < min(most, c)}
    got = [r for r in got if r["lang"] not in few]
    for n in sorted(few):
        got += rows.where(F.col("lang") == n).orderBy(*order).limit(most).select("doc_id", "text", "lang").collect()
    got = sorted((r["doc_id"], r["text"], r["lang"]) for r in got)
    return [t.encode() for _, t, _ in got], [lang for _, _, lang in got]


_SPANS = pa.list_(
    pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("score", pa.float64())])
)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and lang_pred and score of its whole text.  One scan, no exchange."""
    held = docs.sparkSession.sparkContext.broadcast((model.names, model.tables, model.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            texts = column_of(batch, "text")
            data, off = text_buffer(texts)
            names, scores = [], []
            for a, b in spans_of_rows(off, _CHUNK):
                part, cut = data[off[a] : off[b]], off[a : b + 1] - off[a]
                p = own.documents(part, cut) if own.names else np.zeros((b - a, 1))
                ascii_letters = np.concatenate([[0], np.cumsum((_BYTE[part] >= 97) & (part < 128))])
                lettered = ascii_letters[cut[1:]] > ascii_letters[cut[:-1]]
                for i in range(b - a):
                    if own.names and (lettered[i] or any(c.isalpha() for c in texts[a + i].as_py() or "")):
                        k = int(p[i].argmax())
                        names.append(own.names[k])
                        scores.append(min(1.0, float(p[i, k])))
                    else:
                        names.append("und")
                        scores.append(0.0)
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*[column_of(batch, c) for c in keep], *made], [*keep, "lang_pred", "score"])

    out = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL("lang_pred string, score double").fields])
    return arrow_map(docs.select(*dict.fromkeys([*keep, "text"])), run, out)


def identify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang for training): doc_id, held_out, lang_pred, score.

    lang_pred is a learned language, or ``und`` if the text is null or has no letter (score 0).  Rows with crc32(doc_id) mod 4
    equal to 2 are never learned from.  If no row has a language, all are ``und``.  A null doc_id isn't held out.  Repeated
    rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    model = fit(*training_sample(docs))
    out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2).alias("held_out")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict(own, model, ["doc_id"]).select("doc_id", out, "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` with a language, all columns: not ``und``, and at least ``least`` of the words' probability on it.

    Each row is judged by its own text, whether its doc_id is null, repeated or its own.  Null and empty texts go; ties in
    probability fall to the first language in order; columns may have any names.
    """
    own, back = set_aside(docs, "text")
    judged = predict(own, fit(*training_sample(docs)), own.columns)
    return back(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= least)))


def label_spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang for training): doc_id, and spans of its text by language, in order.

    A span (begin, end, lang, n_words, score) is a run of words with the same most probable language; begin and end are
    code-point offsets, score the mean probability.  A text without letters, or where nothing is learned, has no spans.
    """
    model = fit(*training_sample(docs))
    held = docs.sparkSession.sparkContext.broadcast((model.names, model.tables, model.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            data, off = text_buffer(column_of(batch, "text"))
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for a, b in spans_of_rows(off, _CHUNK) if own.names else ():
                part, cut = data[off[a] : off[b]], off[a : b + 1] - off[a]
                seq, begin, row, new, start, end = word_units(part, cut, places=True)
                if not len(begin):
                    continue
                p = forward_backward(emissions(seq, begin, own.tables), *chains(new), own.moves)
                best = p.argmax(1)
                head = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (best[1:] != best[:-1])))
                upto = np.append(at[1:], len(row))
                score = np.add.reduceat(p[np.arange(len(best)), best].astype(np.float64), at) / (upto - at)
                base = head[cut[row[at]]]
                for r, x, y, k, n, q in zip(row[at], head[start[at]] - base, head[end[upto - 1]] - base, best[at], upto - at, score, strict=True):
                    spans[a + int(r)].append({"begin": int(x), "end": int(y), "lang": own.names[k], "n_words": int(n), "score": min(1.0, float(q))})
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(text, run, "doc_id long, spans array<struct<begin:long,end:long,lang:string,n_words:long,score:double>>")
