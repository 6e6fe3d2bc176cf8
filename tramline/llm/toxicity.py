"""Toxicity by a subsequence string kernel with Nystrom landmarks and a linear support vector machine.

Kernel: two units (words) are alike by the runs of P characters that they share as subsequences, a gap of g characters costing
LAMBDA ** g, with at most GAPS characters skipped; so inserted or missing characters weaken a match and don't break it.
Digits and signs inside a word are no characters, and single letters in a row ("i d i o t") are one unit.

Training (on a bounded sample of labelled rows, on the driver): documents carry the labels, sentences inherit them through
their units.  Every toxic document must have one toxic unit, others none (multiple-instance learning): a first weight
for each contiguous run comes from document counts, then the highest unit of each toxic document and the highest and random
ones of the others train the SVM in the Nystrom space of the landmarks, a few times over.

Scoring: in the feature space of subsequences the SVM over landmarks is one weight per subsequence, a table of 32 ** P
numbers.  A unit's margin is a sum of table look-ups along the text, vectorised over bytes; a document has the margin of its
highest units, mapped to 0 .. 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, column_of, spans_of_rows, text_buffer

P, GAPS, LAMBDA = 4, 2, 0.5
#: Rows and bytes of a row that training may use, landmarks, and rounds of choosing units anew.
MOST_ROWS, MOST_BYTES, LANDMARKS, ROUNDS = 2_400, 12_000, 256, 3
#: Toxic units of LONG letters or more, and as many clean ones, are also trained with one letter more, less or other inside;
#: about MISSPELT examples in all, one of each kind at least.
SPELLINGS, LONG, MISSPELT = ("more", "less", "other"), 5, 600
_CHUNK = 1 << 20
_SKIP, _SPACE = 255, 0

#: Positions of a subsequence's later characters relative to its first, and its number of skipped characters.
_SHAPES = [(c, c[-1] - P + 1) for c in combinations(range(1, P + GAPS), P - 1)]

# 32 classes: 0 is the start of a unit, 1-26 letters without case, 27-31 characters beyond ASCII by their last byte, case dropped.
_CLASS = np.full(256, _SKIP, np.uint8)
_CLASS[[0x20, 9, 10, 11, 12, 13]] = _SPACE
for _k in range(26):
    _CLASS[65 + _k] = _CLASS[97 + _k] = _k + 1
_CLASS[0x80:0xC0] = 27 + (np.arange(0x80, 0xC0) & 31) % 5


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of all units, each begun by class 0; where each unit begins; the row of each unit)."""
    cls = _CLASS[data]
    at = np.flatnonzero(cls != _SKIP)
    cls = cls[at]
    row = np.searchsorted(offsets, at, side="right") - 1
    new_row = np.ones(len(row), bool)
    new_row[1:] = row[1:] != row[:-1]
    # Every row begins with a space of its own; spaces in a row collapse.
    rows_before = np.cumsum(new_row)
    size = len(cls) + int(rows_before[-1]) if len(cls) else 0
    seq, of = np.zeros(size, np.uint8), np.zeros(size, np.int64)
    if not size:
        return seq, np.zeros(0, np.int64), np.zeros(0, np.int64)
    seq[np.arange(len(cls)) + rows_before] = cls
    of[np.arange(len(cls)) + rows_before] = row
    heads = np.flatnonzero(new_row)
    of[heads + np.arange(len(heads))] = row[heads]
    keep = np.ones(size, bool)
    keep[:-1] = (seq[:-1] != _SPACE) | (seq[1:] != _SPACE)
    keep[-1] = seq[-1] != _SPACE
    keep[:-1] &= (seq[:-1] != _SPACE) | (of[1:] == of[:-1])
    seq, of = seq[keep], of[keep]
    # Single letters in a row are one unit: a space between two units of one letter is dropped.
    begin = np.flatnonzero(seq == _SPACE)
    length = np.diff(np.append(begin, len(seq))) - 1
    single = (length == 1) & (of[begin] >= 0)
    inner = np.zeros(len(begin), bool)
    inner[1:] = single[1:] & single[:-1] & (of[begin[1:]] == of[begin[:-1]])
    keep = np.ones(len(seq), bool)
    keep[begin[inner]] = False
    seq, of = seq[keep], of[keep]
    begin = np.flatnonzero(seq == _SPACE)
    return seq, begin, of[begin]


def codes(seq: np.ndarray, begin: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the subsequences of one shape at all positions, and which of them lie within one unit."""
    reach = shape[-1]
    n = max(0, len(seq) - reach)
    code = seq[:n].astype(np.int32)
    for d in shape:
        code = (code << 5) | seq[d : d + n]
    inside = np.zeros(len(seq) + 1, np.int32)
    inside[begin] = 1
    unit = np.cumsum(inside[:-1])
    return code, unit[:n] == unit[reach : reach + n]


def margins(seq: np.ndarray, begin: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of table weights over each unit's subsequences, divided by the root of its length."""
    total = np.zeros(len(seq), np.float32)
    for shape, gap in _SHAPES:
        code, ok = codes(seq, begin, shape)
        total[: len(code)] += np.where(ok, table[code], 0) * np.float32(LAMBDA**gap)
    if not len(begin):
        return np.zeros(0, np.float32)
    length = np.diff(np.append(begin, len(seq)))
    return np.add.reduceat(total, begin) / np.sqrt(length).astype(np.float32)


def features(seq: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, code, weight) of all subsequences, normalised by unit as in ``margins``."""
    unit = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(seq))))
    root = 1 / np.sqrt(np.diff(np.append(begin, len(seq))))
    out = []
    for shape, gap in _SHAPES:
        code, ok = codes(seq, begin, shape)
        out.append((unit[: len(code)][ok], code[ok], root[unit[: len(code)][ok]] * LAMBDA**gap))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _dense(unit: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int, columns: np.ndarray) -> np.ndarray:
    place = np.searchsorted(columns, code)
    place[place == len(columns)] = 0
    ok = columns[place] == code
    x = np.zeros((n, len(columns)), np.float32)
    np.add.at(x, (unit[ok], place[ok]), weight[ok])
    return x


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60, seed: int = 3) -> np.ndarray:
    """Linear SVM with squared hinge loss by dual coordinate descent; the last column of z is the bias."""
    draw = np.random.default_rng(seed)
    w, alpha = np.zeros(z.shape[1]), np.zeros(len(z))
    diagonal = (z * z).sum(1) + 0.5 / cost
    for _ in range(rounds):
        for i in draw.permutation(len(z)):
            g = y[i] * (z[i] @ w) - 1 + alpha[i] * 0.5 / cost[i]
            new = max(0.0, alpha[i] - g / diagonal[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * z[i]
                alpha[i] = new
    return w


def misspelt(unit: np.ndarray, kind: str, draw: np.random.Generator) -> np.ndarray:
    """The unit with one letter more, less, or other inside, drawn at random; its first and last letter stay."""
    at = int(draw.integers(2, len(unit) - 1))
    letter = np.array([draw.integers(1, 27)], np.uint8)
    return np.concatenate([unit[:at], unit[:0] if kind == "less" else letter, unit[at if kind == "more" else at + 1 :]])


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 5, rate: float | None = None) -> tuple[np.ndarray, float, float]:
    """(table, slope, offset) from whole labelled texts; a sample without both labels gives a table of zeros.

    Where no unit tells toxic texts from clean ones, every score is ``rate``, the share of toxic labels (of the sample's, if none is given).
    """
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    seq, begin, row = units(np.frombuffer(b"".join(texts), np.uint8), offsets)
    table = np.zeros(1 << (5 * P), np.float32)
    y = np.asarray(labels, bool)
    if y.all() or not y.any() or not len(begin):
        return table, 0.0, -10.0 if not y.any() else 10.0
    # First weights: contiguous runs by the documents that have them.
    code, ok = codes(seq, begin, _SHAPES[0][0])
    of = np.repeat(row, np.diff(np.append(begin, len(seq))))[: len(code)][ok]
    pairs = np.unique(code[ok].astype(np.int64) * len(y) + of)
    c, d = pairs // len(y), pairs % len(y)
    pos, neg = np.bincount(c[y[d]], minlength=len(table)), np.bincount(c[~y[d]], minlength=len(table))
    odds = np.log((pos + 0.1) / (y.sum() + 0.2)) - np.log((neg + 0.1) / ((~y).sum() + 0.2))
    table = np.where(pos >= 3, odds, np.minimum(odds, 0)).astype(np.float32)
    length = np.diff(np.append(begin, len(seq)))
    draw = np.random.default_rng(seed)

    def top(score: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` highest units of each document."""
        order = np.lexsort((-score, row))
        r = row[order]
        first = np.searchsorted(r, r)
        return order[np.arange(len(r)) - first < most]

    base = float(np.clip(y.mean() if rate is None else rate, 1e-4, 1 - 1e-4))
    slope, offset, learned = 0.0, float(np.log(base / (1 - base))), False
    for _ in range(ROUNDS):
        score = margins(seq, begin, table)
        best = top(score, 1)
        hard = best[~y[row[best]]]
        high = top(np.where(length > P, score, -np.inf), 2)
        chosen_pos = high[y[row[high]]]
        chosen_pos = chosen_pos[score[chosen_pos] > 0]
        hard = hard[np.argsort(-score[hard])[:1500]]
        others = np.flatnonzero(~y[row] & (length > P))
        chosen_neg = np.unique(np.concatenate([hard, draw.choice(others, min(2500, len(others)), replace=False)])) if len(others) else hard
        # One example of each distinct unit.
        chosen = np.concatenate([chosen_pos, chosen_neg])
        names: dict[tuple, int] = {}
        for k in chosen.tolist():
            names.setdefault((seq[begin[k] : begin[k] + length[k]].tobytes(), bool(y[row[k]])), k)
        good = {s for s, toxic in names if not toxic}
        chosen = np.array([k for (s, toxic), k in names.items() if not (toxic and s in good)], np.int64)
        strings = [seq[begin[k] : begin[k] + length[k]] for k in chosen]
        toxic = y[row[chosen]].tolist()
        # Misspelt: toxic units that lead their documents, the fewer they are the more of each, and as many clean units.
        leading = {seq[begin[k] : begin[k] + length[k]].tobytes() for k in best[y[row[best]]]}
        sure = [u for u, bad in zip(strings, toxic, strict=True) if bad and len(u) > LONG and u.tobytes() in leading]
        plain = [u for u, bad in zip(strings, toxic, strict=True) if not bad and len(u) > LONG]
        each = min(12, max(1, MISSPELT // (len(SPELLINGS) * max(1, len(sure)))))
        more = [misspelt(u, kind, draw) for u in sure for kind in SPELLINGS for _ in range(each)]
        less = [misspelt(plain[k], SPELLINGS[i % len(SPELLINGS)], draw) for i, k in enumerate(draw.permutation(len(plain))[: len(more)])]
        strings, toxic = strings + more + less, toxic + [True] * len(more) + [False] * len(less)
        if not any(toxic):
            break
        label = np.where(toxic, 1.0, -1.0)
        sub = np.concatenate(strings)
        cut = np.concatenate([[0], np.cumsum([len(s) for s in strings])[:-1]])
        unit, code, weight = features(sub, cut)
        pos_k, neg_k = np.flatnonzero(label > 0), np.flatnonzero(label < 0)
        marks = np.concatenate([
            draw.permutation(pos_k)[: LANDMARKS * 3 // 4], neg_k[: LANDMARKS // 8], draw.permutation(neg_k)[: LANDMARKS // 8]
        ])
        mine = np.isin(unit, marks)
        columns = np.unique(code[mine])
        if not len(columns):
            break
        landmark = np.zeros((len(marks), len(columns)), np.float32)
        for j, k in enumerate(marks):
            own = unit == k
            landmark[j] = _dense(np.zeros(own.sum(), np.int64), code[own], weight[own], 1, columns)[0]
        kmm = landmark @ landmark.T
        value, vector = np.linalg.eigh(kmm.astype(np.float64))
        keep = value > 1e-6 * value[-1]
        root = vector[:, keep] / np.sqrt(value[keep])
        z = _nystrom(unit, code, weight, len(strings), columns, landmark)
        z = z @ root
        z = np.hstack([z, np.ones((len(z), 1))])
        cost = np.where(label > 0, 10.0 * max(1.0, (label < 0).sum() / len(pos_k)) / 4, 10.0)
        w = _svm(z, label, cost)
        table = np.zeros(1 << (5 * P), np.float32)
        table[columns] = landmark.T @ (root @ w[:-1])
        bias = w[-1]
        # A sigmoid over documents' highest units.
        score = margins(seq, begin, table) + bias
        doc = np.full(len(y), -3.0)
        np.maximum.at(doc, row, score)
        slope, offset = _sigmoid(doc, y)
        offset += slope * bias
        learned = True
    return (table, slope, offset) if learned else (np.zeros_like(table), slope, offset)


def _nystrom(unit, code, weight, n: int, columns: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """Kernel values of n units with the landmarks, some units at a time."""
    order = np.argsort(unit, kind="stable")
    unit, code, weight = unit[order], code[order], weight[order]
    out = []
    for a in range(0, n, 500):
        x, y = np.searchsorted(unit, [a, a + 500])
        out.append(_dense(unit[x:y] - a, code[x:y], weight[x:y], min(500, n - a), columns) @ landmark.T)
    return np.concatenate(out)


def _sigmoid(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with smoothed targets, by Newton's steps."""
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g = np.array([((p - t) * score).sum() + 1e-3 * a, (p - t).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * score * score).sum() + 1e-3, (q * score).sum()], [(q * score).sum(), q.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.1)), float(b)


def training_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> tuple[list[bytes], np.ndarray, float]:
    """The share of toxic labels, and whole texts and labels of at most ``most`` labelled rows outside the held-out fold (crc32(doc_id) mod 4 is 2), half
    of them toxic if there are enough, chosen by a hash of doc_id; texts over MOST_BYTES aren't used for training, and of the
    texts of a doc_id the least is."""
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    order = F.xxhash64("doc_id"), F.col("doc_id")
    rate = ids.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    toxic = ids.where("toxic = 1").orderBy(*order).limit(most // 2)
    clean = ids.where("toxic = 0").orderBy(*order).limit(most // 2)
    chosen = {r["doc_id"]: r["toxic"] for r in toxic.unionByName(clean).collect()}
    spark = docs.sparkSession
    few = spark.createDataFrame([(i, t) for i, t in chosen.items()], "doc_id long, toxic int")
    rows = docs.where(F.octet_length("text") <= MOST_BYTES).select("doc_id", "text").join(F.broadcast(few), "doc_id")
    got = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect())
    return [t.encode() + b" \n" for _, t, _ in got], np.array([y for _, _, y in got]), rate


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """(doc_id, score) of every whole text of ``docs``; null and empty texts get the lowest score, 0.  One scan, no exchange."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, slope, offset = held.value
        for batch in batches:
            data, off = text_buffer(column_of(batch, "text"))
            out = np.zeros(batch.num_rows)
            for a, b in spans_of_rows(off, _CHUNK):
                seq, begin, row = units(data[off[a] : off[b]], off[a : b + 1] - off[a])
                if len(begin):
                    best = np.full(b - a, -np.inf)
                    np.maximum.at(best, row, margins(seq, begin, table).astype(np.float64))
                    out[a:b] = np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(slope * best + offset, -60, 60))), 0.0)
            yield pa.record_batch([column_of(batch, "doc_id"), pa.array(out)], schema=_OUT)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted (1 if score >= threshold).

    Learns from ``labels`` (doc_id, toxic) outside the held-out fold; a doc_id labelled twice counts as toxic if either is.
    Without labels every score is that of a model that knows nothing, near 0; where no word tells the labels apart, it is the share of
    toxic labels.  Empty texts score 0.  A null doc_id isn't held out.  Repeated rows
    are scored each; an empty table gives no rows; other columns are ignored.
    """
    texts, y, rate = training_sample(docs, labels)
    model = fit(texts, y, rate=rate) if len(texts) else (np.zeros(1 << (5 * P), np.float32), 0.0, -10.0)
    out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2).alias("held_out")
    return score(docs, model).select("doc_id", out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
