"""The Pitman-Yor language model against exact table distributions, a customer-by-customer sampler and plain counts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF
from pyspark.sql import functions as F

from tramline.llm import pitman_yor as P
from tramline.llm import queries as Q


def split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + ["</s>"]


def table_distribution(c, rate, d):
    """p(t) is proportional to rate**t times the generalised Stirling number of c and t."""
    s = [0.0, 1.0]
    for n in range(1, c):
        s = [0.0] + [(n - d * t) * (s[t] if t < len(s) else 0.0) + s[t - 1] for t in range(1, n + 2)]
        top = max(s)
        s = [x / top for x in s]
    p = np.array([x * rate**t for t, x in enumerate(s)])
    return p / p.sum()


@pytest.mark.parametrize(("c", "rate", "d"), [(2, 0.7, 0.8), (5, 0.3, 0.8), (9, 4.0, 0.5), (40, 1.5, 0.6), (120, 30.0, 0.8)])
def test_tables_follow_their_exact_distribution(c, rate, d):
    n = 100_000
    u = P._uniform(P.W.mix(np.arange(n, dtype=np.uint64)), 3, 0)
    t = P.exact_tables(np.full(n, c), np.full(n, rate), d, u).astype(int)
    assert abs(np.bincount(t, minlength=c + 1) / n - table_distribution(c, rate, d)).max() < 0.01


@pytest.mark.parametrize(("rate", "d"), [(0.2, 0.8), (9.0, 0.8), (3.0, 0.6), (150.0, 0.8), (100.0, 0.6)])
def test_many_customers_have_the_mean_of_the_matched_process(rate, d):
    """At EXACT customers the exact distribution and what is used beyond agree in the mean."""
    n = 20_000
    u = P._uniform(P.W.mix(np.arange(n, dtype=np.uint64)), 1, 0)
    exact = P.exact_tables(np.full(n, P.EXACT), np.full(n, rate), d, u)
    mean = P.mean_tables_of_many(np.full(1, float(P.EXACT)), np.full(1, rate), d)[0]
    many = 1 + P.poisson(np.full(n, mean - 1), u)
    assert abs(mean / exact.mean() - 1) < 0.04 and abs(many.mean() / mean - 1) < 0.02


def test_poisson_numbers():
    n = 50_000
    u = P._uniform(P.W.mix(np.arange(n, dtype=np.uint64)), 2, 0)
    for mean in (0.3, 7.0, 400.0, 5000.0):
        x = P.poisson(np.full(n, mean), u)
        assert abs(x.mean() / mean - 1) < 0.02 and abs(x.var() / mean - 1) < 0.05


def local_model(texts, held, buckets=3, parts=2, hot=None):
    """All buckets' pairs and probabilities, by the operator's own steps, without Spark."""
    hot = hot or {}
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(held)], names=["doc_id", "text", "held_out"])
    asked = pa.Table.from_batches(list(P._ask(iter([batch]), buckets, hot))).sort_by("bucket").to_batches()
    told = pa.Table.from_batches(list(P._tell(iter(asked), buckets, parts, hot, P.DISCOUNTS, P.STRENGTHS))).sort_by([("part", "ascending"), ("bucket", "ascending")])
    answers = pa.Table.from_batches(list(P._answer(iter(told.to_batches()), buckets, parts, P.DISCOUNTS, P.STRENGTHS))).to_pylist()
    for bucket, rows in P._by_key(iter(asked), "bucket"):
        if bucket < buckets:
            b = P._Bucket([r["body"] for r in rows], hot, P.DISCOUNTS, P.STRENGTHS)
            p, *_ = b.probabilities([a for a in answers if a["bucket"] == bucket], parts, P.DISCOUNTS, P.STRENGTHS)
            yield b, p


def test_probabilities_of_all_words_add_up_to_one():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    train = [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(12)], k=20)) for _ in range(40)]
    # Held-out texts that hold every pair, the end and one unknown word after each word.
    ask = [f"{u} {w}" for u in words for w in [*words, "unknown"]]
    total = defaultdict(float)
    for b, p in local_model(train + ask, [False] * len(train) + [True] * len(ask)):
        assert (p > 0).all()
        for k, x in zip(b.key.tolist(), p.tolist(), strict=True):
            total[k] += x
    known = {int(P.W.mix(h)) for w in words for h in P._tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][:1]}
    for k in known:
        assert abs(total[k] - 1) < 1e-9


def by_customers(train, discounts, strengths, sweeps, burn, seed):
    """Teh's sampler: each customer leaves and sits down again; averaged predictive probabilities."""
    rng = random.Random(seed)
    d0, d1, s0, s1 = *discounts, *strengths
    pairs = [(u, w) for t in train for u, w in zip(["<s>", *t[:-1]], t, strict=True)]
    vocab = {w for _, w in pairs}
    leaf, root = defaultdict(list), defaultdict(list)  # tables' sizes by dish
    n_leaf, t_leaf, n_root, t_root = Counter(), Counter(), [0], [0]

    def p_root(w):
        t = root[w]
        return (sum(t) - d0 * len(t) + (s0 + d0 * t_root[0]) / (len(vocab) + 1)) / (s0 + n_root[0])

    def p_leaf(u, w):
        t = leaf[u, w]
        return (sum(t) - d1 * len(t) + (s1 + d1 * t_leaf[u]) * p_root(w)) / (s1 + n_leaf[u])

    def sit(tables, d, new):
        at = rng.choices(range(len(tables) + 1), [k - d for k in tables] + [new])[0]
        if at == len(tables):
            tables.append(0)
        tables[at] += 1
        return tables[at] == 1

    def leave(tables):
        at = rng.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if not tables[at]:
            tables.pop(at)
            return True
        return False

    def add(u, w):
        if sit(leaf[u, w], d1, (s1 + d1 * t_leaf[u]) * p_root(w)):
            t_leaf[u] += 1
            t_root[0] += sit(root[w], d0, (s0 + d0 * t_root[0]) / (len(vocab) + 1))
            n_root[0] += 1
        n_leaf[u] += 1

    def remove(u, w):
        if leave(leaf[u, w]):
            t_leaf[u] -= 1
            t_root[0] -= leave(root[w])
            n_root[0] -= 1
        n_leaf[u] -= 1

    for u, w in pairs:
        add(u, w)
    sums, samples = Counter(), 0
    for k in range(sweeps):
        for u, w in pairs:
            remove(u, w)
            add(u, w)
        if k >= burn:
            samples += 1
            for pair in [(u, w) for u in ["<s>", *vocab] for w in vocab]:
                sums[pair] += p_leaf(*pair)
    return {pair: x / samples for pair, x in sums.items()}


def test_against_customers_that_leave_and_sit_down(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(15)]
    follow = {w: rng.sample(words, 4) for w in words}

    def text():
        out = [rng.choice(words)]
        while len(out) < 12:
            out.append(rng.choice(follow[out[-1]]) if rng.random() < 0.8 else rng.choice(words))
        return " ".join(out)

    texts = [text() for _ in range(90)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.score_texts(docs, F.col("doc_id") >= 70).collect()}
    p = by_customers([split(t) for t in texts[:70]], P.DISCOUNTS, P.STRENGTHS, 60, 20, 1)
    want = {k: sum(math.log10(p[u, w]) for u, w in zip(["<s>", *split(t)[:-1]], split(t), strict=True)) for k, t in enumerate(texts)}
    mine, theirs = (sum(x[k] for k in range(70, 90)) for x in ({k: r["score"] for k, r in got.items()}, want))
    assert abs(mine / theirs - 1) < 0.01
    assert all(abs(got[k]["score"] - want[k]) < 0.05 * abs(want[k]) for k in want)
    assert sum(got[k]["score"] for k in range(70, 90)) > sum(got[k]["base_score"] for k in range(70, 90))


def test_query_counts_exactly_and_beats_the_base_on_held_out_texts(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {k: split(t) for k, t in docs.items()}
    out = {k for k in docs if zlib.crc32(str(k).encode()) % 7 == 2}
    count = Counter(w for k, t in tokens.items() if k not in out for w in t)
    n, v = sum(count.values()), len(count)
    got = Q.op11_language_model(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        t = tokens[r["doc_id"]]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in out, len(t), sum(w in count for w in t), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / len(t)))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_a_hot_context_is_dealt_to_several_buckets(spark):
    """A third of all tokens follow one word; counts stay exact and the scores stay those of one bucket, but for sampling."""
    rng = random.Random(9)
    texts = [" ".join(x for _ in range(30) for x in ("the", f"n{rng.randrange(60)}")) for _ in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    held = F.col("doc_id") % 7 == 2
    many = {r["doc_id"]: r for r in P.score_texts(docs, held, bucket_bytes=400).collect()}
    few = {r["doc_id"]: r for r in P.score_texts(docs, held).collect()}
    for k, r in many.items():
        assert (r["n_known"], r["train_tokens"]) == (few[k]["n_known"], few[k]["train_tokens"])
        assert r["base_score"] == pytest.approx(few[k]["base_score"], rel=1e-9)
        assert r["score"] == pytest.approx(few[k]["score"], rel=0.04)


def test_edges(spark, docs_of):
    rows = docs_of([(1, None), (2, ""), (3, " \n"), (3, "a b"), (3, "A B"), (None, "a b a b"), (4, "word " * 50_000)]).withColumnRenamed("n_chars", "score")
    held = F.col("doc_id") == 2
    got = P.score_texts(rows, held).collect()
    assert len(got) == 7
    by = {(r["doc_id"], r["n_tokens"]): r for r in got}
    assert by[2, 1]["held_out"] and not by[None, 5]["held_out"]
    assert by[1, 1]["score"] == by[2, 1]["score"] == by[3, 1]["score"] and by[4, 50_001]["n_known"] == 50_001
    assert len({r["score"] for r in got if r["doc_id"] == 3 and r["n_tokens"] == 3}) == 1
    assert P.score_texts(rows.where("false"), held).collect() == []
    alone = P.score_texts(rows.where("doc_id = 2"), held).first()
    assert (alone["n_known"], alone["train_tokens"], alone["base_score"], alone["score"]) == (0, 0, 0.0, 0.0)
    assert [tuple(r) for r in P.score_texts(rows, held).orderBy("doc_id", "n_tokens").collect()] == sorted(map(tuple, got), key=lambda r: (r[0] or 0, r[2]))
