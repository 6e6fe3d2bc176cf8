from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import decontaminate, mixing


@pytest.mark.parametrize("good, total, drawn", [(5, 12, 4), (40, 100, 50), (1, 1, 1), (0, 9, 4), (7, 7, 3), (300, 2000, 900)])
def test_hypergeometric_is_exact(spark, good, total, drawn):
    p = {k: math.comb(good, k) * math.comb(total - good, drawn - k) / math.comb(total, drawn) for k in range(max(0, drawn + good - total), min(good, drawn) + 1)}
    cdf = np.cumsum(list(p.values()))
    us = [0.001, 0.2, 0.5, 0.77, 0.999]
    d = spark.createDataFrame([(good, total, drawn, u) for u in us], "g long, t long, n long, u double")
    got = [r[0] for r in d.select(mixing.hypergeometric(F.col("g"), F.col("t"), F.col("n"), F.col("u")).alias("x")).collect()]
    want = [list(p)[int(np.searchsorted(cdf, u, side="left"))] for u in us]
    assert got == want


@pytest.mark.parametrize("shards", [1, 2, 3, 7, 16])
def test_tree_keeps_quotas(spark, shards):
    q = {"a": 50, "b": 7, "c": 0, None: 21}
    tree = mixing.splitting_tree(spark.createDataFrame(list(q.items()), "source string, quota long"), shards, 5).collect()
    assert Counter({s: sum(r["quota"] for r in tree if r["source"] == s) for s in q}) == Counter(q)
    per = Counter()
    for r in tree:
        assert r["quota"] >= 0
        per[r["shard"]] += r["quota"]
    assert set(per) == set(range(shards)) and max(per.values()) - min(per.values()) <= math.ceil(math.log2(max(2, shards)))


def targets_brute(sizes, weights, share, cap):
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    goal, left, out = share * sum(sizes.values()), set(order), {}
    while left:
        rate = (goal - sum(out.values())) / sum(w[s] for s in left)
        over = {s for s in left if rate * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: rate * w[s] for s in left}
        out |= {s: cap * sizes[s] for s in over}
        left -= over
    return out


def test_mix_meets_targets(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 500)
    rng = np.random.default_rng(3)
    texts, source = [], []
    for s, n in (("a", 300), ("b", 20), ("é", 90), (None, 60), ("Z", 150)):
        texts += ["w " * int(k) for k in rng.integers(0, 90, n)]
        source += [s] * n
    docs = docs_of([*texts, None], source=[*source, "empty"])
    rows = mixing.mix(docs.repartition(7), [3, 1, 2], shards=5).collect()
    sizes = {s: sum(len(t.split()) for t, x in zip(texts, source, strict=True) if x == s) for s in {*source}} | {"empty": 0}
    want = targets_brute(sizes, [3, 1, 2], 1.5, 2.0)
    by_doc = dict(zip(range(len(texts) + 1), [*source, "empty"], strict=True))
    taken = Counter()
    assert len(rows) == len(texts) + 1
    for r in rows:
        s = by_doc[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], abs=1e-5)
        assert r["taken"] == r["size"] * len(r["draws"]) <= 2 * r["size"] and all(0 <= d < 5 for d in r["draws"])
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 45
    again = mixing.mix(docs.repartition(2), [3, 1, 2], shards=5).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixed_rows_and_edges(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, "c"), (2, "c d e"), (None, "x"), (3, None)], source=["p", "p", "q", None, None])
    out = mixing.mixed_documents(docs_of(["a b", "c d", "e"], source=["p", "q", None]), weights=[1], share=2.0, cap=2.0, shards=2)
    assert out.count() == 6 and {"shard", "place", "kept"} <= set(out.columns)
    assert mixing.mix(docs, [3, 1, 2]).count() == 5
    assert mixing.mix(docs.where("false"), [3, 1, 2]).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated_brute(texts, items):
    low = {c: c + 32 for c in range(65, 91)}
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(low))
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    out = []
    for d, t in enumerate(texts):
        w = WORD.findall((t or "").translate(low))
        hit, found = set(), set()
        for x, own in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [400_000, 15])
def test_contamination(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    item = " ".join(f"q{i}" for i in range(20))
    items = [(1, item), (12, "Short one!"), (3, None), (4, "..."), (5, "Ünï code é"), (6, item), (7, "a a a")]
    texts = [None, "", "...", f"x {item.upper()} y", "short ONE", "short one two", f"{item[:30]}", "a " * 9, "ünï-code, é", "Ünï-code, é; shortone", "z " * 500 + item, "q0 q1", "one short one"]
    texts.append(" ".join(f"Q{i}," for i in range(3, 17)))
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.decontaminate(docs_of(texts), b).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows] == contaminated_brute(texts, items)
    assert [texts[r["doc_id"]][a:e] for r in rows if r["doc_id"] == 3 for a, e in r["spans"][:1]] == [item.upper()]
    assert [texts[8][a:e] for a, e in rows[8]["spans"][:1]] == ["ünï-code, é"] or rows[8]["n_hit"] == 0


def test_contamination_edges(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs_of(["a b"]), none).first()["n_hit"] == 0
    assert decontaminate.decontaminate(docs_of(["a"]).where("false"), none).count() == 0


@pytest.mark.parametrize("block", [400_000, 15])
def test_contamination_of_rows_without_own_id(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    item, other = (" ".join(f"{c}{i}" for i in range(20)) for c in "qr")
    clean, hit, both = " ".join(f"c{i}" for i in range(20)), item, " ".join([*item.split()[:13], *["c"] * 7])
    texts = [(None, clean), (None, hit), (None, other), (7, clean), (7, hit), (7, both), (7, hit), (None, None), (None, "")]
    items = [(1, item), (1, item), (2, other), (3, "a b c")]
    got = decontaminate.decontaminate(docs_of(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(d, *r[1:]) for (d, _), r in zip(texts, contaminated_brute([t for _, t in texts], items), strict=True)]
    assert Counter(map(str, want)) == Counter(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"])) for r in got)
