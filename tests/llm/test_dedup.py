from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tramline.llm import exact_dedup, near_dedup, substring_dedup
from tramline.llm import words as W
from tramline.llm.components import components

SPLIT = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(t):
    return SPLIT.findall(t or "")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\nÉ \x1cz", max_size=30), min_size=1, max_size=6))
def test_word_splitting(texts):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, lens, before = W.split(data, off)
    got = [[bytes(data[starts[k] : starts[k] + lens[k]]).decode() for k in range(before[i], before[i + 1])] for i in range(len(texts))]
    assert got == [words_of(t) for t in texts]
    h = W.hashes(data, starts, lens, 5)
    flat = [w for ws in got for w in ws]
    assert len(set(h.tolist())) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_grams_and_minima():
    h = np.arange(50, dtype=np.uint64)
    for n in (1, 2, 5, 8, 35):
        g = W.grams(h, n)
        assert len(g) == 50 - n + 1 and len(set(g.tolist())) == len(g)
        assert W.grams(h[3:], n)[0] == g[3]
    x = np.random.default_rng(0).integers(0, 99, 60).astype(np.uint64)
    assert W.sliding_min(x, 28).tolist() == [int(x[i : i + 28].min()) for i in range(33)]


def near_brute(texts):
    sets = []
    for t in texts:
        w = words_of((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def varied(rng, base, k):
    w = list(base)
    for i in rng.choice(len(w), k, replace=False):
        w[i] = f"n{rng.integers(1 << 30)}"
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 20)
    rng = np.random.default_rng(4)
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d e", "A b  c d e", "É f", "é f"]
    for g in range(6):
        base = [f"w{g}_{i}" for i in range(120)]
        texts += [varied(rng, base, int(k)) for k in rng.integers(0, 9, 12)] + [" ".join(base).upper()] * 3
    base = [f"hub_{i}" for i in range(100)]
    texts += [varied(rng, base, int(k)) for k in rng.integers(0, 6, 60)]
    texts += [" ".join([f"u{i}_{k}" for k in range(60)] + base[:40]) for i in range(20)]
    got = sorted(map(tuple, near_dedup.near_duplicates(docs_of(texts).repartition(5)).collect()))
    assert got == near_brute(texts)
    kept = near_dedup.one_of_each_group(docs_of(texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in near_brute(texts) if r[3]] and "kept" in kept.columns


def test_near_duplicates_edges(spark, docs_of):
    docs = docs_of([(None, "a b c"), (3, "a b c"), (3, "a b c"), (5, "x")])
    got = sorted(map(tuple, near_dedup.near_duplicates(docs).collect()), key=str)
    assert sorted((r[0] is None, r[2]) for r in got if r[0] != 5) == [(False, 3), (False, 3), (True, 3)] or (None, 1, None, True) in got
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (800, 100, 100))
    sh, row = np.concatenate([common, a, common, b, common[:3]]), np.repeat([0, 1, 2], [900, 900, 3])
    s = near_dedup.sketches(sh, row, 4)
    assert (s[:3] != near_dedup._EMPTY).all() and (s[3] == near_dedup._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (203, 201), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == 0 and got[203] == got[201] == got[200] == 200
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def exact_brute(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i, k))
    out = []
    for norm, own in groups.items():
        best = min(own)
        out += [(i, best[2], len(own), k == best[3], hashlib.sha256(norm.encode()).hexdigest()) for _, _, i, k in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("collide", ["no", "some", "too many"])
def test_exact_duplicates(spark, docs_of, monkeypatch, collide):
    if collide != "no":  # what happens when an identifier stands for several contents
        full = exact_dedup.named
        monkeypatch.setattr(exact_dedup, "named", lambda c: full(c).withField("id", F.length(c).cast("long")))
        monkeypatch.setattr(exact_dedup, "MOST_COLLIDING", 100 if collide == "some" else 0)
    long = "lorem ipsum dolor sit amet " * 700
    rows = [(0, "ab c"), (1, "a bc"), (2, "abc "), (3, "a b c"), (4, None), (5, ""), (6, " \n"), (7, long), (8, long.replace(" ", "\n")), (9, long[:-2]), (10, "É"), (11, "e"), (12, "abd")]
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs_of(rows).repartition(4)).collect()), key=str)
    assert got == exact_brute(rows)


def test_exact_duplicates_edges(spark, docs_of):
    docs = docs_of([(1, "a"), (1, "a"), (None, "a"), (2, "b")])
    got = [tuple(r)[:4] for r in exact_dedup.exact_dedup(docs).collect()]
    assert sum(r[3] for r in got) == 2 and {r[1] for r in got if r[2] == 3} == {1}
    assert exact_dedup.exact_dedup(docs.where("false")).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicated(docs_of([(1, "a"), (2, "a "), (3, "b")])).collect()) == [2, 3]


def test_chunks_are_the_text(spark):
    rng = np.random.default_rng(2)
    random_text = lambda alphabet, n=8000: "".join(rng.choice(alphabet, n))
    han, digits = [chr(c) for c in range(0x4E00, 0x9FA0)], list("0123456789")
    cut_anywhere = [random_text(han), random_text(digits), random_text([chr(c) for c in range(0x430, 0x450)]), random_text(list("etaoinshrdlu"))]
    texts = ["", "x" * 9000, "the quick brown fox " * 900, "é" * 300, *cut_anywhere]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact_dedup.chunks(F.col("t")).alias("c"))
    for r in d.collect():
        assert "".join(r["c"]).encode("latin-1").decode() == r["t"] and all(len(c) <= exact_dedup.MAX_CHUNK + 2 for c in r["c"])
        if r["t"] in cut_anywhere:  # the content decides in every script, and a shift is caught up with
            assert max(map(len, r["c"])) < 1200
            shifted = spark.createDataFrame([("1" * 7 + r["t"],)], "t string").select(exact_dedup.chunks(F.col("t"))).first()[0]
            assert len(set(shifted) & set(r["c"])) > 0.5 * len(r["c"])


def repeats_brute(texts, n):
    docs = [words_of(t) for t in texts]
    seen = Counter(tuple(w[k : k + n]) for w in docs for k in range(len(w) - n + 1))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), kept))
    return out


@pytest.mark.parametrize("bits", [16, 26])
def test_repeated_passages(spark, docs_of, bits):
    rng = np.random.default_rng(9)
    fresh = lambda n: [f"f{rng.integers(1 << 40)}" for _ in range(n)]
    passage, line = fresh(50), fresh(35)
    texts = [None, "", "same " * 36, "same " * 35, "other " * 34, " ".join(line), " ".join(line[:34])]
    texts += [" ".join(fresh(30) + passage + fresh(40)) for _ in range(5)] + [" ".join(fresh(20) + line[:-1] + fresh(5))]
    texts += [" ".join(fresh(60))] * 3 + [" ".join(fresh(10) + line + fresh(10)), " ".join(passage[:36] + fresh(9) + passage[:36])]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs_of(texts).repartition(6), 35, bits).collect()}
    for i, (n, gone, kept) in enumerate(repeats_brute(texts, 35)):
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (n, gone, kept), i
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_repeated_passages_edges(spark, docs_of):
    docs = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x b c d e y"), (2, "z")])
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.remove_repeats(docs, 4).collect())
    assert got == [("1", 6), ("1", 6), ("2", 0), ("None", 4)]
    assert substring_dedup.remove_repeats(docs.where("false"), 4).count() == 0
