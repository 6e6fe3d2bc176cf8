"""Catchers of periodic runs against the definition."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF

from tramline.llm import periodic_runs as P
from tramline.llm import queries as Q


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if w[p:] == w[: len(w) - p])


def runs_by_definition(w):
    """Maximal stretches of every period, kept where that is their smallest one and they are long enough."""
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p) and smallest_period(w[i : j + p]) == p:
                out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def answer(words):
    runs = runs_by_definition(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def found(words):
    """Through the catchers, as the operator calls them."""
    text = " ".join(words).encode()
    data = np.frombuffer(text, np.uint8)
    *_, row, start, length, period = P._span_runs(data, np.array([0, len(data)]))
    assert not row.any()
    return list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_runs_are_those_of_the_definition(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert found(words) == runs_by_definition(words)


@pytest.mark.parametrize("period", [1, 2, 3, 5, 64, 65, 127, 128, 200, 700])
@pytest.mark.parametrize("lead", [0, 1, 63, 130])
def test_long_periods_at_any_place(period, lead):
    rng = random.Random(period * 1000 + lead)
    unit = [f"w{rng.randrange(10**9)}" for _ in range(period)]
    words = [f"x{k}" for k in range(lead)] + (unit * 8)[: max(6, 4 * period + rng.randrange(4))] + ["y", *unit[: period // 2], "z"]
    assert found(words) == runs_by_definition(words)


def test_query_equals_brute_force_on_a_whole_table(spark):
    got = Q.op12_periodic_runs(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    split = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]
    small = {d["doc_id"]: planted(d["doc_id"], split(d["text"])) for d in docs if len(split(d["text"])) < 1500}
    assert len(small) > 150
    for r in got:
        if r["doc_id"] in small:
            assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) == answer(small[r["doc_id"]])


def test_edges(spark, docs_of):
    none = (0, None, None, None, None)
    texts = [None, "", " \t\n", "a " * 5, "a " * 6, "b " + "a b " * 4, ("x y z " * 5).strip(), "q " * 70_000, "a a a a a a b " * 4]
    rows = docs_of([*enumerate(texts), (None, "u v " * 4), (4, "a " * 6)]).withColumnRenamed("n_chars", "length")
    got = P.periodic_runs(rows).collect()
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    assert len(got) == 11 and sum(r["doc_id"] == 4 for r in got) == 2
    for key in ((0, 0), (1, 0), (2, 0), (3, 5)):
        assert (by[key]["n_runs"], *[by[key][c] for c in ("start", "length", "period", "exponent_milli")]) == none
    assert by[3, 5]["collapsed"] == "a a a a a" and by[0, 0]["collapsed"] == ""
    assert by[4, 6]["runs"] == "0,6,1\n" and by[4, 6]["collapsed"] == "a"
    assert by[5, 9]["runs"] == "0,9,2\n" and by[5, 9]["collapsed"] == "b a"
    assert by[6, 15]["collapsed"] == "x y z" and by[6, 15]["exponent_milli"] == 5000
    assert by[7, 70_000]["runs"] == "0,70000,1\n" and by[7, 70_000]["collapsed"] == "q"
    assert by[8, 28]["n_runs"] == 5 and by[8, 28]["start"] == 0 and by[8, 28]["period"] == 1
    assert by[None, 8]["runs"] == "0,8,2\n"
    assert P.periodic_runs(rows.where("false")).collect() == []
