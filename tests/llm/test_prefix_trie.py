"""The prefix trie against a trie built node by node."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tramline.llm import prefix_trie as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def in_order(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v, key=lambda k: k[:2])] for c, v in convs.items()}


def rebuilt(rows, group=5, heads=9):
    convs = in_order(rows)
    h = {c: zlib.crc32(str(c).encode()) % heads for c in convs}
    return {c: convs.get(c - c % group, [])[: h[c]] + v[h[c] :] for c, v in convs.items()}


def trie_of(convs):
    members = {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def sums(node):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = [sums(k) for k in children.get(node, [])]
        return (sum(b[0] for b in below) or (not below)) * 1, own + sum(b[1] for b in below)

    out = []
    for node, who in members.items():
        leaves, saved = sums(node)
        ends = [c for c in who if len(convs[c]) == len(node)]
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children.get(node, [])), leaves, saved, sha(ends)))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(
        [(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, length int"
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def made(seed, n, words, most):
    """Conversations over few words, so that prefixes meet; ids with gaps."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randrange(1, most)):
            rows.append((c, 2 * t, "user" if t % 2 == 0 else "assistant", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 3)))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [T.BITS, 16])
def test_against_a_trie_built_node_by_node(spark, bits):
    rows = made(1, 60, ["a", "bé"], 7)
    assert rows_of(T.prefix_trie(table(spark, rows), bits)) == trie_of(in_order(rows))
    assert rows_of(T.rebuilt_trie(table(spark, rows), bits=bits)) == trie_of(rebuilt(rows))


def test_a_group_of_copies_and_a_common_first_turn(spark):
    rows = [(c, t, "user", f"x{t}") for c in range(0, 300, 5) for t in range(4)]
    rows += [(c, t, "user", f"x{t}" if t == 0 else f"own {c} {t}") for c in range(1, 300, 5) for t in range(3)]
    assert rows_of(T.prefix_trie(table(spark, rows))) == trie_of(in_order(rows))
    assert rows_of(T.rebuilt_trie(table(spark, rows))) == trie_of(rebuilt(rows))


def test_a_long_conversation_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(T, "_BLOCK", 8)
    rows = [(c, t, "user", f"turn {t}" if t < 150 or c == 0 else f"{c} {t}") for c in (0, 1, 7) for t in range(200)] + [(9, 0, None, None)]
    convs = in_order(rows)
    assert rows_of(T.prefix_trie(table(spark, rows))) == trie_of(convs)
    assert rows_of(T.rebuilt_trie(table(spark, rows))) == trie_of(rebuilt(rows))


def test_edges(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", ""), (1, 5, "user", "é" * 5000), (1, None, "user", "first"), (2, 0, "u", "ser x"), (3, 0, "us", "er x"),
        (None, 0, "user", "lost"), (4, 0, "", ""), (4, 1, "user", None), (11, 0, "user", "a"), (11, 1, "user", "b"),
    ]
    assert rows_of(T.prefix_trie(table(spark, rows))) == trie_of(in_order(rows))
    assert rows_of(T.rebuilt_trie(table(spark, rows))) == trie_of(rebuilt(rows))
    assert T.rebuilt_trie(table(spark, rows).where("false")).collect() == []
    # A conversation whose turns are all replaced, by one that isn't there, is a member of the root alone.
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    got = T.rebuilt_trie(table(spark, [(c, 0, "user", "x")])).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, sha([c]))]
    # Repeated rows are turns of their own.
    twice = [(5, 0, "user", "x"), (5, 0, "user", "x")]
    assert rows_of(T.prefix_trie(table(spark, twice))) == trie_of({5: [("user", "x")] * 2})


def test_only_possibly_shared_prefixes_are_grouped(spark):
    """Unshared conversations leave nothing for the exact grouping; the sketch never clears a shared prefix."""
    rows = [(c, t, "user", f"{c} {t}") for c in range(40) for t in range(5)] + [(c, 0, "user", "same") for c in range(100, 110)]
    got = T.screened(T.plain_paths(table(spark, rows)), T.BITS).where("depth > 0").collect()
    assert {r["conv"] for r in got if r["maybe"]} == set(range(100, 110))
