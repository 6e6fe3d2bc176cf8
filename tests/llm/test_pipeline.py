from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from oracle import SF
from pyspark.sql import functions as F

from tramline.llm import decontaminate, mixing, near_dedup
from tramline.llm import queries as Q


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs = spark.read.parquet(str(tmp_path / name))
    n = {k: d.count() for k, d in seen.items()}
    assert n["language_id"] >= n["near_dedup"] >= n["decontaminate"] and n["mix"] == n["token_ids"]
    # No two documents that stay are near duplicates, none is contaminated, and the mix has what its operator says.
    assert near_dedup.near_duplicates(seen["near_dedup"]).where("not kept").count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.decontaminate(seen["decontaminate"], bench).where("contaminated").count() == 0
    plan = mixing.mix(seen["decontaminate"], Q.WEIGHTS, Q.SHARE, Q.CAP, Q.SEED)
    copies = {r["doc_id"]: r["n"] for r in seen["mix"].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert copies == {r["doc_id"]: len(r["draws"]) for r in plan.collect() if r["draws"]}
    t = seen["token_ids"].orderBy("start").collect()
    assert [r["start"] for r in t][1:] == [r["start"] + r["n_tokens"] for r in t][:-1]


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "token_ids"]


def survivors_brute(rows, item):
    """(doc_id, text) of the rows with a letter, one of each near-duplicate group (least doc_id, null last), without the item."""
    rows = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for g, (d, t) in zip(group, rows, strict=True):
        first[g] = min(first.get(g, (d, t)), (d, t), key=lambda r: (r[0] is None, r[0] or 0))
    kept = list(first.values())
    return rows, kept, [(d, t) for d, t in kept if item not in t]


def test_run_with_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(4)
    english = "the cat and dog were here with some more of this when they had been there before".split()
    french = "le chat et chien sont avec une grande maison dans cette ville quand ils avaient été".split()
    text = lambda own, n=30: " ".join(rng.choice(own) for _ in range(n))
    item = text(english, 13)
    docs = [(i, text(english if i % 2 else french), "en" if i % 2 else "fr") for i in range(60)]
    docs += [(None, text(english), "en"), (None, text(french), "fr"), (None, "12 34 !", None), (None, None, None), (None, docs[1][1], "en")]
    docs += [(70, text(english), "en"), (70, "99 ?", None), (70, text(english, 5) + " " + item, "en"), (70, text(french), "fr")]
    docs += [(80, x := text(english), "en"), (80, x, "en"), (80, item, "en"), (None, y := text(french), "fr"), (None, y + " la", "fr")]
    sf = str(tmp_path)
    spark.createDataFrame([(d, t, a, "s", len(t or "")) for d, t, a in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    *want, clean = survivors_brute([(d, t) for d, t, _ in docs], item)
    at, got = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, at, sf).write.parquet(f"{sf}/{name}")
        at = spark.read.parquet(f"{sf}/{name}")
        got.append([(r["doc_id"], r["text"]) for r in at.collect()])
    plain = lambda rows: Counter((d, t.removesuffix(" la")) for d, t in rows)  # noqa: E731  # of two null ids either may stay
    assert Counter(got[0]) == Counter(want[0]) and plain(got[1]) == plain(want[1]) and plain(got[2]) == plain(clean)
    # One source: every row once or twice, and 1.5 times the words within one document.
    copies, size = Counter(got[3]), {r: len(r[1].split()) for r in got[2]}
    assert set(copies) == set(got[2]) and set(copies.values()) <= {1, 2}
    assert abs(sum(n * size[r] for r, n in copies.items()) - 1.5 * sum(size.values())) < max(size.values())
    last = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect())
    ids = Counter(d for d, _ in got[2])
    assert set(last) == set(ids) and all(n <= last[d] <= 2 * n for d, n in ids.items())
