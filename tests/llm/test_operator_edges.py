"""Edge cases of several operators: own folders, untellable labels, long rows, repeated ids, clashing columns."""

from __future__ import annotations

import corpus_pipeline
import pytest
from oracle import SF
from pyspark.sql import functions as F

from tramline.llm import decontaminate, exact_dedup, language_id, mixing, near_dedup, toxicity
from tramline.llm.shared import Scratch, written


def test_results_live_on_across_a_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [exact_dedup.exact_dedup(docs), near_dedup.near_duplicates(docs)]
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    first.write.parquet(str(tmp_path / "one"))
    corpus_pipeline.STAGES[1][1](spark, spark.read.parquet(str(tmp_path / "one")), SF).write.parquet(str(tmp_path / "two"))
    assert all(r.count() == docs.count() for r in held)


def test_a_scratch_deletes_its_own_folders_only(spark):
    outer, inner = Scratch(spark), Scratch(spark)
    alone = written(spark.range(3), "alone")
    with outer:
        a = written(spark.range(4), "a")
        with inner:
            b = written(spark.range(5), "b")
        c = written(spark.range(6), "c")
    inner.delete()
    assert (alone.count(), a.count(), c.count()) == (3, 4, 6) and len(outer.paths) == 2
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        b.count()
    outer.delete()
    assert alone.count() == 3


def labels_of(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, toxic int")


def test_labels_that_no_word_tells_apart_give_their_share(spark, docs_of):
    texts = ["rotten banana"] * 20 + ["rotten", "banana"] * 90
    docs = docs_of(texts)
    got = toxicity.toxicity(docs, labels_of(spark, [(i, int(i < 20)) for i in range(200)])).collect()
    assert len(got) == 200 and {r["predicted"] for r in got} == {0}
    assert all(0.05 < r["score"] < 0.15 for r in got)
    # Two rows of one word with either label: half of the labels are toxic, and nothing is known beyond that.
    two = toxicity.toxicity(docs_of([(1, "same"), (3, "same"), (5, "other")]), labels_of(spark, [(1, 1), (3, 0)])).collect()
    assert {round(r["score"], 6) for r in two} == {0.5}


@pytest.mark.parametrize("clean", ["", None])
def test_toxic_words_beside_empty_clean_texts(spark, docs_of, clean):
    docs = docs_of([(1, "you blorgface"), (3, clean), (5, clean), (7, clean)])
    got = toxicity.toxicity(docs, labels_of(spark, [(1, 1), (3, 0), (5, 0), (7, 0)])).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] != 1} == {0.0}


def test_a_repeated_labelled_doc_id_trains_on_one_defined_text(spark, docs_of):
    docs = docs_of([(1, "b text"), (1, "a text"), (3, "clean words")])
    texts, y, rate = toxicity.training_sample(docs, labels_of(spark, [(1, 1), (3, 0)]))
    assert texts == [b"a text \n", b"clean words \n"] and y.tolist() == [1, 0] and rate == 0.5


def test_a_language_of_long_rows_is_learned(spark, docs_of):
    long = "la hundo kuras kaj la kato dormas sur la tablo . " * 400
    short = "der hund und die katze sind hier . " * 3
    assert len(long) > language_id.MOST_BYTES
    docs = docs_of([long] * 12 + [short] * 40, lang=["eo"] * 12 + ["de"] * 40)
    texts, learned = language_id.training_sample(docs)
    assert set(learned) == {"eo", "de"} and max(map(len, texts)) <= language_id.MOST_BYTES
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert all(got[i] == "eo" for i in range(12)) and all(got[i] == "de" for i in range(12, 52))


def test_repeated_doc_ids_share_a_component(spark, docs_of):
    rows = [(3, "a b c d e f"), (5, "a b c d e f"), (5, "z y x w v u t"), (7, "z y x w v u t"), (9, "m n o p q r"), (5, None), (9, "m n o p q r")]
    got = near_dedup.near_duplicates(docs_of(rows)).collect()
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in got}
    assert by == {(3, 2): (3, True), (5, 2): (3, False), (5, 3): (3, False), (7, 3): (3, False), (9, 2): (9, True), (5, 0): (5, True)}
    # Two texts under one smallest id are one document too.
    got = near_dedup.near_duplicates(docs_of([(1, "a b c d e f"), (1, "z y x w v u t"), (2, "a b c d e f"), (4, "z y x w v u t")])).collect()
    assert {r["component_id"] for r in got} == {1}


def test_deduplicated_keeps_one_row_of_each_text(spark, docs_of):
    rows = docs_of([(1, "x"), (1, "x"), (1, "y"), (None, "z"), (None, "z"), (None, "w"), (4, " y"), (5, None), (6, "")])
    got = exact_dedup.deduplicated(rows)
    assert got.columns == rows.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == [(0, "w"), (0, "z"), (1, "x"), (4, " y"), (5, "")]
    assert exact_dedup.deduplicated(rows.where("false")).collect() == []


def test_columns_may_have_the_names_of_results(spark, docs_of):
    docs = docs_of([(k, t) for k, t in enumerate(["the cat sat here", "der hund war da", None, ""] * 6)], lang=["en", "de", None, "en"] * 6)
    for name in ("lang_pred", "score", "n_words", "items", "spans", "contaminated", "shard", "place", "draws", "size", "_row", "copy", "block"):
        docs = docs.withColumn(name, F.lit(7))
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == 12 and {r["score"] for r in kept.collect()} == {7}
    bench = spark.createDataFrame([("i", "der hund war da")], "item_id string, text string")
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == 18 and {r["items"] for r in clean.collect()} == {7}
    mixed = mixing.mixed_documents(docs, weights=[1], share=1.0, cap=1.0, seed=1)
    assert mixed.columns == [c for c in docs.columns if c not in ("shard", "place")] + ["shard", "place"]
    assert mixed.where("size = 7 and _row = 7").count() == mixed.count() > 0


def test_null_ids_fall_into_different_blocks(spark, docs_of):
    rows = docs_of([(None, f"text number {k} " * 30) for k in range(60)])
    sized = rows.select(mixing.hashed(1, "doc", F.coalesce(F.col("doc_id").cast("string"), F.md5("text"))).alias("h"))
    assert sized.distinct().count() == 60
    got = mixing.mix(rows, [1], 1.0, 1.0, 1).collect()
    assert len(got) == 60 and sum(r["taken"] for r in got) == sum(r["size"] for r in got)
