"""A training corpus in five stages; each stage's rows are written as Parquet and reread by the next one.

Part of subpackage ``tramline.llm``.  run(spark, sf_dir) applies the stages to ``documents``.  Every stage judges rows, not
doc_ids: a null or repeated doc_id neither drops a row nor brings one back, and is passed on as it is.  Stages take documents of
any length whole, an empty table, and other columns of any names; null and empty texts go in the language stage, since they
have no letter, and are kept by the others (a row without words is nobody's copy, is clean, and has the end id alone).

What a stage writes on the way lies in folders of its own (``shared.Scratch``): run deletes them once the stage's rows are
written; where stages are called one by one, a stage's folders go when its successor begins, whose input is then written.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import decontaminate, language_id, mixing, near_dedup, token_ids
from tramline.llm.queries import CAP, SEED, SHARE, WEIGHTS, WORD_BPE, WORD_BPE_IDS, table
from tramline.llm.shared import Scratch, new_path

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The last stage that this thread began, and its folders.
_LAST = threading.local()


def _after(previous: str | None) -> Callable[[Stage], Stage]:
    """A stage with folders of its own; those of the stage ``previous`` are deleted when it begins."""

    def with_scratch(stage: Stage) -> Stage:
        @wraps(stage)
        def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            name, scratch = getattr(_LAST, "began", (None, None))
            if scratch is not None and name == previous and scratch.spark is spark:
                scratch.delete()
            own = Scratch(spark)
            _LAST.began = (stage.__name__, own)
            with own:
                return stage(spark, docs, sf_dir)

        return begin

    return with_scratch


@_after(None)
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; without a letter, or with no language on four tenths of the words, they go."""
    return language_id.accepted(docs.select(_COLUMNS))


@_after("language")
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest doc_id (null last)."""
    return near_dedup.one_of_each_group(docs).select(_COLUMNS)


@_after("near_duplicates")
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontaminate.clean(docs.select(_COLUMNS), table(spark, sf_dir, "benchmark"))


@_after("decontamination")
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights of their sources; one that the mix repeats has a row for each copy."""
    return mixing.mixed_documents(docs, weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED).select(_COLUMNS)


@_after("mix")
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, written and read back: one row per document of the mix."""
    return token_ids.token_ids(docs, public_tokenizers.path(WORD_BPE), WORD_BPE_IDS, end_id=1).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontamination),
    ("mix", mix),
    ("token_ids", tokens),
]

#: Languages, mixing and token ids are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        _LAST.began[1].delete()
    return docs.select(*[F.col(c) for c in docs.columns])
