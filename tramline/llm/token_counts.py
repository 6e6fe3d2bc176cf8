"""Token counts: an exact histogram of encoded lengths, and suffix sums that answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, column_of
from .tokenizing import byte_pair_lengths


def encoded_lengths(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(source, n_tokens) of every whole text; null text: 0 tokens.  Scan only, no exchange."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = byte_pair_lengths(ranks, pattern, column_of(b, "text"))
            yield pa.record_batch([column_of(b, "source"), pa.array(n, pa.int64())], names=["source", "n_tokens"])

    return arrow_map(docs.select("source", F.coalesce("text", F.lit("")).alias("text")), count, "source string, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Per source (null: its own row group) and encoded length: docs and tokens, and suffix sums over longer documents.

    docs_from, tokens_from: documents of at least this length and their tokens.  rank_to: documents of at most this
    length, so that a quantile q is the least length with rank_to >= q * docs_total.  kept_at_limit: tokens that remain
    if every document is cut at this length.  Windows run over distinct lengths, which the longest document bounds, not
    over documents.  An empty table gives no rows; repeated rows count each time.
    """
    hist = lengths.groupBy("source", "n_tokens").agg(F.count("*").alias("docs"))
    hist = hist.withColumn("tokens", F.col("docs") * F.col("n_tokens"))
    down = Window.partitionBy("source").orderBy(F.col("n_tokens").desc())
    longer = down.rowsBetween(Window.unboundedPreceding, -1)
    return (
        hist.withColumn("docs_from", F.sum("docs").over(down))
        .withColumn("tokens_from", F.sum("tokens").over(down))
        .withColumn("docs_longer", F.coalesce(F.sum("docs").over(longer), F.lit(0)))
        .withColumn("docs_total", F.sum("docs").over(Window.partitionBy("source")))
        .withColumn("tokens_total", F.sum("tokens").over(Window.partitionBy("source")))
        .withColumn("rank_to", F.col("docs_total") - F.col("docs_longer"))
        .withColumn(
            "kept_at_limit",
            F.col("tokens_total") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens"),
        )
        .drop("docs_longer")
    )


def token_counts(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    return length_histogram(encoded_lengths(docs, ranks, pattern))


def answer_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Per source, the tokens kept (kept_<limit>) and documents cut (cut_<limit>) at each context limit, from the histogram alone."""
    at = [(F.when(F.col("n_tokens") > k, F.lit(k)).otherwise(F.col("n_tokens")) * F.col("docs"), k) for k in limits]
    kept = [F.sum(x).alias(f"kept_{k}") for x, k in at]
    cut = [F.sum(F.when(F.col("n_tokens") > k, F.col("docs")).otherwise(0)).alias(f"cut_{k}") for k in limits]
    return histogram.groupBy("source").agg(*kept, *cut)
