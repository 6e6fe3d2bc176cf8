"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A normalised text is cut where its own bytes say so, in any script, so equal stretches give equal chunks.  Each chunk has a
64-bit identifier and a check of 60 bits of its SHA-256; a text is the ordered list of its chunks' identifiers (its recipe).
The text is cut once.  One exchange merges equal chunks and verifies that every identifier has one check; those that stand
for two contents are named by their checks as well.  Only identifiers are compared and moved, never a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import set_aside, written

#: A chunk ends after MIN bytes at the next anchor; a stretch of MAX bytes without one (a run of one sign, say) ends there.
MIN_CHUNK, MAX_CHUNK = 256, 4096
#: More colliding identifiers than this are not looked up one by one: then every chunk is named by its check too.
MOST_COLLIDING = 100_000
_SPACES = r"[\x20\x09-\x0D]+"


def _bytes_like(*residues: int) -> str:
    """A character class of all bytes with these remainders modulo 8."""
    return "[" + "".join(f"\\x{b:02X}" for b in range(256) if b % 8 in residues) + "]"


#: About one position in twenty in letters, digits and the UTF-8 bytes of other scripts alike.
_ANCHOR = _bytes_like(5) + _bytes_like(0, 1)
_CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?{_ANCHOR}|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    """The text without space and 0x09-0x0D; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, "")


def chunks(norm: Column) -> Column:
    """The text's UTF-8 bytes, as characters 0 to 255, cut into content-defined chunks, in order; together they are the whole."""
    return F.regexp_extract_all(F.decode(F.encode(norm, "UTF-8"), "ISO-8859-1"), F.lit(_CHUNK), F.lit(0))


def named(chunk: Column) -> Column:
    """Identifier and check of a chunk."""
    return F.struct(F.xxhash64(chunk).alias("id"), F.conv(F.substring(F.sha2(chunk, 256), 1, 15), 16, 10).cast("long").alias("check"))


def colliding(rows: DataFrame) -> list[int] | None:
    """Identifiers in ``rows`` (parts) that stand for several contents; None if there are more than MOST_COLLIDING.

    Chunks are merged before they move, so a chunk that many texts have costs a row for each task.
    """
    merged = rows.select(F.explode("parts").alias("p")).groupBy("p.id").agg(F.min("p.check").alias("a"), F.max("p.check").alias("b"))
    found = merged.where("a != b").select("id").limit(MOST_COLLIDING + 1).collect()
    return [r["id"] for r in found] if len(found) <= MOST_COLLIDING else None


def recipe(parts: Column, unsure: list[int] | None) -> Column:
    """The identifiers of a text's chunks, and behind them the checks of those that could stand for another content too."""
    ids, checks = F.transform(parts, lambda p: p["id"]), lambda some: F.transform(some, lambda p: p["check"])
    if unsure is None:
        return F.concat(ids, checks(parts))
    if not unsure:
        return ids
    doubted = F.array(*[F.lit(i).cast("long") for i in unsure])
    return F.concat(ids, checks(F.filter(parts, lambda p: F.array_contains(doubted, p["id"]))))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Of equal normalised texts the row with the most code points in its original text stays, then the smallest doc_id (a
    null doc_id comes last).  Null and empty texts form one group.  Rows that repeat a doc_id and text count as copies, and
    one row of them is kept (the others carry kept = false).  An empty table gives no rows; other columns are ignored.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("norm", normalised(F.col("text")))
    cut = written(
        texts.select(
            "doc_id",
            F.length("text").alias("chars"),
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(chunks(F.col("norm")), named).alias("parts"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "recipes",
    )
    rows = cut.withColumn("recipe", recipe(F.col("parts"), colliding(cut))).drop("parts")
    best = F.struct(F.col("chars"), F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("minus"), (-F.col("row")).alias("first"))
    groups = rows.groupBy("recipe").agg(F.max(best).alias("best"), F.count("*").alias("group_size"))
    # Only groups of two rows or more are joined back; written first, so that Spark can split the copies of a hot one.
    groups = written(
        groups.where("group_size > 1").select(
            "recipe", "group_size", (-F.col("best.minus")).alias("keep_id"), (-F.col("best.first")).alias("keep_row")
        ),
        "groups",
    )
    alone = F.col("group_size").isNull()
    return rows.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each group of equal normalised texts, chosen as in ``exact_dedup``.

    Rows are told apart by a key of their own, written once: of repeated rows one stays, and rows with a null doc_id or one
    that other texts have too are judged by their text.  Columns may have any names.
    """
    own, back = set_aside(docs, "doc_id", "text")
    keyed = written(own.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = exact_dedup(keyed.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), F.col("keep_id").alias("_group"))
    chars = F.length(F.coalesce("text", F.lit("")))
    first = F.min(F.struct((-chars).alias("chars"), F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))["_row"]
    stay = keyed.select("_row", "doc_id", "text").join(groups, "_row").groupBy("_group").agg(first.alias("_row")).select("_row")
    return back(keyed.join(stay, "_row", "left_semi"))
