"""Mixing sources to target weights, in DataFrame operations only.

1. Sizes per source; targets by weight, stopped at a cap, the excess reshared (water filling).
2. Documents fall into blocks by a hash; only block totals are planned with, and their number is bounded by the block size.
3. A source's blocks are permuted by hash; each is drawn once for every full pass, and a prefix of them once more, so that the
   drawn words meet the target.  The block at the end of the prefix is cut between two documents.
4. A splitting tree deals the sources' block quotas to output shards: at every node the left half gets a multivariate
   hypergeometric share of the quotas, drawn by inversion from a hash of (seed, node, source).
5. A source's draws go to the shards in permuted order by these exact quotas, so shards are disjoint.  A document is taken as
   often as shards drew it, and inside a shard the documents are shuffled by the order of a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import set_aside, shuffle_width, written

_WORD = r"[^\x20\x09-\x0D]+"
#: A source's blocks have about this many words, and all sources together at most about MOST_BLOCKS blocks.
BLOCK_WORDS, MOST_BLOCKS = 20_000, 65_536
#: Tables of one row per source are broadcast up to so many sources (under 20 MB).
MOST_SOURCES = 100_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def hashed(*parts) -> Column:
    """A number in 0 .. 2**32 - 1 from md5 of the parts; the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """(source, source_size, target): sources in code point order, null last, take the weights in turn.

    Targets share ``share`` times all sizes by weight; a target stops at ``cap`` times its source's size, and what it
    leaves is reshared by weight until none is above.  Sorted by cap / weight, the stopped sources are a prefix, so one
    running sum finds the level.  The windows run over one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = per_source.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    t = t.withColumn("goal", F.lit(share) * F.sum("source_size").over(everything))
    level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("rate", (F.col("goal") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    open_rate = F.max("rate").over(everything)  # the rate rises up to the first source that isn't stopped, and falls after it
    return t.select(
        "source", "source_size",
        F.least(F.col("most"), F.coalesce(F.round(open_rate * F.col("weight"), 6), F.col("most"))).alias("target"),
    )


def _ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, stepped back; relative error under 1e-13."""
    x = n + F.lit(9.0)
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    back = n + F.lit(1.0)
    for k in range(2, 9):
        back = back * (n + F.lit(float(k)))
    return series - F.log(back)


def hypergeometric(good: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``good`` ones: the quantile at u, exact, by inversion."""
    low, high = F.greatest(F.lit(0).cast("long"), drawn + good - total), F.least(good, drawn)
    start = F.struct(F.lit(0.0).alias("sum"), low.alias("x"))

    def summed(*counts: Column) -> Column:
        return F.aggregate(F.array(*counts), F.lit(0.0), lambda acc, n: acc + _ln_factorial(n))

    def step(acc: Column, k: Column) -> Column:
        ways = summed(good, total - good, drawn, total - drawn)
        p = F.exp(ways - summed(total, k, good - k, drawn - k, total - good - drawn + k))
        return F.struct((acc["sum"] + p).alias("sum"), F.when(acc["sum"] < u, k).otherwise(acc["x"]).alias("x"))

    return F.when(low >= high, low).otherwise(F.aggregate(F.sequence(low, high), start, step)["x"])


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, quota) from (source, quota): quotas are whole numbers and stay exact at every node.

    Level by level, a node with m shards passes a share to its left half of m // 2; the shares of the sources are drawn one
    after another, which together is a multivariate hypergeometric draw.  One row per node and source, so it stays small.
    """
    nodes = quotas.select("source", F.col("quota").cast("long"), F.lit(0).alias("low"), F.lit(shards).alias("m"))
    for depth in range(max(0, math.ceil(math.log2(max(1, shards))))):
        packed = nodes.groupBy("low", "m").agg(
            F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "quota"))).alias("all"),
            F.sum("quota").alias("total"),
        )
        left_m = F.floor(F.col("m") / 2)
        want = F.floor(F.col("total") * left_m / F.col("m"))
        start = F.struct(
            F.col("total").alias("total"), want.alias("want"),
            F.expr("cast(array() as array<struct<source:string,left:bigint,right:bigint>>)").alias("out"),
        )

        def deal(acc: Column, s: Column) -> Column:
            u = (hashed(seed, depth, F.col("low"), s["source"]) + 0.5) / 4294967296.0
            x = hypergeometric(s["quota"], acc["total"], acc["want"], u)
            one = F.struct(s["source"].alias("source"), x.alias("left"), (s["quota"] - x).alias("right"))
            return F.struct((acc["total"] - s["quota"]).alias("total"), (acc["want"] - x).alias("want"), F.concat(acc["out"], F.array(one)).alias("out"))

        dealt = packed.select("low", "m", left_m.cast("int").alias("lm"), F.explode(F.aggregate("all", start, deal)["out"]).alias("s"))
        halves = F.array(
            F.struct(F.col("s.left").alias("quota"), F.col("low"), F.col("lm").alias("m")),
            F.struct(F.col("s.right").alias("quota"), (F.col("low") + F.col("lm")).alias("low"), (F.col("m") - F.col("lm")).alias("m")),
        )
        nodes = dealt.select("s.source", F.explode(halves).alias("h")).select("source", "h.quota", "h.low", "h.m").where("m > 0")
        nodes = written(nodes, "quotas")
    return nodes.select("source", F.col("low").alias("shard"), "quota")


def _beside(dimension: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of one row per source while its size is proven small; Spark joins it its own way beyond."""
    return F.broadcast(dimension) if rows <= MOST_SOURCES else dimension


def _drawn(
    docs: DataFrame, keep: list[str], weights: list[int], share: float = 1.5, cap: float = 2.0, seed: int = 17, shards: int = 16
) -> DataFrame:
    """See mix; the columns ``keep`` stand in place of doc_id."""
    sized = written(
        docs.select(*dict.fromkeys(["doc_id", *keep, "source"]), words_in(F.col("text")).alias("size"), hashed(seed, "doc", F.coalesce(F.col("doc_id").cast("string"), F.md5("text"))).alias("h")), "sizes"
    )
    n_sources = sized.select("source").distinct().count()
    everything = Window.partitionBy(F.lit(0))
    step = F.greatest(F.lit(float(BLOCK_WORDS)), F.sum("source_size").over(everything) / MOST_BLOCKS)
    plan = source_targets(sized, weights, share, cap).select(
        F.col("source").alias("p_source"), "source_size", "target",
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / step)).cast("long").alias("n_blocks"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("passes"),
    ).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    placed = sized.join(_beside(plan, n_sources), F.col("source").eqNullSafe(F.col("p_source"))).withColumn(
        "block", F.pmod("h", "n_blocks")
    )

    # Blocks in permuted order.  Those before the end of the rest are drawn once more than the passes say; one is cut.
    line = Window.partitionBy("source").orderBy(hashed(seed, "block", F.col("source"), F.col("block")), "block")
    blocks = placed.groupBy("source", "block", "passes", "rest").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("place", F.row_number().over(line)).withColumn("upto", F.sum("words").over(line))
    blocks = blocks.withColumn("left", F.col("rest") - F.col("upto") + F.col("words")).select(
        "source", "block", "place", "passes", "left",
        F.count("*").over(Window.partitionBy("source")).alias("line_length"),
        (F.col("left") >= F.col("words")).alias("full"),
        ((F.col("left") > 0) & (F.col("left") < F.col("words"))).alias("cut"),
    ).withColumn("draws", F.col("passes") + (F.col("full") | F.col("cut")).cast("int"))

    # Shards by the tree's exact quotas: draw p of a block is number p * blocks + place of its source.
    tree = splitting_tree(blocks.groupBy("source").agg(F.sum("draws").alias("quota")), shards, seed)
    upto = Window.partitionBy("source").orderBy("shard")
    ranges = tree.withColumn("to", F.sum("quota").over(upto)).groupBy(F.col("source").alias("r_source")).agg(
        F.sort_array(F.collect_list(F.struct("to", "shard"))).alias("ranges")
    )
    number = lambda p: (p.cast("long") - 1) * F.col("line_length") + F.col("place")
    numbers = F.when(F.col("draws") > 0, F.transform(F.sequence(F.lit(1), F.col("draws").cast("int")), number))
    shard_of = lambda d: F.filter("ranges", lambda r: r["to"] >= d)[0]["shard"]
    drawn = blocks.join(_beside(ranges, n_sources), F.col("source").eqNullSafe(F.col("r_source"))).select(
        F.col("source").alias("b_source"), F.col("block").alias("b_block"), "full", "cut", "left",
        F.coalesce(F.filter(F.transform(numbers, shard_of), F.isnotnull), F.expr("cast(array() as array<int>)")).alias("shards"),
    )
    rows = placed.join(drawn, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))

    # In a cut block, documents are taken in order while they fit, then up to three that come nearest to the gap that is left.
    inside = Window.partitionBy("source", "block").orderBy("h", "doc_id", "size", *keep)
    whole = Window.partitionBy("source", "block")
    fits = F.col("upto") <= F.col("left")
    cut = rows.where("cut").withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumn("gap", F.col("left") - F.coalesce(F.max(F.when(fits, F.col("upto"))).over(whole), F.lit(0)))
    cut = cut.withColumn("in", fits)
    for _ in range(3):
        nearest = Window.partitionBy("source", "block", "in").orderBy(F.abs(F.col("size") - F.col("gap")), "h", "doc_id", "size", *keep)
        cut = cut.withColumn("one", ~F.col("in") & (F.row_number().over(nearest) == 1) & (F.col("size") < 2 * F.col("gap")))
        cut = cut.withColumn("gap", F.col("gap") - F.sum(F.when(F.col("one"), F.col("size")).otherwise(0)).over(whole))
        cut = cut.withColumn("in", F.col("in") | F.col("one"))
    cut = cut.withColumn("more", F.col("in").cast("int")).drop("upto", "gap", "in", "one")
    rows = rows.where("not cut").withColumn("more", F.col("full").cast("int")).unionByName(cut)
    # A document is taken as often as the tree's shards drew it.
    draws = F.slice("shards", F.lit(1), (F.col("passes") + F.col("more")).cast("int"))
    return rows.select(*keep, "size", "source_size", "target", draws.alias("draws")).withColumn("taken", F.col("size") * F.size("draws"))


def mix(
    docs: DataFrame, weights: list[int], share: float = 1.5, cap: float = 2.0, seed: int = 17, shards: int = 16
) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, draws.

    draws lists the shards that the document goes to, one entry per copy (none: it isn't taken).  taken = size * copies:
    whole documents are repeated and none is cut; a source misses its target by less than one document.  size: words
    of the text (null: 0).  Null is a source of its own, last in order.  Reruns agree, since every choice is a hash of
    seed and doc_id (where it is null: of the text); rows that repeat a doc_id fall into one block.  An empty table gives no rows.  The text is scanned once.
    """
    return _drawn(docs, ["doc_id"], weights, share, cap, seed, shards)


def mixed_documents(docs: DataFrame, parts: int | None = None, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, once per draw, with shard and place, in shard order and shuffled
    inside each shard.

    Rows are told apart by a key of their own, written once, so each has its own draws, also where doc_ids are null or
    repeated.  Only (key, draws) meets the documents again.  place is a hash of the shard, doc_id and copy; the rows are
    dealt to ``parts`` ranges of (shard, place) and sorted inside, so a shard of any size is shuffled by many tasks, and
    the files of ``docs.write`` read one after another are the shards one after another.  A column of ``docs`` named shard or
    place gives way to these; other names are free.  Null and empty texts have size 0 and are drawn with their block.
    """
    docs, back = set_aside(docs.drop("shard", "place"), "doc_id", "text", "source")
    keyed = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    draws = _drawn(keyed, ["_row"], **how).where(F.size("draws") > 0).select("_row", F.posexplode("draws").alias("copy", "shard"))
    ids = keyed.select("_row", "doc_id").withColumnRenamed("_row", "_id")
    place = hashed("place", F.col("shard"), F.col("doc_id"), F.col("copy"))
    draws = written(draws.join(ids, F.col("_row") == F.col("_id")).select("_row", "shard", place.alias("place")), "draws")
    out = keyed.join(draws, "_row")
    # The key comes last in the order, so that equal places fall the same way in every run of a stage.
    out = out.repartitionByRange(parts or shuffle_width(docs.sparkSession), "shard", "place", "_row").sortWithinPartitions("shard", "place", "_row")
    names = zip(docs.columns, back(docs).columns, strict=True)
    return out.select(*[F.col(a).alias(b) for a, b in names], "shard", "place")
