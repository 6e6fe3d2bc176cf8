"""Near-duplicate groups of documents by fast similarity sketching, banding and exact verification.

1. Documents with the same words are one node (their digests agree); only one of them goes on.
2. Sketch: rounds of hashed bin placement over the 5-word shingles.  In the first T rounds a shingle falls into the bin that
   its hash names, in round T + i all fall into bin i, so every coordinate is filled; agreement of coordinates has mean J and
   concentrates as if the coordinates were independent.  Rounds end once all bins are filled.
3. Banding: BANDS bands of ROWS coordinates.  A pair at similarity 0.75 shares no band with probability
   (1 - 0.75**5)**40 = 2e-5, one at 0.8 with 1.2e-7.
4. Members of a bucket are joined in a star, so no pairs are listed; the stars' components are candidate groups.
5. Every candidate is compared once, on full shingle sets, with the least hub of its stars; that settles most of a group of
   near copies as one cluster.  In a group that is one cluster nothing is left to do.
6. In the others, each document outside the group's largest cluster meets every document of the group (in blocks of bounded
   size, each block pair in its own task), so no link between clusters is lost, and a text of the largest cluster is copied
   only once for each block of the rest.  The components of all confirmed links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .shared import arrow_map, column_of, key_changes, shuffle_width, spans_of_rows, tables_by_key, text_buffer, written

SHINGLE, BANDS, ROWS = 5, 40, 5
T = BANDS * ROWS
#: A block of a candidate group has about so many documents and bytes of text at most.
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
_CHUNK = 1 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def digests(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row's words in order (0: no words)."""
    n = np.diff(before)
    out = np.zeros(len(n), np.uint64)
    if len(h):
        place = (np.arange(len(h)) - np.repeat(before[:-1], n)).astype(np.uint64)
        out[n > 0] = W.mix(np.add.reduceat(W.mix(h ^ W.mix(place)), before[:-1][n > 0]) ^ n[n > 0].astype(np.uint64))
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, also: int | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct shingle hashes, their rows) sorted by row and hash, and the rows' digests (a second one by seed ``also``)."""
    data = W.lower(data)
    starts, lens, before = W.split(data, offsets)
    h = W.hashes(data, starts, lens, 1)
    at, row = W.whole_rows(before, SHINGLE)
    sh = W.grams(h, SHINGLE)[at] if len(at) else h[:0]
    digest = [digests(h, before)] + ([digests(W.hashes(data, starts, lens, also), before)] if also else [])
    n = np.diff(before)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    sh, row = np.concatenate([sh, W.mix(digest[0][short])]), np.concatenate([row, short])
    order = np.lexsort((sh, row))
    sh, row = sh[order], row[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    return sh[new], row[new], digest


def sketches(sh: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Fast similarity sketches (n_rows x T); a row without shingles keeps empty coordinates."""
    filled = np.full(n_rows * T, _EMPTY)
    base = row * T
    for i in range(2 * T):
        if not len(sh):
            break
        x = W.mix(sh ^ np.uint64(0x5851F42D4C957F2D * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        place = ((x >> np.uint64(32)) * np.uint64(T) >> np.uint64(32)).astype(np.int64) if i < T else i - T
        np.minimum.at(filled, base + place, (np.uint64(i) << np.uint64(48)) | (W.mix(x) >> np.uint64(16)))
        lacking = (filled.reshape(n_rows, T) == _EMPTY).any(axis=1)
        if i < 8 or i % 8 == 7:
            live = lacking[base // T]
            sh, base = sh[live], base[live]
    return filled.reshape(n_rows, T)


def bands(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band of each row."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    out = np.broadcast_to(W.mix(np.arange(BANDS, dtype=np.uint64)), parts.shape[:2])
    for r in range(ROWS):
        out = W.mix(out ^ parts[:, :, r])
    return out


_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("n_bytes", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))]
)
_SIGNED_DDL = "doc_id long, n_shingles long, n_bytes long, d1 long, d2 long, bands array<long>"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_buffer(column_of(batch, "text"))
        ids = column_of(batch, "doc_id")
        for a, b in spans_of_rows(off, _CHUNK):
            part, cut = data[off[a] : off[b]], off[a : b + 1] - off[a]
            sh, row, (d1, d2) = shingles(part, cut, 2)
            own = bands(sketches(sh, row, b - a))
            n = np.bincount(row, minlength=b - a)
            lists = pa.ListArray.from_arrays(
                np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32), pa.array(own.ravel().view(np.int64))
            )
            columns = [ids.slice(a, b - a), n, np.diff(cut), d1.view(np.int64), d2.view(np.int64), lists]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SIGNED, strict=True)], schema=_SIGNED)


def links_within(sh: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Boolean matrix of the rows' links: 100 * intersection >= 75 * union, counted on full sets.

    Shingles of one row alone can't meet; the others are counted as a product of 0/1 matrices, some columns at a time.
    """
    size = np.bincount(row, minlength=n_rows)
    order = np.argsort(sh, kind="stable")
    sh, row = sh[order], row[order]
    new = np.ones(len(sh), bool)
    new[1:] = sh[1:] != sh[:-1]
    group = np.cumsum(new) - 1
    shared = np.bincount(group, minlength=1)[group] > 1
    row, group = row[shared], group[shared]
    column = np.cumsum(np.diff(group, prepend=-1) != 0) - 1 if len(group) else group
    common = np.zeros((n_rows, n_rows), np.float32)
    width = max(64, (8 << 20) // (4 * n_rows))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        x = np.zeros((n_rows, min(width, int(column[b - 1]) - low + 1)), np.float32)
        x[row[a:b], column[a:b] - low] = 1
        common += x @ x.T
    union = size[:, None] + size[None, :] - common
    return (100 * common >= 75 * union) & (size[:, None] > 0)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix, by breadth-first search."""
    todo, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root], front = False, [root]
        while front:
            at = front.pop()
            near = np.flatnonzero(linked[at] & todo)
            todo[near] = False
            edges += [(at, int(k)) for k in near]
            front += near.tolist()
    return edges


_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["grp", "b1", "b2"]
    for table in tables_by_key(batches, keys):
        edge = np.concatenate([[0], key_changes(table, keys), [table.num_rows]])
        nodes = table.column("node").to_numpy()
        data, off = text_buffer(table.column("text").combine_chunks())
        u, v = [], []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            sh, row, _ = shingles(data[off[a] : off[b]], off[a : b + 1] - off[a])
            for x, y in forest(links_within(sh, row, b - a)):
                u.append(nodes[a + x])
                v.append(nodes[a + y])
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_LINK)


def links_in_blocks(members: DataFrame, texts: DataFrame, hub: Column) -> DataFrame:
    """Confirmed links (u, v) in every group of ``members`` (node, grp, n_bytes) between a ``hub`` document and any other one.

    Both kinds are cut into blocks by a hash.  A block pair of hubs with hubs or of hubs with others is one piece of work, so
    another document's text is copied once for each block of hubs, and a hub's once for every block.
    """
    marked = members.withColumn("hub", hub)
    width = lambda is_hub: F.greatest(
        F.ceil(F.count(F.when(F.col("hub") == is_hub, 1)) / BLOCK_DOCS),
        F.ceil(F.coalesce(F.sum(F.when(F.col("hub") == is_hub, F.col("n_bytes"))), F.lit(0)) / BLOCK_BYTES),
    ).cast("int")
    blocks = marked.groupBy("grp").agg(width(True).alias("hubs"), width(False).alias("others"))
    mine = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.when(F.col("hub"), F.col("hubs")).otherwise(F.col("others")))).cast("int")
    placed = written(marked.join(blocks, "grp").withColumn("mine", mine), "placed")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    pair = lambda a, b: F.struct(a.alias("b1"), b.alias("b2"))
    # Block numbers of others come behind those of the hubs.
    with_hubs = F.transform(upto(F.col("hubs")), lambda k: pair(F.least(k, F.col("mine")), F.greatest(k, F.col("mine"))))
    with_others = F.transform(upto(F.col("others")), lambda k: pair(F.col("mine"), F.col("hubs") + k))
    as_other = F.transform(upto(F.col("hubs")), lambda k: pair(k, F.col("hubs") + F.col("mine")))
    pairs = F.when(F.col("hub"), F.concat(F.when(F.col("hubs") > 1, with_hubs).otherwise(F.expr("cast(array() as array<struct<b1:int,b2:int>>)")), with_others)).otherwise(as_other)
    # One block of hubs without others is a piece of its own; with others it is part of every piece.
    alone = (F.col("hubs") == 1) & (F.col("others") == 0)
    pairs = F.when(alone, F.array(pair(F.lit(0), F.lit(0)))).otherwise(pairs)
    spread = placed.select("node", "grp", F.explode(pairs).alias("p")).select("node", "grp", "p.b1", "p.b2")
    work = texts.join(spread.hint("merge"), "node").repartition(shuffle_width(members.sparkSession), "grp", "b1", "b2")
    work = work.sortWithinPartitions("grp", "b1", "b2", "node").select("grp", "b1", "b2", "node", "text")
    return written(arrow_map(work, _verified, "u long, v long"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of bytes outside space and 0x09-0x0D, A-Z lower-cased.  A document's set: its distinct 5-word shingles; with
    fewer words the whole sequence; null, empty and blank texts have none and link with nothing.  Documents with
    100 * intersection >= 75 * union are linked; component_id is the smallest doc_id that can be reached, kept marks that
    row (each of them, where rows repeat it).  A row with a null doc_id makes no link; it has the component of a row with the
    same words, null if there is none.  Rows that repeat a doc_id are one document for its links: they share a component.  An empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = written(arrow_map(text, _signed, _SIGNED_DDL), "signed")

    # One node for all rows with the same words: the smallest doc_id.
    same = ["d1", "d2"]
    nodes = written(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("node"), F.max("n_bytes").alias("n_bytes")),
        "nodes",
    )
    own = nodes.select(F.col("node").alias("doc_id"), *same)
    dealt = signed.join(own, ["doc_id", *same], "left_semi").select("doc_id", F.explode("bands").alias("bucket"))
    stars = dealt.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last")
    spokes = dealt.join(stars.select("bucket", "hub"), "bucket").where("doc_id > hub")
    candidates = components(spokes.select(F.col("doc_id").alias("u"), F.col("hub").alias("v")), "candidates")

    # The texts of candidates are met once; they grow with the corpus, so this is a sort-merge join, never a broadcast.
    every = text.withColumnRenamed("doc_id", "node").where("node is not null")
    node_text = written(every.join(candidates.select("node").hint("merge"), "node", "left_semi"), "candidate_text")

    # First links: each candidate with its least hub.
    ray = written(spokes.groupBy(F.col("doc_id").alias("node")).agg(F.min("hub").alias("grp")), "rays")
    hubs = ray.select(F.col("grp").alias("node"), "grp").distinct()
    ends = ray.unionByName(hubs)
    # A hub's spokes are dealt in blocks, and the hub's text goes to every block.
    sized = written(ends.join(nodes.select("node", "n_bytes"), "node"), "ends")
    first = links_in_blocks(sized, node_text, hub=F.col("node") == F.col("grp"))
    clusters = components(first, "clusters")

    # Then what may still be linked across clusters of one candidate group.
    member = candidates.join(nodes, "node").join(clusters.withColumnRenamed("component", "cluster"), "node", "left").select(
        "node", F.col("component").alias("grp"), "n_bytes", F.coalesce("cluster", "node").alias("cluster")
    )
    member = written(member, "member")
    share = member.groupBy("grp", "cluster").agg(F.count("*").alias("n"))
    largest = share.groupBy("grp").agg(F.max(F.struct("n", "cluster"))["cluster"].alias("most"), F.count("*").alias("clusters"))
    mixed = member.join(largest.where("clusters > 1").drop("clusters"), "grp")
    mixed = written(mixed.select("node", "grp", "n_bytes", (F.col("cluster") != F.col("most")).alias("minor")), "mixed")
    rest = links_in_blocks(mixed, node_text, hub=F.col("minor"))
    # Rows that repeat a doc_id with other words link their nodes.
    worded = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", *same)
    several = worded.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("a"), F.max(F.struct(*same)).alias("b")).where("a != b").select("doc_id")
    shared = written(worded.join(several, "doc_id", "left_semi").join(nodes.select(*same, "node"), same).select("doc_id", "node"), "repeated")
    ties = shared.join(shared.groupBy("doc_id").agg(F.min("node").alias("u")), "doc_id").where("u < node").select("u", F.col("node").alias("v"))
    found = components(first.unionByName(rest).unionByName(ties), "groups")

    groups = nodes.join(found, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id"))
    joined = signed.join(groups, same, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one row of every near-duplicate group, the one with the smallest doc_id.

    Rows are told apart by a key of their own, written once.  A null doc_id links like any other and comes last; of rows
    with the same doc_id in a group one stays; rows without words all stay.
    """
    keyed = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))["_row"]
    stay = keyed.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(first.alias("_row")).select("_row")
    return keyed.join(stay, "_row", "left_semi").select(*docs.columns)
