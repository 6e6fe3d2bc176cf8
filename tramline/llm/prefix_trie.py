"""The trie of conversation prefixes, with a count-min sketch that keeps unshared tails out of the exact grouping.

A node is a distinct sequence of first turns; a conversation is a member of the nodes on its path.  Texts never travel: a turn
is two 64-bit hashes and its number of bytes, and a prefix is the exclusive-or of hashes of (turn, depth), 128 bits together,
so it can be added up in pieces.

1. Turns are ranged by (conversation, turn) and written once; ranks and prefixes are made by range and carried over ranges, so
   a conversation of any length isn't one task.
2. Every path adds its prefixes to partition-local count-min sketches, merged cell by cell.  A cell's sum is never below the
   number of conversations with the prefix, so an estimate of one proves a singleton: such nodes, the tails of paths, are
   emitted where they are, with one member and one leaf.
3. Only prefixes estimated twice or more are shuffled, pre-aggregated, and grouped exactly: least member, members, children.
4. Subtree sums need no walk: a node's own value belongs to its least member; summed from the end of that member's path
   upwards and then over the members of a node, it counts exactly once for every ancestor.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, shuffle_width, written
from .substring_dedup import BLOCK_BITS, DEPTH, _cells, _merged

BITS = 26
#: Depths of one path that are summed in one window; longer paths carry sums over blocks of as many.
_BLOCK = 4096
#: Bytes of a piece of a node's list of members.
_PIECE = 1 << 20


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, a, b, bytes): two hashes of each turn's role and text, and the UTF-8 bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("b"), text, role).alias("b"), F.octet_length(text).cast("long").alias("bytes"),
    )


def _step(a: Column, b: Column, depth: Column) -> Column:
    """What a turn at a depth adds to a prefix."""
    return F.struct(F.xxhash64(F.lit(1), a, b, depth.cast("long")).alias("fa"), F.xxhash64(F.lit(2), a, b, depth.cast("long")).alias("fb"))


def _ranked(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place r in their conversation, and (part, conv, n, before, total) of each conversation in each range."""
    order = ["conv", "turn", "a", "b"]
    t = turns(conversations)
    ranged = t.repartitionByRange(shuffle_width(t.sparkSession), *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "turns")
    by_conv = Window.partitionBy("conv")
    counts = ranged.groupBy("part", "conv").agg(F.count("*").alias("n"))
    counts = counts.select(
        "part", "conv", "n", F.coalesce(F.sum("n").over(by_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(by_conv).alias("total"),
    )
    local = F.row_number().over(Window.partitionBy("part", "conv").orderBy("turn", "a", "b"))
    ranked = ranged.withColumn("local", local).join(counts.select("part", "conv", "before"), ["part", "conv"])
    return ranked.withColumn("r", F.col("before") + F.col("local") - 1).drop("before", "local", "turn"), counts


def plain_paths(conversations: DataFrame) -> DataFrame:
    """The prefixes of conversations as they are; see ``paths``."""
    return paths(conversations, most_head=0, head_of=lambda c: c, head_turns=lambda c: F.lit(0))


def paths(conversations: DataFrame, most_head: int, head_of, head_turns) -> DataFrame:
    """(conv, depth, length, xa, xb, fa, fb, bytes): every prefix of every conversation, depth 0 included.

    A conversation c is the first ``head_turns(c)`` turns (at most ``most_head``, a small number) of conversation ``head_of(c)``,
    all of them if it has fewer and none if there is no such conversation, and then c's own turns after as many.  Turns go by
    turn number, null first, then by their hashes.  Rows without conv_id belong to no conversation.
    """
    ranked, counts = _ranked(conversations)
    least = ranked.where(F.col("r") < most_head).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("r", "a", "b", "bytes"))).alias("head"))
    convs = counts.where("before = 0").select("conv", "total", head_of(F.col("conv")).alias("of"), head_turns(F.col("conv")).cast("long").alias("h"))
    convs = convs.join(least.select(F.col("conv").alias("of"), "head"), "of", "left")
    m = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    convs = convs.withColumn("m", F.greatest(m, F.lit(0)).cast("int")).withColumn(
        "head", F.when(F.col("m") > 0, F.slice("head", F.lit(1), F.col("m"))).otherwise(F.array().cast("array<struct<r:bigint,a:bigint,b:bigint,bytes:bigint>>"))
    )
    steps = F.transform("head", lambda x, i: F.struct(_step(x["a"], x["b"], i + 1).alias("f"), x["bytes"].alias("bytes")))
    convs = convs.select("conv", "h", "m", (F.col("m") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length"), steps.alias("steps"))
    upto = lambda n, lane: F.aggregate(F.slice("steps", F.lit(1), n), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x["f"][lane]))
    heads = convs.select(
        "conv", "length",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("m")), lambda d: F.struct(
            d.cast("long").alias("depth"), upto(d, "fa").alias("xa"), upto(d, "fb").alias("xb"),
            F.coalesce(F.get("steps", d - 1)["f"]["fa"], F.lit(0)).alias("fa"), F.coalesce(F.get("steps", d - 1)["f"]["fb"], F.lit(0)).alias("fb"),
            F.coalesce(F.get("steps", d - 1)["bytes"], F.lit(0)).alias("bytes"),
        ))).alias("p"),
    ).select("conv", "length", "p.*")

    here = counts.join(convs.select("conv", "h", "m", "length", upto(F.col("m"), "fa").alias("ha"), upto(F.col("m"), "fb").alias("hb")), "conv")
    own = ranked.join(here.select("part", "conv", "h", "m", "length", "ha", "hb", (F.col("n") < F.col("total")).alias("spans")), ["part", "conv"]).where("r >= h")
    own = own.withColumn("depth", F.col("m") + F.col("r") - F.col("h") + 1).withColumn("f", _step(F.col("a"), F.col("b"), F.col("depth")))
    # A conversation over several ranges takes along what its earlier ranges add; there are at most two such per range.
    carried = own.where("spans").groupBy("part", "conv").agg(F.expr("bit_xor(f.fa)").alias("ca"), F.expr("bit_xor(f.fb)").alias("cb"))
    earlier = "over (partition by conv order by part rows between unbounded preceding and 1 preceding)"
    carried = carried.select("part", "conv", F.expr(f"bit_xor(ca) {earlier}").alias("ca"), F.expr(f"bit_xor(cb) {earlier}").alias("cb"))
    sofar = "over (partition by part, conv order by r)"
    own = own.withColumns({"la": F.expr(f"bit_xor(f.fa) {sofar}"), "lb": F.expr(f"bit_xor(f.fb) {sofar}")}).join(carried, ["part", "conv"], "left")
    added = lambda *c: reduce(lambda s, x: s.bitwiseXOR(F.coalesce(x, F.lit(0))), map(F.col, c[1:]), F.col(c[0]))
    own = own.select("conv", "length", "depth", added("la", "ha", "ca").alias("xa"), added("lb", "hb", "cb").alias("xb"), "f.fa", "f.fb", "bytes")
    return heads.unionByName(own)


_SKETCH = pa.schema([("block", pa.int32()), ("cells", pa.binary())])


def _prefix_key(batch: pa.RecordBatch) -> np.ndarray:
    xa, xb = (batch.column(batch.schema.get_field_index(c)).to_numpy().view(np.uint64) for c in ("xa", "xb"))
    return xa ^ (xb << np.uint64(1))


def _touched(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Cells that prefixes touch, by block: 16 bits each, a cell at most twice, since two already say "not proven single"."""
    for batch in batches:
        blocks, packed = [], []
        for r, cell in enumerate(_cells(_prefix_key(batch), bits)):
            cell = np.sort(cell)
            keep = np.ones(len(cell), bool)
            keep[2:] = cell[2:] != cell[:-2]
            cell = cell[keep]
            begins = np.flatnonzero(np.diff(cell >> BLOCK_BITS, prepend=-1))
            for x, y in zip(begins.tolist(), np.append(begins, len(cell))[1:].tolist(), strict=True):
                blocks.append((r << (bits - BLOCK_BITS)) + int(cell[x] >> BLOCK_BITS))
                packed.append((cell[x:y] & ((1 << BLOCK_BITS) - 1)).astype("<u2").tobytes())
        yield pa.record_batch([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], schema=_SKETCH)


def shared_cells(prefixes: DataFrame, bits: int) -> bytes:
    """The merged sketch: DEPTH * 2**bits bits, set where two conversations or more touch a cell."""
    rows = arrow_map(prefixes.select("xa", "xb"), lambda b: _touched(b, bits), "block int, cells binary")
    rows = rows.repartition(min(shuffle_width(prefixes.sparkSession), DEPTH << (bits - BLOCK_BITS)), "block").sortWithinPartitions("block")
    size = (1 << BLOCK_BITS) // 8
    out = bytearray(DEPTH * (1 << bits) // 8)
    for r in arrow_map(rows, _merged, "block int, cells binary").toLocalIterator(prefetchPartitions=True):
        out[r["block"] * size : (r["block"] + 1) * size] = zlib.decompress(r["cells"])
    return bytes(out)


def screened(prefixes: DataFrame, bits: int) -> DataFrame:
    """The prefixes with ``maybe``: false where the sketch proves that one conversation has the prefix."""
    held = prefixes.sparkSession.sparkContext.broadcast(shared_cells(prefixes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            often = np.ones(batch.num_rows, bool)
            for r, cell in enumerate(_cells(_prefix_key(batch), bits)):
                cell += r << bits
                often &= (flags[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
            yield batch.append_column("maybe", pa.array(often))

    ddl = "conv long, depth long, length long, xa long, xb long, fa long, fb long, bytes long, maybe boolean"
    return arrow_map(prefixes.select(*[c.split()[0] for c in ddl.split(", ")[:-1]]), run, ddl)


_PIECES = pa.schema([("xa", pa.int64()), ("xb", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([("xa", pa.int64()), ("xb", pa.int64()), ("ends", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and conversation: the decimal ids of a node in a batch, comma-joined."""
    for batch in batches:
        if not batch.num_rows:
            continue
        xa, xb, conv = (batch.column(k).to_numpy() for k in range(3))
        new = np.flatnonzero((xa[1:] != xa[:-1]) | (xb[1:] != xb[:-1])) + 1
        begins = np.concatenate([[0], new])
        ends = np.append(new, len(conv))
        ids = [",".join(map(str, conv[x:y].tolist())) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
        yield pa.record_batch([pa.array(xa[begins]), pa.array(xb[begins]), pa.array(conv[begins]), pa.array(ids)], schema=_PIECES)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come sorted by node and first id; one running SHA-256 a node."""
    now, sha = None, None
    for batch in batches:
        out = []
        for xa, xb, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (xa, xb) != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (xa, xb), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], schema=_ENDS)
    if now is not None:
        yield pa.record_batch([pa.array([now[0]]), pa.array([now[1]]), pa.array([sha.hexdigest()])], schema=_ENDS)


def _ends(members: DataFrame) -> DataFrame:
    """(xa, xb, ends): SHA-256 of the ascending ids of the conversations that end at a node.  The hash of a node's list is one
    chain, so its ids are first joined to pieces where they lie and only pieces meet."""
    n = shuffle_width(members.sparkSession)
    ranged = members.select("xa", "xb", "conv").repartitionByRange(n, "xa", "xb", "conv").sortWithinPartitions("xa", "xb", "conv")
    pieces = arrow_map(ranged, _pieces, "xa long, xb long, first long, ids string")
    return arrow_map(pieces.repartition(n, "xa", "xb").sortWithinPartitions("xa", "xb", "first"), _digested, "xa long, xb long, ends string")


def _sums_from_the_end(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each path's sums of ``columns`` from its end to each row; paths longer than a block carry the sums of later blocks."""
    d = rows.withColumn("block", F.floor(F.col("depth") / _BLOCK))
    local = Window.partitionBy("conv", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = d.where(F.col("length") >= _BLOCK).groupBy("conv", "block").agg(*[F.sum(c).alias(c) for c in columns])
    blocks = blocks.select("conv", "block", *[F.sum(c).over(later).alias(f"later_{c}") for c in columns])
    d = d.withColumns({f"upto_{c}": F.sum(c).over(local) for c in columns}).join(blocks, ["conv", "block"], "left")
    return d.withColumns({f"upto_{c}": F.col(f"upto_{c}") + F.coalesce(f"later_{c}", F.lit(0)) for c in columns}).drop("block", *[f"later_{c}" for c in columns])


def trie(prefixes: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per node of the trie of ``prefixes`` (see ``paths``), all long but ends_sha256 (string).

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id (root: null); n_convs: members; n_children; n_leaves:
    childless nodes in its subtree, itself included; saved_tokens: over its subtree, (n_convs - 1) times the UTF-8 bytes of the
    node's last text; ends_sha256: lowercase hex over the decimal ids of the members that end here, ascending, comma-joined
    (none: of the empty string).  Two nodes are told apart by 128 bits.  Conversations without a turn are members of the root;
    without any conversation there is no row.
    """
    spark = prefixes.sparkSession
    rows = written(screened(written(prefixes, "prefixes"), bits), "screened")
    none, no_ends = F.lit(0).cast("long"), F.sha2(F.lit(""), 256)
    convs = rows.where("depth = 0")
    root_id = convs.agg(F.min("conv").alias("root_id"))

    # Grouped exactly: what may be shared.  Each member row then knows its node's least member.
    shared = rows.where("maybe and depth > 0")
    nodes = shared.groupBy("xa", "xb").agg(F.min("conv").alias("least"), F.count("*").alias("n_convs"), F.max("length").alias("longest"))
    # Written first: a join of two plain exchanges is one that adaptive execution splits where a node has many members.
    nodes = written(nodes, "nodes")
    member = written(shared.join(nodes.hint("shuffle_merge"), ["xa", "xb"]), "members")
    owned = F.col("least") == F.col("conv")

    # One row for every node, at its least member, with its parent's.
    columns = ["conv", "depth", "length", "xa", "xb", "fa", "fb"]
    single = rows.where("not maybe and depth > 0").select(*columns, F.lit(1).cast("long").alias("n_convs"), F.col("length").alias("longest"), F.lit(False).alias("grouped"))
    every = single.unionByName(member.where(owned).select(*columns, "n_convs", "longest", F.lit(True).alias("grouped")))
    above = member.where(F.col("depth") < F.col("length")).select("conv", (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent"))
    every = every.join(above, ["conv", "depth"], "left").join(F.broadcast(root_id))
    parent = F.when(F.col("depth") == 1, F.col("root_id")).otherwise(F.coalesce("parent", "conv"))
    under_grouped = F.col("parent").isNotNull() | (F.col("depth") == 1)
    every = every.select(*columns, "n_convs", "longest", "grouped", parent.alias("parent_conv_id"), under_grouped.alias("under_grouped"))

    # Values of a node lie at its least member; they are summed up its path, then over the members of each ancestor.
    leaf = (F.col("depth") == F.col("length")) & owned & (F.col("longest") == F.col("depth"))
    values = member.select(
        "conv", "depth", "length", "xa", "xb", leaf.cast("long").alias("leaves"),
        F.when(owned, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(none).alias("saved"), F.lit(True).alias("inner"),
    )
    tails = rows.where("not maybe and depth > 0 and depth = length").select(
        "conv", "depth", "length", "xa", "xb", F.lit(1).cast("long").alias("leaves"), none.alias("saved"), F.lit(False).alias("inner")
    )
    values = values.unionByName(tails)
    up = _sums_from_the_end(values, ["leaves", "saved"]).where("inner").select("xa", "xb", F.col("upto_leaves").alias("leaves"), F.col("upto_saved").alias("saved"), none.alias("children"))
    born = every.where("under_grouped").select(F.col("xa").bitwiseXOR(F.col("fa")).alias("xa"), F.col("xb").bitwiseXOR(F.col("fb")).alias("xb"), none.alias("leaves"), none.alias("saved"), F.lit(1).cast("long").alias("children"))
    total = values.select(F.lit(0).cast("long").alias("xa"), F.lit(0).cast("long").alias("xb"), "leaves", "saved", none.alias("children"))
    sums = up.unionByName(born).unionByName(total).groupBy("xa", "xb").agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "children")])
    ends = _ends(rows.where("depth = length and (maybe or depth = 0)"))

    alone = every.where("not grouped").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), none.alias("saved_tokens"),
        F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(no_ends).alias("ends_sha256"),
    )
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        "conv", none.alias("depth"), none.alias("xa"), none.alias("xb"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs"
    )
    grouped = every.where("grouped").select("conv", "depth", "xa", "xb", "parent_conv_id", "n_convs").unionByName(root)
    grouped = grouped.join(sums, ["xa", "xb"], "left").join(ends, ["xa", "xb"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("children", none).alias("n_children"),
        F.greatest(F.coalesce("leaves", none), F.lit(1)).alias("n_leaves"), F.coalesce("saved", none).alias("saved_tokens"), F.coalesce("ends", no_ends).alias("ends_sha256"),
    )
    return alone.unionByName(grouped)


def prefix_trie(conversations: DataFrame, bits: int = BITS) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are; see ``trie``.

    Null roles and texts count as empty, null turns come first, equal turns go by their hashes, rows without conv_id are
    left out, repeated rows are turns of their own; texts of any length are read whole; other columns are ignored.
    """
    return trie(plain_paths(conversations), bits)


def rebuilt_trie(conversations: DataFrame, group: int = 5, heads: int = 9, bits: int = BITS) -> DataFrame:
    """The trie of rebuilt conversations: c takes the first crc32(decimal c) % heads turns of conversation c - c % group
    (the remainder isn't negative) before its own turns after as many."""
    c_of = lambda c: c - F.pmod(c, F.lit(group))
    turns_of = lambda c: F.crc32(c.cast("string").cast("binary")) % heads
    return trie(paths(conversations, heads - 1, c_of, turns_of), bits)
