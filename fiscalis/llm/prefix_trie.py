"""Trie of conversation prefixes, with subtree totals by depth-band rollup.

A turn is known by two 64-bit hashes of its role and text, a prefix by the XOR of the
hashes of (place, turn) over its turns, so prefixes of one conversation are running XORs. Both the
running XORs and the subtree totals work in bands of `BAND` depths:

- prefixes: a window runs inside one band of one conversation; what stands before a band is
  the running XOR of the bands' own XORs, found in the same way one level up;
- totals: a node explodes only to its ancestors within its band. The sums of whole bands form a
  tree of band tops, `BAND` times lower, which is summed in the same way; the completed total of each
  band top is then handed to the node above it, and from there up within that node's band.

So a node makes `BAND` rows at most, and a chain of depth d takes log(d) / log(BAND) levels.
A conversation of any length is numbered by a range sort and per-partition offsets, and
a node of any number of members is a group that combines before the shuffle. The ids that end
in a node are packed into bounded pieces in order, and its digest streams over them.

Results for odd input: NULL role and text are empty; turns without a number come first, turns of one
number in the order of their hashes; equal rows are turns of their own; rows without conv_id
belong to no conversation and are left out; an empty table has no nodes, not even a root; other
columns are ignored. Prefixes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscalis.session import cut

from .common import crc_mod

BAND = 32
PIECE_IDS = 4096
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["pos", "x1", "x2"]


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, i, k1, k2, words): the turns of each conversation numbered from 0, as hashes and word counts."""
    spark = conversations.sparkSession
    column = {name: F.col(f"`{name}`") for name in (conv, turn, role, text)}
    said = [F.coalesce(column[c].cast("string"), F.lit("")) for c in (role, text)]
    # Written first, so that texts are read once: the range sort looks at its input twice.
    turns = cut(spark, conversations.where(column[conv].isNotNull()).select(
        column[conv].cast("long").alias("conv"), column[turn].alias("turn"), F.xxhash64(F.lit(1), *said).alias("k1"), F.xxhash64(F.lit(2), *said).alias("k2"),
        F.regexp_count(said[1], F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row")), "hashed-turns")
    order = ["conv", F.col("turn").asc_nulls_first(), "k1", "k2", "row"]
    dealt = cut(spark, turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", "k1", "k2", "words", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "ordered-turns")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = dealt.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("at").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return cut(spark, dealt.join(spans, ["conv", "part"]).select(
        "conv", (F.col("at") - F.col("first") + F.col("before")).alias("i"), "k1", "k2", "words"), "numbered-turns")


def rebuilt_turns(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first conversation of their group.

    Returns (conv, depth, k1, k2, words) with depth from 1, and (conv) of all
    conversations: one that is left without turns is in the second only.
    """
    spark = turns.sparkSession
    sizes = turns.groupBy("conv").agg(F.count("i").alias("turns"))
    base = F.col("conv") - F.col("conv") % group
    plan = sizes.select("conv", base.alias("base"), crc_mod(F.col("conv"), most).alias("h")).join(
        sizes.select(F.col("conv").alias("base"), "turns"), "base", "left")
    plan = cut(spark, plan.select("conv", "base", "h", F.least("h", F.coalesce("turns", F.lit(0))).alias("taken")), "rebuild-plan")
    own = turns.join(plan, "conv").where("i >= h").select("conv", (F.col("taken") + F.col("i") - F.col("h") + 1).alias("depth"), "k1", "k2", "words")
    heads = turns.where((F.col("i") < most - 1) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
    shared = plan.where("taken > 0").join(heads, "base").where("i < taken").select("conv", (F.col("i") + 1).alias("depth"), "k1", "k2", "words")
    return cut(spark, own.unionByName(shared), "rebuilt-turns"), plan.select("conv")


def _band(pos: Column) -> Column:
    return F.floor(pos / BAND)


def _prefixes(rows: DataFrame, deepest: int) -> DataFrame:
    """Rows (conv, pos, e1, e2, ...) with x1 and x2, the XOR of e1 and e2 up to and with each row."""
    rows = rows.withColumn("band", _band(F.col("pos")))
    inside = Window.partitionBy("conv", "band").orderBy("pos")
    if deepest < BAND:
        return rows.withColumns({"x1": F.bit_xor("e1").over(inside), "x2": F.bit_xor("e2").over(inside)})
    sums = cut(rows.sparkSession, rows.groupBy("conv", F.col("band").alias("pos")).agg(F.bit_xor("e1").alias("e1"), F.bit_xor("e2").alias("e2")), "band-sums")
    before = _prefixes(sums, deepest // BAND).select(
        "conv", F.col("pos").alias("band"), F.col("x1").bitwiseXOR(F.col("e1")).alias("o1"), F.col("x2").bitwiseXOR(F.col("e2")).alias("o2"))
    return rows.join(before, ["conv", "band"]).withColumns({
        "x1": F.col("o1").bitwiseXOR(F.bit_xor("e1").over(inside)), "x2": F.col("o2").bitwiseXOR(F.bit_xor("e2").over(inside))}).drop("o1", "o2")


def _with_ancestors(rows: DataFrame) -> DataFrame:
    """Rows (conv, pos, x1, x2, ...) with `above`: the keys of the ancestors within the band, from its top."""
    rows = rows.withColumn("band", _band(F.col("pos")))
    before = Window.partitionBy("conv", "band").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("above", F.collect_list(F.struct("x1", "x2")).over(before))


def _subtree_sums(levels: list[DataFrame], values: DataFrame) -> DataFrame:
    """(pos, x1, x2, leaves, saved), summed over each node's subtree.

    `levels` are the nodes (pos, x1, x2, p1, p2, above) of all depths, of every BAND-th, ...; the last has one band.
    """
    nodes, parts = levels[0], values
    if len(levels) > 1:
        spark = nodes.sparkSession
        placed = nodes.join(values, KEY)
        top = F.coalesce(F.get("above", F.lit(0)), F.struct("x1", "x2"))
        sums = placed.select(_band(F.col("pos")).alias("pos"), top["x1"].alias("x1"), top["x2"].alias("x2"), "leaves", "saved").groupBy(*KEY).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        done = _subtree_sums(levels[1:], cut(spark, sums, "band-totals"))
        tops = nodes.where((F.col("pos") > 0) & (F.col("pos") % BAND == 0)).select(*KEY, "p1", "p2")
        handed = done.withColumn("pos", F.col("pos") * BAND).join(tops, KEY).select(
            (F.col("pos") - 1).alias("pos"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), "leaves", "saved")
        parts = values.unionByName(handed).groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    reached = nodes.join(parts, KEY).select(
        (F.col("pos") - F.col("pos") % BAND).alias("from"), "leaves", "saved", F.posexplode(F.concat("above", F.array(F.struct("x1", "x2")))).alias("at", "key"))
    return reached.groupBy((F.col("from") + F.col("at")).alias("pos"), F.col("key.x1").alias("x1"), F.col("key.x2").alias("x2")).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (pos, x1, x2, conv) to pieces (pos, x1, x2, least, ids) of at most PIECE_IDS ids of one node."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy() for i in range(3)]
        ids = batch.column(3).to_numpy()
        new = np.zeros(len(ids), dtype=bool)
        new[0] = True
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        run = np.flatnonzero(new)
        begin = np.concatenate([np.arange(lo, hi, PIECE_IDS) for lo, hi in zip(run, np.r_[run[1:], len(ids)], strict=True)])
        joined = [",".join(map(str, ids[lo:hi].tolist())) for lo, hi in zip(begin, np.r_[begin[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([*[pa.array(k[begin]) for k in keys], pa.array(ids[begin]), pa.array(joined)], [*KEY, "least", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and least id to (pos, x1, x2, ends_sha256)."""
    held, state = None, None
    for batch in batches:
        out = []
        for *key, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key == held:
                state.update(b"," + ids.encode())
                continue
            if held is not None:
                out.append((*held, state.hexdigest()))
            held, state = key, hashlib.sha256(ids.encode())
        yield _digests(out)
    if held is not None:
        yield _digests([(*held, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(pos, x1, x2, ends_sha256) of (pos, x1, x2, conv): SHA-256 of each node's ids, ascending, comma-joined."""
    order = [*KEY, "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pack, "pos bigint, x1 bigint, x2 bigint, least bigint, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "least").mapInArrow(_digest, "pos bigint, x1 bigint, x2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of (conv, depth, k1, k2, words) over all (conv).

    Returns its nodes (pos, x1, x2, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) and
    where each conversation ends (pos, x1, x2, conv). A node is named by its depth and its smallest member.
    """
    spark = turns.sparkSession
    deepest = turns.agg(F.max("depth")).first()[0] or 0
    zero = F.lit(0).cast("long")
    rows = turns.select("conv", F.col("depth").alias("pos"), F.xxhash64("depth", "k1").alias("e1"), F.xxhash64("depth", "k2").alias("e2"), "words").unionByName(
        conversations.select("conv", zero.alias("pos"), zero.alias("e1"), zero.alias("e2"), zero.alias("words")))
    rows = cut(spark, _with_ancestors(_prefixes(rows, deepest)).select(
        "conv", *KEY, F.col("x1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("e2")).alias("p2"), "words", "above"), "prefixes")
    same = [F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.any_value("above").alias("above")]
    found = cut(spark, rows.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), F.count("conv").alias("n_convs"), F.min("words").alias("words"), *same), "trie-nodes")
    levels, line = [found.select(*KEY, "p1", "p2", "above")], rows.select("conv", *KEY)
    while deepest >= BAND:
        deepest //= BAND
        line = line.where(F.col("pos") % BAND == 0).withColumn("pos", _band(F.col("pos")))
        above = line.select("conv", (F.col("pos") + 1).alias("pos"), F.col("x1").alias("p1"), F.col("x2").alias("p2"))
        placed = _with_ancestors(line).join(above, ["conv", "pos"], "left")
        levels.append(cut(spark, placed.groupBy(*KEY).agg(*same), "trie-level"))
    children = found.where("pos > 0").groupBy((F.col("pos") - 1).alias("pos"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("pos").alias("n_children"))
    nodes = cut(spark, found.drop("above").join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    values = nodes.select(*KEY, (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    parents = nodes.select((F.col("pos") + 1).alias("pos"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(_subtree_sums(levels, values), KEY).join(parents, ["pos", "p1", "p2"], "left").select(
        *KEY, "conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ends = rows.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("last")).select("last.*", "conv")
    return whole, ends
