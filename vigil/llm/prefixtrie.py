"""Operator 13: trie of conversation prefixes by fixed-length block hashing.

A conversation becomes blocks of ``BLOCK`` turns.  A turn has a digest of its depth,
role and text; a block's digest joins those of its turns, and the key of a prefix
joins the digests of its blocks (128 bits, by exclusive or: digests are bound to
their depth, so a prefix key is a sum that any split of a conversation adds up to).

1. Conversations are grouped by successive block digests: a class is all blocks
   with the same key before them and the same digest.
2. Where only one class follows a key, its turns are nodes as they stand.  Where
   several do, siblings diverge somewhere inside: only the turns of these classes
   (one row per class, not per conversation) are taken apart and grouped by key.
3. A node belongs to its smallest member.  The nodes of one conversation are a
   chain downwards; what a subtree sums up is the rest of the node's own chain plus
   the chains that leave it further down, each of which adds its total to the
   prefix of its conversation above it, again by block classes first.

No step gathers a conversation, a node's members or its children in one group:
texts are digested where they are read, places of turns come from counts of sorted
parts, keys from sums over stretches of blocks, and the ids that end at a node are
hashed as a sorted stream of chunks.

Edge cases: null role and text are empty; a null turn comes first; equal turns go
by role, the first 64 code points of the text, then its SHA-256; a repeated row is
another turn; rows without ``conv_id`` belong to no conversation and are left out; a
conversation without turns is a member of the root alone; very long texts are only
digested and counted; an empty table has no conversation and gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored

BLOCK = 4
#: Blocks of one stretch of a conversation, within which keys are summed up in order.
STRETCH = 4096
#: Conversation ids of one chunk of text that is hashed.
CHUNK_IDS = 4096

KEY = ["depth", "k1", "k2"]


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): turns in their order, from 1, as digest of role
    and text and count of words; a turn's place comes from counts of sorted parts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    light = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", role.alias("role"), F.sha2(text, 256).alias("_t"), F.substring(text, 1, 64).alias("_head"),
        F.md5(F.concat_ws("\x00", F.octet_length(role).cast("string"), role, text)).alias("digest"),
        F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long").alias("words"))
    order = [F.asc_nulls_first("turn"), "role", "_head", "_t"]
    parts = stored(light.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
                   .withColumn("_part", F.spark_partition_id()), "trie-turns")
    counts = parts.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv_id", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*order))
    return (parts.withColumn("_row", inside).join(before, ["conv_id", "_part"])
            .select("conv_id", (F.col("_before") + F.col("_row")).cast("long").alias("pos"), "digest", "words"))


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations and (conv_id, depth, digest, words) of their
    turns after rebuilding: with h = crc32(conv_id) % ``most``, the first h turns of
    conversation ``conv_id - conv_id % every``, then the own turns after the first h."""
    base = F.col("conv_id") - F.col("conv_id") % every
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    turns = stored(turns, "trie-places")
    convs = stored(turns.select("conv_id").distinct().select("conv_id", base.alias("_base"), h.alias("_h")), "trie-conversations")
    heads = (turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most))
             .select(F.col("conv_id").alias("_base"), "pos", "digest", "words"))
    first = (convs.join(heads, "_base").where(F.col("pos") <= F.col("_h"))
             .select("conv_id", F.col("pos").alias("depth"), "digest", "words"))
    have = heads.groupBy("_base").agg(F.count(F.lit(1)).alias("_have"))
    shift = convs.join(have, "_base", "left").select("conv_id", "_h", F.least(F.coalesce("_have", F.lit(0)), "_h").alias("_k"))
    own = (turns.join(shift, "conv_id").where(F.col("pos") > F.col("_h"))
           .select("conv_id", (F.col("_k") + F.col("pos") - F.col("_h")).alias("depth"), "digest", "words"))
    return convs.select("conv_id"), first.unionByName(own)


def _half(seed: str, depth: Column, digest: Column) -> Column:
    return F.xxhash64(F.lit(seed), digest, depth.cast("long"))


def blocks(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per conversation and block: conv_id, block, p1, p2 (key before it), x1, x2
    (its digest), turns (an array of at most ``size`` of depth, h1, h2, words)."""
    one = F.struct("depth", "h1", "h2", "words")
    cut = (turns.select("conv_id", "depth", "words", _half("a", F.col("depth"), F.col("digest")).alias("h1"),
                        _half("b", F.col("depth"), F.col("digest")).alias("h2"))
           .withColumn("block", F.floor((F.col("depth") - 1) / size).cast("long"))
           .groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.sort_array(F.collect_list(one)).alias("turns"))
           .withColumn("_stretch", F.floor(F.col("block") / STRETCH).cast("long")))
    cut = stored(cut, "trie-cut")
    nil = F.lit(0).cast("long")
    whole = cut.groupBy("conv_id", "_stretch").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    earlier = Window.partitionBy("conv_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("conv_id", "_stretch", *[F.coalesce(F.bit_xor(x).over(earlier), nil).alias(c) for x, c in (("x1", "_c1"), ("x2", "_c2"))])
    inside = Window.partitionBy("conv_id", "_stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    keyed = cut.select("*", *[F.coalesce(F.bit_xor(x).over(inside), nil).alias(c) for x, c in (("x1", "_i1"), ("x2", "_i2"))])
    return (keyed.join(carried, ["conv_id", "_stretch"])
            .select("conv_id", "block", F.col("_i1").bitwiseXOR(F.col("_c1")).alias("p1"), F.col("_i2").bitwiseXOR(F.col("_c2")).alias("p2"),
                    "x1", "x2", "turns"))


def _turn_nodes(classes: DataFrame, *carry: str) -> DataFrame:
    """One row per turn of each class: depth, its key, its parent's key, words, and ``carry``."""
    def upto(i: Column, h: str, p: str) -> Column:
        return F.aggregate(F.slice("turns", 1, i), F.col(p), lambda a, t: a.bitwiseXOR(t[h]))
    steps = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda i: F.struct(
        F.element_at("turns", i)["depth"].alias("depth"), F.element_at("turns", i)["words"].alias("words"),
        upto(i, "h1", "p1").alias("k1"), upto(i, "h2", "p2").alias("k2"),
        upto(i - 1, "h1", "p1").alias("u1"), upto(i - 1, "h2", "p2").alias("u2")))
    return classes.select(*carry, F.explode(steps).alias("_s")).select(*carry, "_s.*")


def nodes_of(cut: DataFrame) -> DataFrame:
    """All nodes but the root: depth, k1, k2, u1, u2 (parent's key), conv_id (smallest
    member), n_convs, words."""
    classes = stored(cut.groupBy("block", "p1", "p2", "x1", "x2", F.size("turns").alias("_len"))
                     .agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")), "trie-classes")
    siblings = classes.groupBy("block", "p1", "p2").agg(F.count(F.lit(1)).alias("_classes"))
    told = stored(classes.join(siblings, ["block", "p1", "p2"]), "trie-siblings")
    columns = [*KEY, "u1", "u2", "conv_id", "n_convs", "words"]
    straight = _turn_nodes(told.where("_classes = 1"), "conv_id", "n_convs").select(*columns)
    refined = (_turn_nodes(told.where("_classes > 1"), "conv_id", "n_convs").groupBy(*KEY)
               .agg(F.min("u1").alias("u1"), F.min("u2").alias("u2"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
                    F.min("words").alias("words")))
    return straight.unionByName(refined.select(*columns))


def ends_of(convs: DataFrame, cut: DataFrame) -> DataFrame:
    """Key of the node at which each conversation ends; the root's for one without turns."""
    last = cut.groupBy("conv_id").agg(F.max(F.struct(
        "block", F.array_max("turns.depth").alias("depth"), F.col("p1").bitwiseXOR(F.col("x1")).alias("k1"),
        F.col("p2").bitwiseXOR(F.col("x2")).alias("k2"))).alias("e"))
    nil = F.lit(0).cast("long")
    return convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"e.{c}"), nil).alias(c) for c in KEY])


def ends_sha256(ends: DataFrame) -> DataFrame:
    """For each node at which conversations end the SHA-256 of their ids, ascending and
    comma-joined.  Ids are sorted in ranges, joined to chunks where they lie, and the
    chunks of a node are hashed one after the other as a stream."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        out: list[tuple] = []
        names = [*KEY, "first", "ids"]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 4 else pa.int64()) for i in range(5)], names=names)
            out.clear()
            return made

        for b in batches:
            for *k, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                if ids and (k != key or len(ids) == CHUNK_IDS):
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(c)
            if len(out) > 1000:
                yield batch()
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
        yield batch()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        out: list[tuple] = []
        names = [*KEY, "ends_sha256"]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 3 else pa.int64()) for i in range(4)], names=names)
            out.clear()
            return made

        for b in batches:
            for *k, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if k == key:
                    state.update(("," + ids).encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            if len(out) > 1000:
                yield batch()
        if key is not None:
            out.append((*key, state.hexdigest()))
        yield batch()

    longs = "depth long, k1 long, k2 long"
    ranged = ends.select(*KEY, F.col("conv_id").cast("long")).repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    joined = ranged.mapInArrow(chunks, f"{longs}, first long, ids string")
    return (joined.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, f"{longs}, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, every: int = 20, most: int = 4, size: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 of every node."""
    convs, turns = rebuilt(turn_digests(conversations), every, most)
    cut = stored(blocks(turns, size), "trie-blocks")
    nil = F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        *[nil.alias(c) for c in (*KEY, "u1", "u2")], "conv_id", "n_convs", nil.alias("words"))
    nodes = stored(nodes_of(cut).unionByName(root), "trie-nodes")
    ends = stored(ends_of(convs, cut), "trie-ends")

    # children and ends of each node, by one grouping of all there is to count
    own = nodes.select(*KEY, "u1", "u2", "conv_id", "n_convs", "words", nil.alias("_child"), nil.alias("_end"))
    child = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2"), F.lit(1).alias("_child"))
    ending = ends.select(*KEY, F.lit(1).alias("_end"))
    counted = (own.unionByName(child, allowMissingColumns=True).unionByName(ending, allowMissingColumns=True).groupBy(*KEY)
               .agg(*[F.max(c).alias(c) for c in ("u1", "u2", "conv_id", "n_convs", "words")], F.sum("_child").alias("n_children"),
                    F.sum("_end").alias("_ends")))
    counted = stored(counted.withColumn("_saved", (F.col("n_convs") - 1) * F.col("words")), "trie-counted")

    # chains: the nodes of one conversation, from its topmost downwards
    leaf = (F.col("n_children") == 0).cast("long")
    chains = stored(counted.groupBy("conv_id").agg(F.min("depth").alias("_top"), F.sum("_saved").alias("_total"), F.sum(leaf).alias("_leaves")), "trie-chains")
    stretch = F.floor(F.col("depth") / STRETCH).cast("long")
    told = counted.withColumn("_stretch", stretch)
    sums = told.groupBy("conv_id", "_stretch").agg(F.sum("_saved").alias("_s"), F.sum(leaf).alias("_l"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv_id", "_stretch", F.coalesce(F.sum("_s").over(below), nil).alias("_cs"), F.coalesce(F.sum("_l").over(below), nil).alias("_cl"))
    inside = Window.partitionBy("conv_id", "_stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    within = (told.select("*", F.sum("_saved").over(inside).alias("_is"), F.sum(leaf).over(inside).alias("_il"))
              .join(carried, ["conv_id", "_stretch"])
              .select(*KEY, "u1", "u2", "conv_id", "n_convs", "n_children", "_ends",
                      (F.col("_is") + F.col("_cs")).alias("saved"), (F.col("_il") + F.col("_cl")).alias("leaves")))

    # each chain adds its totals to the nodes above its top, by block classes first
    hanging = chains.where("_top > 0")
    above = (cut.join(hanging, "conv_id").where(F.col("block") * size < F.col("_top") - 1)
             .withColumn("_len", F.least(F.size("turns").cast("long"), F.col("_top") - 1 - F.col("block") * size).cast("int"))
             .groupBy("block", "p1", "p2", "x1", "x2", F.size("turns").alias("_all"), "_len")
             .agg(F.sum("_total").alias("saved"), F.sum("_leaves").alias("leaves"), F.first("turns").alias("turns"))
             .withColumn("turns", F.slice("turns", 1, F.col("_len"))))
    added = _turn_nodes(above, "saved", "leaves").select(*KEY, "saved", "leaves")
    to_root = hanging.agg(F.sum("_total").alias("saved"), F.sum("_leaves").alias("leaves")).where("saved is not null").select(
        *[nil.alias(c) for c in KEY], "saved", "leaves")

    gathered = (within.unionByName(added, allowMissingColumns=True).unionByName(to_root, allowMissingColumns=True)
                .unionByName(ends_sha256(ends), allowMissingColumns=True).groupBy(*KEY)
                .agg(*[F.max(c).alias(c) for c in ("u1", "u2", "conv_id", "n_convs", "n_children", "ends_sha256")],
                     F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
    gathered = stored(gathered, "trie-gathered")

    # parents: the root's smallest member is one number; others by a many-to-one join
    top = gathered.where("depth = 0").select("conv_id").first()
    parents = (counted.where("depth > 0 and n_children > 0")
               .select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("_parent")))
    parent = F.when(F.col("depth") == 1, F.lit(top[0] if top else None).cast("long")).otherwise(F.col("_parent").cast("long"))
    return (gathered.join(parents, ["depth", "u1", "u2"], "left")
            .select(F.col("conv_id").cast("long"), "depth", parent.alias("parent_conv_id"), F.col("n_convs").cast("long"),
                    F.col("n_children").cast("long"), F.col("n_leaves").cast("long"), F.col("saved_tokens").cast("long"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
