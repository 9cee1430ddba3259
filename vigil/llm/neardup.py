"""Operator 2: near-duplicate detection with b-bit MinHash.

Each text's set of word shingles has ``PERMUTATIONS`` minima.  Bands of
``ROWS`` minima are bucket keys; of each minimum the ``BITS`` low bits are kept,
packed into longs.  Two texts that share a bucket are compared by bit counts of
their packed signatures, corrected for chance collisions; those that come near
the threshold are confirmed on their full sets.

Texts with equal sets are one class, so copies never meet each other.  Links
are looked for in two steps:

1. every class with the heads (least members) of its buckets;
2. in buckets that still hold several components, members of different
   components with each other, in blocks of ``BLOCK``, by a wide signature of
   ``WIDE`` minima that leaves few pairs to confirm.

No step emits all pairs of a group that is alike: after step 1 such a group is
one component.  With 32 bands of 4, a pair at the threshold is missed with a
chance of 5e-6, one turned away by a signature with about 3e-6.

Edge cases: a null or empty text and one without words have the empty set and
are linked with nothing; a null id has no component and is kept (but see
:func:`without_near_duplicates`); repeated ids are judged by their own texts;
a very long text is hashed whole, in scratch memory of some 36 bytes a byte; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm import textops as X
from vigil.llm.common import maybe_broadcast, small_batches, stored
from vigil.llm.components import connected_components

SHINGLE = 5
PERCENT = 75
PERMUTATIONS, ROWS, BITS = 128, 4, 2
BANDS = PERMUTATIONS // ROWS
#: Pairs whose estimate is lower than this can't reach the threshold: 4.5
#: standard deviations of the estimate below it.
ESTIMATE = 0.54
BLOCK = 256
#: Minima of a wide signature, and the estimate from it 4.5 deviations below.
WIDE, WIDE_ESTIMATE = 4096, 0.713

_LONGS = PERMUTATIONS * BITS // 64
_FEW = 1 << 18  # products at a time


def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1))[:, None], rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]


_NARROW_PERMUTATIONS, _WIDE_PERMUTATIONS = _permutations(PERMUTATIONS, 20240607), _permutations(WIDE, 20240608)
_BAND = X._mix(np.arange(1, BANDS + 1, dtype=np.uint64) * X.U64(0x9E3779B97F4A7C15))


def minima(shingles: np.ndarray, permutations: tuple[np.ndarray, np.ndarray] = _NARROW_PERMUTATIONS) -> np.ndarray:
    """The least hash of a set of shingles under each permutation."""
    factor, shift = permutations
    h = ((shingles >> X.U64(32)) ^ shingles).astype(np.uint32)
    least = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    step = _FEW // len(factor)
    for k in range(0, len(h), step):
        x = h[None, k: k + step] * factor
        x += shift
        np.minimum(least, x.min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, packed into longs: bit i of long j holds
    lane (j mod lanes, i) of bit j // lanes, so lanes line up across longs."""
    low = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)  # the minima's own low bits, spread
    planes = [np.packbits(((low >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), bitorder="little") for b in range(BITS)]
    return np.concatenate(planes).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    h = _BAND.copy()
    for r in range(ROWS):
        h = X._mix(h ^ rows[:, r])
    return X.as_long(h)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest, sig, bands = [], [], [], []
        for s in X.shingle_sets(batch.column(1), SHINGLE):
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            least = minima(s)
            sig.append(packed(least))
            bands.append(band_keys(least))
        rows = len(n)
        offs = np.arange(rows + 1, dtype=np.int32)
        flat = lambda parts, width: pa.ListArray.from_arrays(pa.array(offs * width, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), flat(sig, _LONGS), flat(bands, BANDS)],
                                         names=["doc_id", "text_hash", "n_shingles", "digest", "sig", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the set, packed signature, band keys."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _signatures, f"doc_id {kind}, text_hash bigint, n_shingles bigint, digest binary, sig array<bigint>, bands array<bigint>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: lanes that agree in all bits,
    corrected for those that agree by chance."""
    per = _LONGS // BITS
    differ = F.lit(0)
    for j in range(per):
        lane = F.lit(0).cast("long")
        for k in range(BITS):
            lane = lane.bitwiseOR(F.get(a, F.lit(j + k * per)).bitwiseXOR(F.get(b, F.lit(j + k * per))))
        differ = differ + F.bit_count(lane)
    agree = 1 - differ / F.lit(PERMUTATIONS)
    chance = 1 / (1 << BITS)
    return (agree - chance) / (1 - chance)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cid, blob = [], []
        want = batch.column(2).to_pylist()
        ids = batch.column(0).to_pylist()
        for i, s in enumerate(X.shingle_sets(batch.column(1), SHINGLE)):
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == want[i]:
                cid.append(ids[i])
                blob.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(blob, pa.binary())], names=["cid", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    return stored(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_linked, "a bigint, b bigint"),
                  "confirmed-links")


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
        wide = [packed(minima(s, _WIDE_PERMUTATIONS)).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(wide, pa.binary()), batch.column(2)],
                                         names=["cid", "n", "wide", "bands"])


def _block_pairs(group: pa.Table) -> pa.Table:
    """Pairs of one block pair of a bucket that are in different components
    and whose sizes and wide signatures come near the threshold.  A pair that
    shares several buckets is looked at in that of its first common band."""
    group = group.combine_chunks()
    cid, comp, size = (group[c].to_numpy() for c in ("cid", "component", "n"))
    block, i, j = group["block"].to_numpy(), group["i"][0].as_py(), group["j"][0].as_py()
    sig = np.frombuffer(b"".join(group["wide"].to_pylist()), np.uint64).reshape(len(cid), -1)
    p, q = np.flatnonzero(block == i), np.flatnonzero(block == j)
    near = (comp[p][:, None] != comp[q][None, :]) & (100 * np.minimum(size[p][:, None], size[q][None, :]) >= PERCENT * np.maximum(size[p][:, None], size[q][None, :]))
    if i == j:
        near &= cid[p][:, None] < cid[q][None, :]
    x, y = np.nonzero(near)
    bands = np.array(group["bands"].to_pylist(), np.int64).reshape(len(cid), BANDS)
    here = int(np.argmax(bands[0] == group["key"][0].as_py()))
    earlier = np.zeros(len(x), bool)
    for k in range(here):
        earlier |= bands[p[x], k] == bands[q[y], k]
    x, y = x[~earlier], y[~earlier]
    per = WIDE // 64
    differ = np.zeros(len(x), np.int64)
    for k in range(per):
        lane = np.zeros(len(x), np.uint64)
        for b in range(BITS):
            column = sig[:, k + b * per]
            lane |= column[p[x]] ^ column[q[y]]
        differ += np.bitwise_count(lane)
    chance = 1 / (1 << BITS)
    keep = (1 - differ / WIDE - chance) / (1 - chance) >= WIDE_ESTIMATE
    a, b = cid[p[x[keep]]], cid[q[y[keep]]]
    return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every document."""
    signed = stored(signatures(docs), "signatures")
    classes = stored(signed.where("n_shingles > 0 and doc_id is not null").groupBy("digest")
                     .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
                     .withColumn("cid", F.monotonically_increasing_id()), "classes")
    keys = classes.select("cid", F.explode("bands").alias("key"))
    crowded = keys.groupBy("key").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(keys.join(crowded, "key"), "bucket-members")

    needed = members.select("cid").distinct().join(classes.select("cid", "rep", "digest"), "cid").select("cid", F.col("rep").alias("doc_id"), "digest")
    needed = maybe_broadcast(stored(needed, "needed-sets"))
    whole = docs.select("doc_id", "text").join(needed, "doc_id").select("cid", "text", "digest")
    sets = stored(whole.mapInArrow(_sets, "cid bigint, shingles binary").dropDuplicates(["cid"]), "shingle-sets")

    sig = classes.select("cid", "sig")
    stars = (members.where("cid <> head").select(F.col("cid").alias("a"), F.col("head").alias("b")).distinct()
             .join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a")
             .join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b")
             .where(estimate(F.col("sa"), F.col("sb")) >= ESTIMATE).select("a", "b"))
    grouped = stored(connected_components(confirmed(stars, sets)).select(F.col("node").alias("cid"), "component"), "components-of-stars")
    label = F.coalesce("component", "cid").alias("component")

    inside = stored(members.where("n > 2").join(grouped, "cid", "left").select("key", "cid", "n", label), "crowded-members")
    mixed = inside.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    mixed = stored(inside.join(mixed, "key", "left_semi").withColumnRenamed("n", "members"), "mixed-members")
    wide = stored(sets.join(mixed.select("cid").distinct(), "cid", "left_semi").join(classes.select("cid", "bands"), "cid")
                  .select("cid", "shingles", "bands").mapInArrow(_widened, "cid bigint, n bigint, wide binary, bands array<bigint>"), "wide-signatures")
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    spread = (mixed.join(wide, "cid").withColumn("blocks", blocks)
              .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
              .select("key", "cid", "component", "n", "wide", "bands", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
              .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    rest = stored(spread.groupBy("key", "i", "j").applyInArrow(_block_pairs, "a bigint, b bigint").distinct(), "residual-pairs")
    # links between components found so far, then the components of these
    far = confirmed(rest, sets)
    for side in ("a", "b"):
        far = far.join(grouped.withColumnRenamed("cid", side), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
    outer = connected_components(far).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    named = (classes.select("cid", "digest", "rep").join(grouped, "cid", "left").select("digest", "rep", label)
             .join(outer, "component", "left").select("digest", "rep", F.coalesce("whole", "component").alias("component")))
    named = stored(named, "class-components")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_digest = named.join(least, "component").select("digest", "component_id")
    out = signed.select("doc_id", "text_hash", "n_shingles", "digest").join(by_digest, "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group, as it is: the one with the least id (null ids
    last) and, of equal ids, the least text hash.  Texts are judged by id and
    hash together, so rows that share an id, or have none, are members of
    groups like others.  Rows without shingles are in no group; of those with
    equal id and text one stays, and all with a null id.  The texts are
    shuffled only if the list of dropped rows measures too large for a broadcast."""
    none = F.lit("0").cast(docs.schema["doc_id"].dataType)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", none).alias("id"), F.xxhash64("text").alias("hash"))
    judged = stored(near_duplicates(docs.select(row.alias("doc_id"), "text")), "near-duplicates")
    rows = judged.groupBy(F.col("doc_id").alias("_row")).agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("shingles"))
    rows = stored(rows.where("not kept or (n > 1 and (not _row.none or shingles > 0))"), "near-duplicate-rows")
    gone, repeated = maybe_broadcast(rows.select("_row")), maybe_broadcast(rows.where("kept").select("_row"))
    own = docs.withColumn("_row", row)
    once = own.join(repeated, "_row", "left_semi").dropDuplicates(["_row"])
    return own.join(gone, "_row", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
