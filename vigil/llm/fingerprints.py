"""Operator 8: bottom-k sketches of shingle hashes as document fingerprints.

A fingerprint holds the ``K`` least hashes of a text's distinct word shingles
(all of them, if there are fewer).  Fingerprints of parts merge into that of
the whole; two of them estimate resemblance and containment, one the number of
distinct shingles.

:func:`with_neighbours` compares each text with an edited form of itself and
with the next document.  "Next" is by ascending id over the whole table, so
documents are dealt by ranges of ids; the first document of each range is sent
to the range before it as well (and the very first to the last), and each range
is streamed in order.  Texts are shuffled once.  One id for each range passes
through the driver, as in any range partitioning.

Edge cases: a null text is an empty one; texts without words have the empty
fingerprint, and two of these have likeness 1; null ids come first; of equal
ids the order is by text, repeated rows follow each other; a table of one
document has itself as the next; rows of one id are one range, which is streamed;
a very long text is held whole in one task and hashed by segments; an empty table gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import textops as X
from vigil.llm.common import part_count, small_batches

K = 128
SHINGLE = 5
PART_BYTES, LEAST_PARTS = 16 << 20, 12

_DROP = X.U64(16)  # a sketch keeps the high 48 bits of a hash


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` least of sorted distinct shingle hashes."""
    return np.unique(shingles[: k + 8] >> _DROP)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles; exact while the union has at most k."""
    union = merge(a, b, k)
    if len(union) == 0:
        return 1.0
    return len(np.intersect1d(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True)) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1] + X.U64(1)) / 2.0**48)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if len(a) == 0:
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()).decode("ascii")


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :6] = raw
    return full.view("<u8").reshape(-1).astype(np.uint64)


def sketches(texts: list[str]) -> list[np.ndarray]:
    return [sketch(s) for s in X.shingle_sets(pa.array(texts, pa.string()), SHINGLE)]


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the start of the following."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _range_of(spark: SparkSession, starts: list) -> Callable[[Column], Column]:
    """For an id the range it falls in and whether it is the range's start.  The
    starts (null first, if it is one) travel as a broadcast variable, so the plan
    has the same size for any number of them."""
    shared = spark.sparkContext.broadcast(starts)

    @F.arrow_udf("part int, first boolean")
    def place(ids: pa.Array) -> pa.Array:
        held = shared.value
        nulls = int(held[0] is None)
        at = [0 if i is None else bisect_right(held, i, nulls) - 1 for i in ids.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array([i == held[k] for i, k in zip(ids.to_pylist(), at)], pa.bool_())], names=["part", "first"])
    return place


def in_ranges(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, part, ahead): every document in the part of its id range,
    in order, and the first of the next part after them with ``ahead`` = 1."""
    ids = docs.select("doc_id")
    found = (ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).groupBy(F.spark_partition_id())
             .agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("none")).collect())
    starts = ([None] if any(r["none"] for r in found) else []) + sorted({r["first"] for r in found if r["first"] is not None})
    n = max(1, len(starts))
    own = docs.select("doc_id", "text", _range_of(docs.sparkSession, starts or [None])(F.col("doc_id")).alias("_at"))
    here = F.struct(F.col("_at.part").alias("part"), F.lit(0).alias("ahead"))
    before = F.struct(F.pmod(F.col("_at.part") - 1, F.lit(n)).cast("int").alias("part"), F.lit(1).alias("ahead"))
    dealt = own.select("doc_id", "text", F.explode(F.when(F.col("_at.first"), F.array(here, before)).otherwise(F.array(here))).alias("to"))
    return (dealt.select("doc_id", "text", "to.part", "to.ahead").repartition(n, "part")
            .sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit(""))))


def _rows(pairs: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """Result rows of (id, text, sketch, following text, following sketch)."""
    changed = [edited(t, u) for _, t, _, u, _ in pairs]
    own = [(s, e, v) for (_, _, s, _, v), e in zip(pairs, sketches(changed))]
    return pa.RecordBatch.from_arrays([
        pa.array([p[0] for p in pairs], kind), pa.array([len(p[1]) for p in pairs], pa.int64()),
        pa.array([hashlib.sha256(c.encode("utf-8", "replace")).hexdigest() for c in changed], pa.string()),
        pa.array([to_text(s) for s, _, _ in own], pa.string()), pa.array([to_text(e) for _, e, _ in own], pa.string()),
        pa.array([resemblance(s, e) for s, e, _ in own], pa.float64()), pa.array([resemblance(s, v) for s, _, v in own], pa.float64())],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting = None  # the last document of the part so far
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        pairs = []
        for doc_id, text, part, ahead, s in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), sketches(texts)):
            if waiting is not None and waiting[3] == part:
                pairs.append((waiting[0], waiting[1], waiting[2], text, s))
            waiting = None if ahead else (doc_id, text, s, part)
        if pairs:
            yield _rows(pairs, batch.schema.field(0).type)


def with_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next for every document."""
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = in_ranges(own, max(LEAST_PARTS, part_count(own, "text", PART_BYTES)))
    return ordered.mapInArrow(_streamed, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
                                         "edited_fingerprint string, near_edited double, near_next double")
