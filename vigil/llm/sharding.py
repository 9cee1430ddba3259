"""Operator 9: minimax contiguous partition into shards.

Rows with equal texts form an atomic group.  Groups in the order of their
first document are cut into at most ``n`` runs so that the largest run is as
small as possible: binary search for the smallest capacity at which a greedy
pass needs no more than ``n`` shards.

The groups stay distributed.  The driver holds marks only: known group ends,
as sums of sizes before them.  A greedy pass over the marks is feasible, a pass
that may also cut inside the unknown gaps between marks is a bound; where
both agree the capacity is exact.  While they don't, the gaps that a cut may
fall in are looked at 64 times finer.  Marks are bounded by the number of
shards, not by the data.

Edge cases: a null text has size 16 and shares the group of the empty text;
null ids come first; repeated rows are kept; one group larger than its share
gives a larger shard (groups are never split); a very long text is only measured
and summed up; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import running_offsets, stored

SHARDS = 40
#: What a row costs beside its text.
ROW_BYTES = 16
_FINER = 64


class Marks:
    """Known group ends and, for the gap before each, whether groups end inside."""

    def __init__(self, total: int):
        self.total, self.open = total, {}

    def put(self, rows: list[tuple[int, int]]) -> None:
        for end, groups in rows:
            self.open[int(end)] = groups > 1
        self.ends = sorted(self.open)

    def jump(self, at: int, capacity: int, inside: bool) -> int:
        to = at + capacity
        if to >= self.total:
            return self.total
        i = bisect_right(self.ends, to)
        if inside and self.open[self.ends[i]]:
            return to
        return max(at, self.ends[i - 1] if i else 0)

    def cuts(self, capacity: int, n: int, inside: bool) -> list[int]:
        """Ends of the first ``n`` greedy shards."""
        at, out = 0, []
        for _ in range(n):
            at = self.jump(at, capacity, inside)
            out.append(at)
        return out

    def least(self, n: int, inside: bool) -> int:
        lo, hi = max(1, -(-self.total // n)), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            if self.cuts(mid, n, inside)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo


def minimax_cuts(ends: DataFrame, total: int, n: int) -> list[int]:
    """The ``n`` - 1 or fewer cut positions of the least feasible capacity.
    ``ends``: one row per group, its ``end`` in the running sum of sizes."""
    if total == 0:
        return []
    width = 1
    while total // width > 4096:
        width *= _FINER
    marks, within = Marks(total), None
    while True:
        bucket = F.floor((F.col("end") - 1) / F.lit(width)).cast("long")
        part = ends if within is None else ends.where(F.floor((F.col("end") - 1) / F.lit(width * _FINER)).cast("long").isin(within))
        marks.put([tuple(r) for r in part.groupBy(bucket.alias("b")).agg(F.max("end"), F.count(F.lit(1))).drop("b").collect()])
        low, high = marks.least(n, True), marks.least(n, False)
        if low == high or width == 1:
            return [c for c in dict.fromkeys(marks.cuts(high, n, False)) if c < total]
        within = sorted({(e - 1) // width for a, b in zip(marks.cuts(low, n, False), marks.cuts(high, n, True))
                         for e in marks.ends[max(0, bisect_right(marks.ends, a) - 1): bisect_right(marks.ends, b) + 1] if marks.open[e]})
        width //= _FINER


def minimax_shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                              F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(text)).alias("_key")), "shard-rows")
    groups = rows.groupBy("_key").agg(F.sum("size").alias("_size"), F.min("doc_id").alias("_first"))
    ordered = stored(groups.repartitionByRange(F.col("_first").asc_nulls_first(), F.col("_key"))
                     .withColumn("_part", F.spark_partition_id()), "shard-groups")
    totals = ordered.groupBy("_part").agg(F.sum("_size").alias("_n")).withColumn("_all", F.lit(0))
    before = running_offsets(totals, ["_all"], "_part", "_n").drop("_all")
    inside = F.sum("_size").over(Window.partitionBy("_part").orderBy(F.col("_first").asc_nulls_first(), "_key")
                                 .rowsBetween(Window.unboundedPreceding, 0))
    ends = stored(ordered.withColumn("_in", inside).join(before, "_part")
                  .select("_key", (F.col("_before") + F.col("_in")).alias("end")), "shard-ends")
    total = int(ends.agg(F.max("end")).first()[0] or 0)
    cuts = minimax_cuts(ends, total, n)
    shard = sum([(F.col("end") > c).cast("int") for c in cuts], F.lit(0))
    placed = stored(rows.join(ends.select("_key", shard.cast("int").alias("shard")), "_key").drop("_key")
                    .withColumn("_part", F.spark_partition_id()), "shard-placed")
    counts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    row = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32"))
    return (placed.withColumn("_row", row).join(running_offsets(counts, ["shard"], "_part", "_n"), ["shard", "_part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
