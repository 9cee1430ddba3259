"""Connected components as DataFrame rounds (large star and small star).

Every round is two aggregates with map-side combine and two joins back to the
edge table; a node with very many neighbours is a skewed join key, which
adaptive execution splits, never a collected list.  Each round is written to
the shared folder, so a lost executor repeats at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored


def _round(edges: DataFrame) -> DataFrame:
    """edges(a, b) with a > b, distinct -> the edges after one large star and
    one small star."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .where("a > b").distinct())
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(low, "a")
    small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return small.where("a > b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that an edge touches; the component is
    its least node.  Null ends and loops are ignored."""
    now = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                 .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "components")
    while not _settled(now):
        now = stored(_round(now), "components")
    # settled: every edge joins a node to its component's least node
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge, to a node that has none downwards."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
    return odd.limit(1).count() == 0
