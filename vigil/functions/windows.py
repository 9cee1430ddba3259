"""Skew-safe keyed scans.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts every row of a key in
one task; a key holding a third of the data then serialises the job.  The
helpers here split each key by time buckets:

* ``trailing_agg``: a bounded trailing window (t - W, t] put together from whole
  seconds and the two parts of seconds at its ends.
* ``with_bucket``: time buckets, split further where a key is busy.
* ``prev_matching``: the latest earlier row of the same key that satisfies
  a predicate, however far back: one summary row per (key, bucket), a
  prefix over those summaries (rows per key = buckets spanned, not events)
  and a within-bucket window.
* ``global_rank``: places in one order over all rows, without a window that
  has no key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ts_ntz


def epoch_micros(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", ts_ntz("1970-01-01 00:00:00"), col)


def trailing_agg(df: DataFrame, keys, ts_col: str, seconds: int, value: Column | None, out: str,
                 how: str = "count") -> DataFrame:
    """Per row, count (or sum of ``value``) over the same key's rows in
    (t - seconds, t]; rows with the same timestamp are peers (included); a row
    without time gets null.

    Rows of a key are summed by microsecond first (map-side), so whatever a key
    does in a second, that second is at most a million rows of one task.  The
    window of time t is three sums that are added, none is taken away (sums of
    doubles stay exact where the parts are): the seconds wholly inside it, from
    one row per key and second in buckets as wide as the window; the part of t's
    own second up to t; and the part after t - W of the second it begins in, for
    which each microsecond asks there."""
    keys = list(keys)
    base = df.withColumn("_k", F.struct(*keys)).withColumn("_us", epoch_micros(ts_col))
    v = F.sum(F.lit(1).cast("long")) if how == "count" else F.sum(value)
    by_us = base.where(F.col("_us").isNotNull()).groupBy("_k", "_us").agg(v.alias("_v"))
    sec, off = F.floor(F.col("_us") / 1_000_000), F.pmod(F.col("_us"), F.lit(1_000_000))
    told = by_us.select("_k", "_us", "_v", sec.alias("_s"), off.alias("_off"))
    # parts of seconds: each row's own second up to it, and what it asks of the second at the window's start
    asks = told.select("_k", "_us", (F.col("_s") - seconds).alias("_s"), "_off", F.lit(True).alias("_asks"))
    both = told.withColumn("_asks", F.lit(False)).unionByName(asks, allowMissingColumns=True)
    one = Window.partitionBy("_k", "_s")
    head = F.sum("_v").over(one.orderBy("_off").rangeBetween(Window.unboundedPreceding, 0))
    tail = F.sum("_v").over(one.orderBy(F.desc("_off")).rangeBetween(Window.unboundedPreceding, -1))
    parts = both.select("_k", "_us", F.when(F.col("_asks"), tail).otherwise(head).alias("_v"))
    # whole seconds, in buckets as wide as the window with the one before as a halo
    whole = told.groupBy("_k", "_s").agg(F.sum("_v").alias("_v")).withColumn("_b", F.floor(F.col("_s") / seconds))
    halo = whole.withColumn("_b", F.col("_b") + 1).withColumn("_halo", F.lit(True))
    inside = Window.partitionBy("_k", "_b").orderBy("_s").rangeBetween(-(seconds - 1), -1)
    middle = (whole.withColumn("_halo", F.lit(False)).unionByName(halo).withColumn("_m", F.sum("_v").over(inside))
              .where(~F.col("_halo")).select("_k", "_s", "_m"))
    summed = (parts.groupBy("_k", "_us").agg(F.sum("_v").alias("_v")).withColumn("_s", sec).join(middle, ["_k", "_s"])
              .select("_k", "_us", (F.col("_v") + F.coalesce("_m", F.lit(0))).alias(out)))
    return base.join(summed, ["_k", "_us"], "left").drop("_k", "_us")


#: Rows of a key's time bucket beyond which it is split further.
BUCKET_ROWS = 500_000


def with_bucket(df: DataFrame, keys, order: str, width: int, rows: int = BUCKET_ROWS, out: str = "_b") -> DataFrame:
    """Ordered bucket numbers per key: ``width`` units of ``order`` each, and a
    bucket with more than ``rows`` rows split evenly into as many as it takes,
    so that a busy key's bucket does not grow with the data."""
    keys = list(keys)
    wide = df.withColumn("_w", F.floor(F.col(order) / F.lit(width)))
    split = (wide.groupBy(*keys, "_w").agg(F.least(F.ceil(F.count(F.lit(1)) / F.lit(rows)), F.lit(1 << 20)).cast("long").alias("_split"))
             .where("_split > 1"))
    sub = F.floor((F.col(order) - F.col("_w") * width) * F.coalesce("_split", F.lit(1)) / F.lit(width)).cast("long")
    return wide.join(split, keys + ["_w"], "left").withColumn(out, F.col("_w") * F.lit(1 << 20) + sub).drop("_w", "_split")


def prev_matching_multi(df: DataFrame, keys, order_us: Column, tie: Column, specs: dict,
                        bucket_us: int = 3600 * 1_000_000, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Several previous-matching lookups in one pass.  ``specs`` maps an
    output prefix to ``(predicate, {name: column})``; for each prefix the
    columns ``<prefix><name>`` hold the values of the latest earlier row of
    the same key (in (order_us, tie) order) satisfying that predicate."""
    keys = list(keys)
    b = with_bucket(df.withColumn("_o", order_us).withColumn("_tie", tie), keys, "_o", bucket_us, bucket_rows)
    tags = []
    for i, (prefix, (pred, values)) in enumerate(specs.items()):
        t = f"_t{i}"
        b = b.withColumn(t, F.when(F.coalesce(pred, F.lit(False)), F.struct(
            F.col("_o").alias("o1"), F.col("_tie").alias("o2"), *[v.alias(n) for n, v in values.items()])))
        tags.append((t, prefix, list(values)))
    # 1) one summary row per (key, bucket holding rows): its latest matches
    summ = b.groupBy(*keys, "_b").agg(*[F.max(t).alias(t + "b") for t, _, _ in tags])
    # 2) prefix over the summaries (rows per key = buckets spanned)
    wp = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*keys, "_b", *[F.max(t + "b").over(wp).alias(t + "c") for t, _, _ in tags])
    # 3) within the bucket: latest earlier match
    wi = Window.partitionBy(*keys, "_b").orderBy("_o", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    r = b.select("*", *[F.max(t).over(wi).alias(t + "i") for t, _, _ in tags]).join(carry, keys + ["_b"], "left")
    drop = ["_o", "_tie", "_b"]
    for t, prefix, names in tags:
        best = F.greatest(F.col(t + "i"), F.col(t + "c"))
        r = r.withColumn(t + "x", best)
        for n in names:
            r = r.withColumn(prefix + n, F.col(t + "x")[n])
        drop += [t, t + "i", t + "c", t + "x"]
    return r.drop(*drop)


def prev_matching(df: DataFrame, keys, order_us: Column, tie: Column, pred: Column, values: dict,
                  bucket_us: int = 3600 * 1_000_000, prefix: str = "prev_") -> DataFrame:
    """Add ``<prefix><name>`` columns holding ``values`` of the latest row of
    the same key strictly before this one in (order_us, tie) order that
    satisfies ``pred`` (null when none).  ``order_us`` is any long ordering
    (epoch micros, or its negation for a *next* lookup)."""
    return prev_matching_multi(df, keys, order_us, tie, {prefix: (pred, values)}, bucket_us)


def running_sum(df: DataFrame, keys, order_col: str, tie_col: str, value: Column, out: str,
                bucket_width: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Running total of ``value`` per key in (order, tie) order, inclusive.

    Buckets of ``bucket_width`` on the (integer) order column: bucket sums
    (one row per key and bucket), a prefix over those sums, plus a running
    sum inside the bucket — so a hot key is split over its buckets."""
    keys = list(keys)
    b = with_bucket(df, keys, order_col, bucket_width, bucket_rows).withColumn("_v", value)
    sums = b.groupBy(*keys, "_b").agg(F.sum("_v").alias("_bs"))
    wp = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_b", F.coalesce(F.sum("_bs").over(wp), F.lit(0)).alias("_carry"))
    wi = Window.partitionBy(*keys, "_b").orderBy(order_col, tie_col).rowsBetween(Window.unboundedPreceding, 0)
    r = b.withColumn("_in", F.sum("_v").over(wi)).join(carry, keys + ["_b"], "left")
    return r.withColumn(out, F.col("_carry") + F.col("_in")).drop("_b", "_v", "_in", "_carry")


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Place of each row (from 1) in ``order``, which must name one order of all
    rows.  Rows are sorted by ranges; a row's place is its place in its range
    plus the rows of the ranges before, of which there is one count each.  The
    sorted rows are written to the shared folder, so that ranges stay as they
    are."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    counts = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = counts.agg(F.collect_list(F.struct("_part", "_n")).alias("_all"))  # one small row: a count per range
    before = parts.select(F.explode("_all").alias("_p"), "_all").select(
        F.col("_p._part").alias("_part"),
        F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + F.when(x["_part"] < F.col("_p._part"), x["_n"]).otherwise(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (sorted_rows.withColumn("_row", inside).join(F.broadcast(before), "_part")
            .withColumn(out, (F.col("_before") + F.col("_row")).cast("int")).drop("_part", "_row", "_before"))
