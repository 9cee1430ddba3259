"""Table-state operators on Parquet snapshots.

Parquet has no UPDATE/MERGE, so every mutating statement of the reference
becomes a pure function old snapshot -> new snapshot, written to a new
directory (atomic switch by path).  All of them are keyed joins or keyed
aggregates: no ordering over the whole table, no driver round trip.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import py_fixed, ts_ntz

RULE_KEY = ["workflow_id", "task_type", "tenant_id", "scope_pattern"]


def stable_id(*cols):
    """Identifier for rows created by a job: 60 bits of the MD5 of the natural
    key (reruns give the same id, any engine can compute it; no driver-side
    counter).  A null part counts as the record separator."""
    parts = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in cols])
    return F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("long")


def append(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    """Append rows (job commit protocol makes the append atomic)."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def append_returning(df: DataFrame, path: str, *columns: str) -> DataFrame:
    """Append rows and return ``columns`` of exactly these rows, as they were
    written.  ``df`` is computed once; the batch is a partition of the table, so
    reading it back touches its files only."""
    batch = uuid.uuid4().hex
    df.withColumn("_batch", F.lit(batch)).write.mode("append").partitionBy("_batch").parquet(path)
    return df.sparkSession.read.parquet(path).where(F.col("_batch") == batch).select(*columns)


def upsert_rules(existing: DataFrame, incoming: DataFrame, as_of: _dt.datetime,
                 order_col: str | None = None) -> DataFrame:
    """A10 + H12: ``INSERT ... ON CONFLICT (4-key) DO UPDATE SET
    constraints, enabled, updated_at = now``.

    Incoming rows are first reduced to one per key (the last by
    ``order_col`` when given); then a full outer join on the key (one row
    per key on each side) builds the new snapshot.  Matched rows keep id
    and created_at, take the new constraints/enabled and are stamped
    ``as_of``; new keys get a key-hash id."""
    now = ts_ntz(as_of)
    inc = incoming
    if order_col:
        inc = (inc.groupBy(*RULE_KEY)
               .agg(F.max_by(F.struct("constraints", "enabled"), F.col(order_col)).alias("_v"))
               .select(*RULE_KEY, "_v.*"))
    else:
        inc = inc.select(*RULE_KEY, "constraints", "enabled").dropDuplicates(RULE_KEY)
    inc = inc.select(*RULE_KEY, F.col("constraints").alias("_nc"), F.col("enabled").alias("_ne"),
                     F.lit(True).alias("_hit"))
    j = existing.join(inc, RULE_KEY, "full_outer")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(
        F.coalesce(F.col("id"), stable_id(*RULE_KEY)).alias("id"),
        *RULE_KEY,
        F.when(hit, F.coalesce(F.col("_nc"), F.lit("{}"))).otherwise(F.col("constraints")).alias("constraints"),
        F.when(hit, F.coalesce(F.col("_ne"), F.lit(True))).otherwise(F.col("enabled")).alias("enabled"),
        F.coalesce(F.col("created_at"), now).alias("created_at"),
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"))


def upsert_cursor(old: DataFrame, new: DataFrame, as_of: _dt.datetime, key: str = "key",
                  value: str = "last_seen_internal_date") -> DataFrame:
    """Keep the greater cursor per key (``GREATEST(old, new)``),
    stamping keys touched by the new batch."""
    o = old.select(key, value, F.col("updated_at"), F.lit(False).alias("_new"))
    n = new.select(key, value, ts_ntz(as_of).alias("updated_at"), F.lit(True).alias("_new"))
    return (o.unionByName(n).groupBy(key)
            .agg(F.max(value).alias(value),
                 F.max_by("updated_at", F.col("_new").cast("int")).alias("updated_at")))


def seed_if_absent(existing: DataFrame, task_types, as_of: _dt.datetime) -> DataFrame:
    """One ``('*', type, '*', '*', '{}', true)`` rule per static task
    type unless the key already exists (``ON CONFLICT DO NOTHING``).
    Returns the rows to append."""
    spark = existing.sparkSession
    seeds = spark.createDataFrame([(t,) for t in task_types], "task_type string").select(
        F.lit("*").alias("workflow_id"), "task_type", F.lit("*").alias("tenant_id"),
        F.lit("*").alias("scope_pattern"))
    rows = seeds.join(existing.select(*RULE_KEY), RULE_KEY, "left_anti")
    now = ts_ntz(as_of)
    return rows.select(stable_id(*RULE_KEY).alias("id"), *RULE_KEY, F.lit("{}").alias("constraints"),
                       F.lit(True).alias("enabled"), now.alias("created_at"), now.alias("updated_at"))


def delete_by_key(existing: DataFrame, deletes: DataFrame) -> DataFrame:
    """The snapshot without the rows matching a delete request."""
    return existing.join(deletes.select(*RULE_KEY).distinct(), RULE_KEY, "left_anti")


def new_since_cursor(items: DataFrame, cursor: DataFrame, key: str = "inbox", ts_col: str = "internal_date",
                     cursor_key: str = "key", cursor_col: str = "last_seen_internal_date") -> DataFrame:
    """A14 / J3 (batch): ``NEW`` iff the item's date is not 0 and greater
    than the stored high-water mark, else ``SKIP_OLD``.  The mark is a
    scalar subquery (one value), not a join."""
    mark = cursor.where(F.col(cursor_key) == key).agg(F.max(cursor_col)).scalar()
    d = F.col(ts_col)
    is_new = (d != 0) & (d > F.coalesce(mark, F.lit(0)))
    return items.withColumn("status", F.when(is_new, "NEW").otherwise("SKIP_OLD"))


def advance_cursor(items: DataFrame, cursor: DataFrame, as_of: _dt.datetime, key: str = "inbox",
                   ts_col: str = "internal_date") -> DataFrame:
    """New cursor snapshot after a batch (max of old and new)."""
    batch_max = items.agg(F.max(ts_col).alias("last_seen_internal_date")).select(
        F.lit(key).alias("key"), "last_seen_internal_date")
    return upsert_cursor(cursor, batch_max.where(F.col("last_seen_internal_date").isNotNull()), as_of)


def metrics_exposition(counters: DataFrame) -> DataFrame:
    """Text exposition lines (one row per line, in order) from the
    one-row decision counters of C11."""
    c = F.col
    lines = F.array(
        F.lit("# HELP executor_policy_decisions_total Total number of policy decisions"),
        F.lit("# TYPE executor_policy_decisions_total counter"),
        F.format_string('executor_policy_decisions_total{decision="allow"} %d', c("allow")),
        F.format_string('executor_policy_decisions_total{decision="deny"} %d', c("deny")),
        F.format_string('executor_policy_decisions_total{decision="requires_approval"} %d', c("requires_approval")),
        F.lit("# HELP executor_policy_eval_errors_total Total number of policy evaluation errors"),
        F.lit("# TYPE executor_policy_eval_errors_total counter"),
        F.format_string("executor_policy_eval_errors_total %d", c("errors")),
        F.lit("# HELP executor_policy_eval_latency_ms_sum Sum of policy evaluation latency in ms"),
        F.lit("# TYPE executor_policy_eval_latency_ms_sum counter"),
        F.concat(F.lit("executor_policy_eval_latency_ms_sum "), py_fixed(c("latency_sum"), 3)))
    return counters.select(F.posexplode(lines).alias("line_no", "line"))


def write_text_lines(lines: DataFrame, path: str) -> None:
    """A16 sink: one text file of ordered lines (the exposition is a handful
    of lines, so one output file is the format, not a bottleneck)."""
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)


def newest_sample(df: DataFrame, n: int = 5000, min_rows: int | None = None, ts_col: str = "created_at",
                  id_col: str = "id") -> DataFrame:
    """A2: the newest ``n`` rows (a top-n sample, planned as
    TakeOrderedAndProject).  If ``min_rows`` is given, the job fails on a
    table with fewer rows (the reference falls back to generated data; here there
    is no fallback).  The guard is a scalar subquery evaluated with the
    job, not a driver-side count."""
    newest = df.orderBy(F.col(ts_col).desc(), F.col(id_col).asc()).limit(n)
    if min_rows is None:
        return newest
    total = df.agg(F.count(F.lit(1))).scalar()
    guarded_id = F.when(total < min_rows, F.raise_error(
        F.concat(F.lit(f"newest_sample: fewer than {min_rows} rows: "), total.cast("string")))
    ).otherwise(F.col(id_col))
    # the guard rides on the id column so it cannot be pruned away
    return newest.withColumn(id_col, guarded_id)
