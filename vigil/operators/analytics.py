"""Policy analytics (F1-F5), memory/audit monitoring (G1-G8) and the
example analytics (L1-L5).

``NOW()`` in the reference queries becomes the ``as_of`` parameter so that
results are reproducible.  All aggregates are partial/final hash aggregates
(map-side combine), so a hot group key costs one row per map task in the
shuffle, not one row per event.
"""

from __future__ import annotations

import datetime as _dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import AS_OF, days_before, json_str, pct, py_fixed, trunc_hour_ntz

GATED_ACTIONS = ("executor_run", "memory_write")


def _gated(audit: DataFrame, as_of: _dt.datetime, days: int) -> DataFrame:
    return audit.where((F.col("created_at") >= days_before(as_of, days))
                       & F.col("action").isin(*GATED_ACTIONS))


# ---------------------------------------------------------------- F1-F5
def decision_distribution(audit: DataFrame, as_of: _dt.datetime = AS_OF, days: int = 7) -> DataFrame:
    """decisions of gated actions in the trailing window, most frequent first."""
    return (_gated(audit, as_of, days).groupBy("decision")
            .agg(F.count(F.lit(1)).alias("events"))
            .orderBy(F.desc("events"), F.asc_nulls_last("decision")))


def approval_rate_by_day(audit: DataFrame, as_of: _dt.datetime = AS_OF, days: int = 14) -> DataFrame:
    """requires-approval count, total and rate per day."""
    n_req = F.count_if(F.col("decision") == "requires_approval")
    n = F.count(F.lit(1))
    return (_gated(audit, as_of, days)
            .groupBy(F.to_date("created_at").alias("day"))
            .agg(n_req.alias("requires_approval_count"), n.alias("total_count"),
                 pct(n_req, n).alias("requires_approval_rate_pct"))
            .orderBy(F.desc("day")))


def deny_rate_by_scope(audit: DataFrame, as_of: _dt.datetime = AS_OF, days: int = 14,
                       min_events: int = 5) -> DataFrame:
    """denied share per target scope, scopes with at least ``min_events``."""
    n_den = F.count_if(F.col("decision") == "denied")
    n = F.count(F.lit(1))
    return (_gated(audit, as_of, days)
            .groupBy(F.col("target").alias("scope"))
            .agg(n_den.alias("denied_count"), n.alias("total_count"),
                 pct(n_den, n).alias("denied_rate_pct"))
            .where(F.col("total_count") >= min_events)
            .orderBy(F.desc_nulls_first("denied_rate_pct"), F.desc("total_count"),
                     F.asc_nulls_last("scope")))


def policy_unavailable_by_day(audit: DataFrame, as_of: _dt.datetime = AS_OF, days: int = 14) -> DataFrame:
    """fallback / policy_unavailable signals in the payload text per day."""
    sig = F.col("payload").ilike("%policy_unavailable%") | F.col("payload").ilike("%fallback%")
    return (_gated(audit, as_of, days)
            .groupBy(F.to_date("created_at").alias("day"))
            .agg(F.count_if(sig).alias("policy_unavailable_events"),
                 F.count(F.lit(1)).alias("total_policy_events"))
            .orderBy(F.desc("day")))


def approval_sla(audit: DataFrame, limit: int | None = 200) -> DataFrame:
    """first approval request vs first approval per request id, in seconds.

    Two partial aggregates keyed by request id, then one left equi-join on
    that key: both sides are already hash-partitioned by it, so the join
    adds no extra exchange.  Sorted newest request first; ``limit`` is the
    report size of the reference query (``None`` for all).
    """
    rid = json_str("payload", "request_id")
    requests = (audit.where((F.col("decision") == "requires_approval") & rid.isNotNull() & (rid != ""))
                .groupBy(rid.alias("req_id"))
                .agg(F.min("created_at").alias("requested_at")))
    akey = F.coalesce(F.col("target"), rid)
    approvals = (audit.where((F.col("action") == "policy_approval") & akey.isNotNull() & (akey != ""))
                 .groupBy(akey.alias("req_id"))
                 .agg(F.min("created_at").alias("approved_at")))
    out = (requests.join(approvals, "req_id", "left")
           .select(F.col("req_id").alias("request_id"), "requested_at", "approved_at",
                   (F.timestamp_diff("MICROSECOND", F.col("requested_at"), F.col("approved_at"))
                    / F.lit(1e6)).alias("approval_latency_seconds"))
           .orderBy(F.desc("requested_at"), F.asc("request_id")))
    return out.limit(limit) if limit is not None else out


# ---------------------------------------------------------------- G1-G8
def storage_stats(vectors: DataFrame, approx: bool = False) -> DataFrame:
    """G1: vector count, distinct tenants and scopes, oldest/newest.

    ``approx`` switches to HyperLogLog distinct counts (no per-key state)."""
    cd = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.countDistinct(c))
    return vectors.agg(F.count(F.lit(1)).alias("total_vectors"),
                       cd("tenant_id").alias("unique_tenants"),
                       cd("scope").alias("unique_scopes"),
                       F.min("created_at").alias("oldest_vector"),
                       F.max("created_at").alias("newest_vector"))


#: Buckets of a distinct-count sketch as a power of two: a relative error of 1.6 %.
SKETCH_LG = 12


def hourly_sketches(vectors: DataFrame, lg: int = SKETCH_LG) -> DataFrame:
    """G1/G2 at scale: one row per hour and scope with what merges over any range:
    counts, first and last time, and HyperLogLog sketches of tenants and contents.
    Written once per hour, it stands for the vectors in every later report; a
    sketch is at most 2 ** ``lg`` bytes whatever it counts."""
    return (vectors.groupBy(trunc_hour_ntz("created_at").alias("hour"), "scope")
            .agg(F.count(F.lit(1)).alias("vectors"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
                 F.hll_sketch_agg("tenant_id", F.lit(lg)).alias("tenants"), F.hll_sketch_agg("content_hash", F.lit(lg)).alias("contents")))


def _merged_sketches(sketches: DataFrame, since: Column | None, until: Column | None) -> DataFrame:
    if since is not None:
        sketches = sketches.where(F.col("hour") >= since)
    return sketches if until is None else sketches.where(F.col("hour") < until)


def sketched_storage_stats(sketches: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """G1 from stored :func:`hourly_sketches`: distinct tenants and contents are
    estimates (within 5 % at three standard errors), all else is exact."""
    s = _merged_sketches(sketches, since, until)
    return s.agg(F.coalesce(F.sum("vectors"), F.lit(0)).alias("total_vectors"),
                 F.hll_sketch_estimate(F.hll_union_agg("tenants")).alias("unique_tenants"),
                 F.countDistinct("scope").alias("unique_scopes"),
                 F.hll_sketch_estimate(F.hll_union_agg("contents")).alias("unique_contents"),
                 F.min("first_seen").alias("oldest_vector"), F.max("last_seen").alias("newest_vector"))


def sketched_top_scopes(sketches: DataFrame, n: int = 10, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """G2 from stored :func:`hourly_sketches`, with the distinct contents of each scope (estimate)."""
    return (_merged_sketches(sketches, since, until).groupBy("scope")
            .agg(F.sum("vectors").alias("vector_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
                 F.hll_sketch_estimate(F.hll_union_agg("contents")).alias("unique_contents"))
            .orderBy(F.desc("vector_count"), F.asc_nulls_last("scope")).limit(n))


def top_scopes(vectors: DataFrame, n: int = 10) -> DataFrame:
    """Scopes with the most vectors, first/last seen (top-n report)."""
    return (vectors.groupBy("scope")
            .agg(F.count(F.lit(1)).alias("vector_count"),
                 F.min("created_at").alias("first_seen"),
                 F.max("created_at").alias("last_seen"))
            .orderBy(F.desc("vector_count"), F.asc_nulls_last("scope"))
            .limit(n))


def recent_vectors(vectors: DataFrame, as_of: _dt.datetime = AS_OF, hours: int = 24) -> DataFrame:
    """Vectors created strictly after ``as_of - hours``."""
    since = days_before(as_of, 0) - F.make_dt_interval(hours=F.lit(hours))
    return vectors.where(F.col("created_at") > since).agg(F.count(F.lit(1)).alias("vectors_last_24h"))


def hourly_ingest(vectors: DataFrame, as_of: _dt.datetime = AS_OF, days: int = 7, n: int = 24) -> DataFrame:
    """Vectors per hour over the trailing window, newest ``n`` hours."""
    return (vectors.where(F.col("created_at") > days_before(as_of, days))
            .groupBy(trunc_hour_ntz("created_at").alias("hour"))
            .agg(F.count(F.lit(1)).alias("vectors_ingested"))
            .orderBy(F.desc("hour")).limit(n))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Events, distinct targets and last event per action."""
    return (audit.groupBy("action")
            .agg(F.count(F.lit(1)).alias("event_count"),
                 F.countDistinct("target").alias("unique_targets"),
                 F.max("created_at").alias("last_event"))
            .orderBy(F.desc("event_count"), "action"))


def _guarded_pct(num, den):
    return F.when(den > 0, F.round(F.lit(100.0) * num.cast("double") / den.cast("double"), 2)).otherwise(F.lit(0.0))


def table_health(stats: DataFrame) -> DataFrame:
    """Dead-tuple, cache-hit and index-usage percentages, guarded for 0."""
    c = F.col
    return stats.select(
        c("relname").alias("table_name"),
        c("n_live_tup").alias("live_tuples"), c("n_dead_tup").alias("dead_tuples"),
        _guarded_pct(c("n_dead_tup"), c("n_live_tup")).alias("dead_tuple_pct"),
        _guarded_pct(c("heap_blks_hit"), c("heap_blks_hit") + c("heap_blks_read")).alias("cache_hit_ratio_pct"),
        _guarded_pct(c("idx_scan"), c("seq_scan") + c("idx_scan")).alias("index_usage_pct"))


def health_alerts(stats: DataFrame) -> DataFrame:
    """The three alert checks per relation, one pass + ``stack``."""
    c = F.col
    dead = F.when(c("n_dead_tup") > c("n_live_tup") * 0.2,
                  "WARNING: Dead tuples exceed 20% of live tuples - consider VACUUM").otherwise("OK")
    unused = F.when((c("idx_scan") == 0) & (c("n_live_tup") > 1000),
                    "WARNING: Index not being used despite large table - check queries").otherwise("OK")
    blks = c("heap_blks_hit") + c("heap_blks_read")
    cache = F.when((blks > 0) & (c("heap_blks_hit").cast("double") / blks < 0.95),
                   "WARNING: Cache hit ratio below 95% - consider more RAM").otherwise("OK")
    checks = F.array(
        F.struct(F.lit("dead_tuples_high").alias("alert_type"), dead.alias("status")),
        F.struct(F.lit("index_not_used").alias("alert_type"), unused.alias("status")),
        F.struct(F.lit("cache_hit_low").alias("alert_type"), cache.alias("status")))
    return (stats.select(c("relname").alias("table_name"), F.inline(checks)))


def top_indexes(index_stats: DataFrame, like: str = "%embedding%", n: int = 10) -> DataFrame:
    """Most used indexes whose name matches ``like`` (top-n report)."""
    return (index_stats.where(F.col("index_name").like(like))
            .orderBy(F.desc("index_scans"), "index_name").limit(n))


# ---------------------------------------------------------------- L1-L5
def rolling_mean(daily: DataFrame, col: str = "sales", rows: int = 7) -> DataFrame:
    """L1: ``rows``-row rolling mean, null until the window is full.

    The input is one row per calendar day (already aggregated), so the
    ordered window is bounded by the calendar, not by the data volume."""
    w = Window.orderBy("date").rowsBetween(-(rows - 1), 0)
    return daily.select("date", col,
                        F.when(F.count(F.lit(1)).over(w) == rows, F.avg(col).over(w))
                        .alias(f"{col}_ma"))


#: Values that are sorted in one place once a quartile is known to be among them.
FEW_VALUES = 4096


def exact_quantiles(df: DataFrame, cols, probs, few: int = FEW_VALUES, accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Exact linear quantiles of numeric columns by distributed selection.

    A quantile is one or two ranks.  For each rank a round finds two values that
    approximately enclose it (a mergeable summary of ``accuracy``), counts the
    values below and up to each exactly, and keeps the open range between that
    must hold the rank: about a thousandth of the values.  A rank is settled when
    one of the two values has it, or when at most ``few`` values are left, which
    are sorted.  All ranks of all columns share the passes; no buffer holds more
    than ``few`` values and the driver gets counts and edges only."""
    x = {c: F.col(c).cast("double") for c in cols}
    n = dict(zip(cols, df.agg(*[F.count(x[c]) for c in cols]).first()))
    places = {(c, p): p * (n[c] - 1) for c in cols for p in probs if n[c]}
    found: dict[tuple[str, int], float] = {}
    todo = {(c, r): (None, None, 0, n[c]) for (c, _), at in places.items() for r in {math.floor(at), math.ceil(at)}}
    while todo:
        keys = list(todo)
        inside = {}
        for c, r in keys:
            lo, hi, _, _ = todo[c, r]
            cond = x[c].isNotNull()
            cond = cond if lo is None else cond & (x[c] > lo)
            inside[c, r] = F.when(cond if hi is None else cond & (x[c] < hi), x[c])
        last = [k for k in keys if todo[k][3] <= few]
        if last:
            got = df.agg(*[F.sort_array(F.collect_list(inside[k])) for k in last]).first()
            for k, values in zip(last, got):
                found[k] = values[k[1] - todo[k][2]]
                del todo[k]
        keys = list(todo)
        if not keys:
            break
        edge = []
        for k in keys:
            _, _, below, m = todo[k]
            p, gap = (k[1] - below + 0.5) / m, 5.0 / accuracy
            edge.append(F.percentile_approx(inside[k], [max(0.0, p - gap), min(1.0, p + gap)], accuracy))
        edges = [tuple(e) for e in df.agg(*edge).first()]
        counts = df.agg(*[F.count_if(test) for k, e in zip(keys, edges) for v in e for test in (inside[k] < v, inside[k] <= v)]).first()
        for i, k in enumerate(keys):
            lo, hi, below, m = todo[k]
            (a, b), (less_a, upto_a, less_b, upto_b), at = edges[i], counts[4 * i: 4 * i + 4], k[1] - below
            if less_a <= at < upto_a or less_b <= at < upto_b:
                found[k] = a if less_a <= at < upto_a else b
                del todo[k]
            elif at < less_a:
                todo[k] = (lo, a, below, less_a)
            elif at < less_b:
                todo[k] = (a, b, below + upto_a, less_b - upto_a)
            else:
                todo[k] = (b, hi, below + upto_b, m - upto_b)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        out[c] = []
        for p in probs:
            if not n[c]:
                out[c].append(None)
                continue
            at = places[c, p]
            lo, hi = found[c, math.floor(at)], found[c, math.ceil(at)]
            out[c].append(lo + (hi - lo) * (at - math.floor(at)))
    return out


def summary_stats(daily: DataFrame, cols=("sales", "revenue", "customers")) -> DataFrame:
    """L2: count, mean, sample std, min, quartiles (linear), max per column: one
    aggregate over all columns, quartiles by :func:`exact_quantiles`, one row per
    column."""
    quartiles = exact_quantiles(daily, cols, (0.25, 0.5, 0.75))
    rows = []
    for c in cols:
        x = F.col(c).cast("double")
        q = [F.lit(v).cast("double") for v in quartiles[c]]
        rows.append(F.struct(F.lit(c).alias("metric"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                             F.min(x).alias("min"), q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), F.max(x).alias("max")))
    return daily.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def headline_totals(daily: DataFrame) -> DataFrame:
    """L3: total revenue with thousands separators, mean daily sales to 1 dp
    (Python ``:,.2f`` / ``:.1f`` formatting: exact value, half to even)."""
    return daily.agg(F.format_number(F.sum("revenue"), 2).alias("total_revenue"),
                     py_fixed(F.avg("sales"), 1).alias("avg_daily_sales"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """L4: equal-width histogram, last bin closed; empty bins are kept.

    ``min``/``max`` are scalar subqueries (one partial aggregate each, the
    value is inlined into the projection), so no join is needed to bin."""
    x = F.col(col).cast("double")
    lo = df.agg(F.min(x)).scalar()
    hi = df.agg(F.max(x)).scalar()
    idx = F.least(F.floor((x - lo) * F.lit(float(bins)) / (hi - lo)), F.lit(bins - 1)).cast("int")
    idx = F.when(hi == lo, F.lit(0)).otherwise(idx)
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / F.lit(float(bins))
    return (edges.join(counts, "bin", "left")
            .where(lo.isNotNull())
            .select("bin", (lo + F.col("bin") * width).alias("lower"),
                    (lo + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def mean_and_pop_std(df: DataFrame, col: str) -> DataFrame:
    """Sample mean and population standard deviation (ddof=0)."""
    return df.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std_pop"))
