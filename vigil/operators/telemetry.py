"""Session and pool telemetry (K1-K23): the serving code's rules re-aimed
as jobs over event tables.

Per-session and per-pool state is built with keyed aggregates (``max_by``,
``min_by``, counts: map-side combined, so a hot session or pool costs one
row per task in the shuffle).  Sequence-dependent rules use the skew-safe
scans of ``functions.windows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import as_col, py_fixed
from ..functions.windows import epoch_micros, prev_matching, prev_matching_multi, trailing_agg

# Fixed values of the pool balancer and operator.
DEGRADED_FACTOR = 0.7
MAX_QUEUE_DEPTH = 50
HEALTH_CPU_MEM_LIMIT = 90
TIMEOUT_RESPONSE_MS = 5000
AFFINITY_TTL_SECONDS = 3600
TRACEBACK_MARKER = "Traceback (most recent call last):"


def _secs_2dp(us: Column) -> Column:
    """Seconds rounded to 2 decimals from integer microseconds (exact
    integer rounding, then one division)."""
    return F.floor((us + F.lit(5000)) / F.lit(10000)).cast("long") / F.lit(100.0)


# ---------------------------------------------------------------- K1-K5
def session_records(events: DataFrame, session_col: str = "session_id", ts_col: str = "ts",
                    template_col: str = "template", tie_col: str = "event_id", extra_keys=()) -> DataFrame:
    """Session records from raw session events: created (first event),
    last used (last event), use count, template of the first event, and
    ``closed`` when the last event closes the session (a purchase)."""
    return events.groupBy(session_col, *extra_keys).agg(
        (F.max_by(F.col(template_col), F.struct(ts_col, tie_col)) == "purchase").alias("closed"),
        F.min(ts_col).alias("created_at"), F.max(ts_col).alias("last_used"),
        F.count(F.lit(1)).alias("use_count"),
        F.min_by(F.col(template_col), F.struct(ts_col, tie_col)).alias("template"))


def session_expiry(sessions: DataFrame, as_of: Column, ttl_seconds: int = 300) -> DataFrame:
    """K1: age and idle time (2 dp) against ``as_of``; expired when idle > ttl."""
    age_us = F.timestamp_diff("MICROSECOND", F.col("created_at"), as_of)
    idle_us = F.timestamp_diff("MICROSECOND", F.col("last_used"), as_of)
    return sessions.select("*", _secs_2dp(age_us).alias("age"), _secs_2dp(idle_us).alias("idle_time"),
                           F.lit(ttl_seconds).alias("ttl"),
                           (idle_us > F.lit(ttl_seconds * 1_000_000)).alias("is_expired"))


def lifecycle_counters(sessions: DataFrame, events: DataFrame, group_col: str = "pool") -> DataFrame:
    """K2: created, reused, destroyed (expired or explicitly closed),
    expired, errors and active sessions per group."""
    s = sessions.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("created"), F.sum(F.col("use_count") - 1).alias("reused"),
        F.count_if(F.col("is_expired") | F.col("closed")).alias("destroyed"),
        F.count_if("is_expired").alias("expired"),
        F.count_if(~(F.col("is_expired") | F.col("closed"))).alias("active"))
    e = events.groupBy(group_col).agg(F.count_if(F.col("kind") == "error").alias("errors"))
    return s.join(e, group_col, "left").withColumn("errors", F.coalesce("errors", F.lit(0)))


def latest_state(changes: DataFrame, session_col: str = "session_id", ts_col: str = "ts",
                 tie_col: str = "event_id", pool: str | None = None, pod: str | None = None) -> DataFrame:
    """K3: the newest state row per session, optionally filtered."""
    cols = [c for c in changes.columns if c != session_col]
    out = (changes.groupBy(session_col)
           .agg(F.max_by(F.struct(*cols), F.struct(ts_col, tie_col)).alias("_s")).select(session_col, "_s.*"))
    if pool is not None:
        out = out.where(F.col("pool") == pool)
    if pod is not None:
        out = out.where(F.col("pod") == pod)
    return out


def ttl_alive(df: DataFrame, ts_col: str, ttl_seconds, as_of: Column) -> DataFrame:
    """K4: rows whose ``ts + ttl`` is still after ``as_of``."""
    ttl = ttl_seconds if isinstance(ttl_seconds, Column) else F.lit(ttl_seconds)
    exp = F.col(ts_col) + F.make_dt_interval(secs=ttl.cast("decimal(18,6)"))
    return df.withColumn("expires_at", exp).where(F.col("expires_at") > as_of)


def apply_session_changes(changes: DataFrame, session_col: str = "session_id", ts_col: str = "ts",
                          tie_col: str = "event_id", bucket_seconds: int = 3600) -> DataFrame:
    """K5: replay migrate / restore changes.  The final pod is the last
    change's pod, the pool the last given pool; ``migrated_from`` is the pod
    before the last migration (skew-safe previous-row lookup), and the
    restore markers come from the last restore."""
    us = epoch_micros(ts_col)
    with_prev = prev_matching(changes, [session_col], us, F.col(tie_col), F.lit(True),
                              {"pod": F.col("new_pod")}, bucket_seconds * 1_000_000)
    order = F.struct(ts_col, tie_col)
    mig = F.col("kind") == "migrate"
    res = F.col("kind") == "restore"
    return with_prev.groupBy(session_col).agg(
        F.max_by("new_pod", order).alias("pod"),
        F.max_by(F.col("new_pool"), F.when(F.col("new_pool").isNotNull(), order)).alias("pool"),
        F.max_by(F.coalesce(F.col("prev_pod"), F.lit("unknown")), F.when(mig, order)).alias("migrated_from"),
        F.max(F.when(mig, F.col(ts_col))).alias("migrated_at"),
        F.max(F.when(res, F.lit("true"))).alias("restored"),
        F.max(F.when(res, F.col(ts_col))).alias("restored_at"))


# ---------------------------------------------------------------- K6-K13
def classify_probe(probes: DataFrame) -> DataFrame:
    """K7: 200 with cpu or memory > 90 -> degraded; 200 -> healthy; timeout
    (null status) -> degraded at 5000 ms; anything else -> unhealthy."""
    st = F.col("probe_status")
    hot = (F.col("cpu") > HEALTH_CPU_MEM_LIMIT) | (F.col("mem") > HEALTH_CPU_MEM_LIMIT)
    status = (F.when(st.isNull(), "degraded").when((st == 200) & hot, "degraded")
              .when(st == 200, "healthy").otherwise("unhealthy"))
    rt = F.when(st.isNull(), F.lit(float(TIMEOUT_RESPONSE_MS))).otherwise(F.col("elapsed_ms"))
    return probes.select("*", status.alias("status"), rt.alias("response_time_ms"),
                         F.when(st == 200, "success").otherwise("failure").alias("outcome"))


def affinity_lookup(affinity: DataFrame, pools: DataFrame, as_of: Column,
                    ttl_seconds: int = AFFINITY_TTL_SECONDS) -> DataFrame:
    """K6: latest affinity per session, used only when not expired and the
    pool is healthy."""
    a = (affinity.groupBy("session_id")
         .agg(F.max_by(F.struct("pool", "created_at"), F.struct("created_at", "event_id")).alias("_a"))
         .select("session_id", "_a.pool", "_a.created_at"))
    age_us = F.timestamp_diff("MICROSECOND", F.col("created_at"), as_of)
    j = a.join(pools.select(F.col("name").alias("pool"), "status"), "pool", "left")
    return j.select("session_id", "pool", (age_us > F.lit(ttl_seconds * 1_000_000)).alias("expired"),
                    ((age_us <= F.lit(ttl_seconds * 1_000_000)) & (F.col("status") == "healthy")).alias("use_affinity"))


def available_pools(pools: DataFrame) -> DataFrame:
    """K8: breaker allows, healthy or degraded, below capacity, queue ≤ 50."""
    return pools.where((F.col("breaker_state") != "open") & F.col("status").isin("healthy", "degraded")
                       & (F.col("current_sessions") < F.col("max_sessions"))
                       & (F.col("queue_depth") <= MAX_QUEUE_DEPTH))


def _util(c=None):
    return F.when(F.col("max_sessions") > 0, F.col("current_sessions") / F.col("max_sessions")).otherwise(F.lit(1.0))


def order_pools(pools: DataFrame, preferred_region: str | None) -> DataFrame:
    """K9: preferred region first, then priority, then utilisation."""
    from ..functions.windows import global_rank

    keys = [F.col("priority"), _util(), F.col("name")]
    if preferred_region:
        keys = [F.when(F.col("region") == preferred_region, 0).otherwise(1)] + keys
    return global_rank(pools, keys, "order_rank")


def score_pools(pools: DataFrame, top: int = 3) -> DataFrame:
    """(1 − util)·weight·(0.7 if degraded)·1000/(rt + 1000); top 3."""
    health = F.when(F.col("status") == "degraded", DEGRADED_FACTOR).otherwise(1.0)
    resp = F.when(F.col("response_time_ms") > 0, F.lit(1000.0) / (F.col("response_time_ms") + 1000)).otherwise(1.0)
    score = (F.lit(1.0) - _util()) * F.col("weight") * health * resp
    best = pools.withColumn("score", score).orderBy(F.col("score").desc(), F.col("order_rank")).limit(top)
    # of the few that are left, each is placed by those before it
    return best.withColumn("score_rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("order_rank"))))


def pool_stats(pools: DataFrame) -> DataFrame:
    """Pools by status and total sessions / capacity."""
    return pools.agg(F.count(F.lit(1)).alias("total_pools"),
                     F.count_if(F.col("status") == "healthy").alias("healthy_pools"),
                     F.count_if(F.col("status") == "degraded").alias("degraded_pools"),
                     F.count_if(F.col("status") == "unhealthy").alias("unhealthy_pools"),
                     F.sum("current_sessions").alias("total_sessions"),
                     F.sum("max_sessions").alias("total_capacity"))


def scaling_targets(sessions: DataFrame, pools: DataFrame, target_queue_depth: int = 10, min_replicas: int = 1,
                    max_replicas: int = 10) -> DataFrame:
    """pending/active sessions per pool, target replicas
    clamp(ceil((active + pending) / target depth)), phase Scaling when work
    is pending below the maximum (counted per pool)."""
    c = sessions.groupBy("pool").agg(F.count_if(F.col("phase") == "Pending").alias("pending"),
                                     F.count_if(F.col("phase") == "Active").alias("active"))
    j = pools.select(F.col("name").alias("pool"), "current_replicas").join(c, "pool", "left").fillna(0, ["pending", "active"])
    tgt = F.greatest(F.lit(min_replicas), F.least(F.lit(max_replicas),
                     F.floor((F.col("active") + F.col("pending") + target_queue_depth - 1) / target_queue_depth).cast("int")))
    phase = F.when((F.col("pending") > 0) & (F.col("current_replicas") < max_replicas), "Scaling").otherwise("Active")
    return j.select("pool", "pending", "active", "current_replicas", tgt.alias("target_replicas"), phase.alias("phase"))


# ---------------------------------------------------------------- K15-K17
def hold_alerts(samples: DataFrame, key_col: str, ts_col: str, tie_col: str, rules: dict,
                bucket_seconds: int = 3600) -> DataFrame:
    """For each rule ``name -> (condition, hold_seconds)``, a sample
    fires when the condition holds and has held since the first sample
    after the last failing one for at least the hold time (gaps and
    islands).  Two skew-safe scans serve every rule: the next sample of the
    key, then the last failing sample of each rule (carrying its
    successor's time)."""
    us = epoch_micros(ts_col)
    bucket = bucket_seconds * 1_000_000
    b = samples.withColumn("_us", us)
    for i, (name, (cond, _)) in enumerate(rules.items()):
        b = b.withColumn(f"_c{i}", F.coalesce(cond, F.lit(False)))
    nxt = prev_matching(b, [key_col], -F.col("_us"), -F.col(tie_col), F.lit(True), {"us": F.col("_us")},
                        bucket, prefix="next_")
    specs = {f"_lf{i}_": (~F.col(f"_c{i}"), {"succ_us": F.col("next_us")}) for i in range(len(rules))}
    lf = prev_matching_multi(nxt, [key_col], F.col("_us"), F.col(tie_col), specs, bucket)
    first = samples.groupBy(key_col).agg(F.min(us).alias("_first_us"))
    j = lf.join(first, key_col, "left")
    for i, (name, (_, hold)) in enumerate(rules.items()):
        start = F.coalesce(F.col(f"_lf{i}_succ_us"), F.col("_first_us"))
        j = j.withColumn(f"firing_{name}", F.col(f"_c{i}") & (F.col("_us") - start >= F.lit(hold * 1_000_000)))
    return j.drop("_us", "next_us", "_first_us", *[f"_c{i}" for i in range(len(rules))],
                  *[f"_lf{i}_succ_us" for i in range(len(rules))])


def counter_increase(samples: DataFrame, key_col: str, ts_col: str, tie_col: str, value_col: str,
                     window_seconds: int = 300, bucket_seconds: int = 3600) -> DataFrame:
    """Counter increase over the trailing window with reset handling
    (a drop means the counter restarted: the new value is the increase);
    ``rate_positive`` when the increase is above zero."""
    us = epoch_micros(ts_col)
    p = prev_matching(samples, [key_col], us, F.col(tie_col), F.lit(True), {"v": F.col(value_col)},
                      bucket_seconds * 1_000_000)
    v, pv = F.col(value_col), F.col("prev_v")
    inc = F.when(pv.isNull(), F.lit(0.0)).when(v >= pv, v - pv).otherwise(v)
    p = p.withColumn("_inc", inc.cast("double"))
    out = trailing_agg(p, [key_col], ts_col, window_seconds, F.col("_inc"), "increase", how="sum")
    return out.withColumn("rate_positive", F.col("increase") > 0).drop("_inc")


def rate_limit(requests: DataFrame, key_col: str, ts_col: str, limit: int = 30, window_seconds: int = 60) -> DataFrame:
    """Requests of the key in the trailing minute; reject above the limit."""
    out = trailing_agg(requests, [key_col], ts_col, window_seconds, None, "requests_in_window")
    return out.withColumn("rejected", F.col("requests_in_window") > limit)


# ---------------------------------------------------------------- K18-K23
def package_key(packages: Column, language: Column) -> Column:
    """First 16 hex of sha256 of ``{"language": ..., "packages": [...]}``
    with sorted packages, keys sorted, Python's default separators.  Names
    are JSON-escaped (quote, backslash); names are expected to be ASCII."""
    esc = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    items = F.array_join(F.transform(F.array_sort(packages), lambda x: F.concat(F.lit('"'), esc(x), F.lit('"'))), ", ")
    doc = F.concat(F.lit('{"language": "'), esc(language), F.lit('", "packages": ['), items, F.lit("]}"))
    return F.substring(F.sha2(doc, 256), 1, 16)


def cache_stats(entries: DataFrame, size_col: str = "size_bytes") -> DataFrame:
    """Entry count, total bytes, MB (2 dp, Python rounding)."""
    total = F.coalesce(F.sum(size_col), F.lit(0)).cast("long")
    return entries.agg(F.count(F.lit(1)).alias("entry_count"), total.alias("total_size_bytes")).withColumn(
        "total_size_mb", py_fixed(F.col("total_size_bytes") / F.lit(1048576.0), 2).cast("double"))


def execution_result(df: DataFrame) -> DataFrame:
    """Status from exit code; traceback = marker + the text after the
    first marker up to the next one; message = its last line (stripped)."""
    err = F.coalesce(F.col("stderr"), F.lit(""))
    parts = F.split(err, "Traceback \\(most recent call last\\):", -1)
    has = F.instr(err, TRACEBACK_MARKER) > 0
    tb = F.when(has, F.concat(F.lit(TRACEBACK_MARKER), F.element_at(parts, 2)))
    stripped = F.regexp_replace(tb, r"^\s+|\s+$", "")
    msg = F.when(has, F.element_at(F.split(stripped, "\n"), -1)).otherwise(err)
    return df.select("*", F.when(F.col("exit_code") == 0, "success").otherwise("error").alias("status"),
                     tb.alias("error_traceback"), msg.alias("error_message"))


def artifact_type(c) -> Column:
    """Artifact type by file extension (``.json`` holds its own type)."""
    x = as_col(c)
    return (F.when(x.endswith(".json"), "json").when(x.endswith(".png"), "image/png")
            .when(x.endswith(".jpg") | x.endswith(".jpeg"), "image/jpeg").when(x.endswith(".svg"), "image/svg+xml"))


def format_size(c) -> Column:
    """``%.2f`` with the first unit (B, KB, MB, GB) under 1024, else TB."""
    x = as_col(c).cast("double")
    out = None
    for i, unit in enumerate(["B", "KB", "MB", "GB"]):
        v = x / F.lit(float(1024 ** i))
        cond = v < 1024.0
        txt = F.concat(py_fixed(v, 2), F.lit(" " + unit))
        out = F.when(cond, txt) if out is None else out.when(cond, txt)
    return out.otherwise(F.concat(py_fixed(x / F.lit(float(1024 ** 4)), 2), F.lit(" TB")))


def display_text(df: DataFrame) -> DataFrame:
    """The human view of a result; optional sections are skipped."""
    parts = [F.concat(F.lit("Status: "), F.col("status")),
             F.concat(F.lit("Execution Time: "), py_fixed("execution_time", 3), F.lit("s")),
             F.concat(F.lit("Exit Code: "), F.col("exit_code").cast("string")), F.lit("")]
    so, se = F.coalesce(F.col("stdout"), F.lit("")), F.coalesce(F.col("stderr"), F.lit(""))
    parts += [F.when(so != "", F.concat(F.lit("STDOUT:\n"), so, F.lit("\n")))]
    parts += [F.when(se != "", F.concat(F.lit("STDERR:\n"), se, F.lit("\n")))]
    arts = F.col("artifacts")
    parts += [F.when(F.size(arts) > 0, F.concat(
        F.lit("Artifacts ("), F.size(arts).cast("string"), F.lit("):\n"),
        F.array_join(F.transform(arts, lambda a: F.concat(F.lit("  - "), a["name"], F.lit(" ("), a["type"], F.lit(")"))),
                     "\n")))]
    return df.select("*", F.concat_ws("\n", *parts).alias("display"))


def sessionize(events: DataFrame, key_col: str, ts_col: str, tie_col: str, gap_seconds: int,
               bucket_seconds: int = 3600) -> DataFrame:
    """K1 from raw events: a session of a key ends when the next event comes
    more than ``gap_seconds`` later (the session TTL).  Two skew-safe scans:
    the previous event of the key (a gap marks a session start), then the
    latest start at or before each event (its session).  Returns one row per
    session: key, started_at, last_event_at, events."""
    us = epoch_micros(ts_col)
    bucket = bucket_seconds * 1_000_000
    e = events.withColumn("_us", us)
    p = prev_matching(e, [key_col], F.col("_us"), F.col(tie_col), F.lit(True), {"us": F.col("_us")}, bucket,
                      prefix="prev_")
    p = p.withColumn("_start", F.col("prev_us").isNull() | (F.col("_us") - F.col("prev_us") > gap_seconds * 1_000_000))
    s = prev_matching(p, [key_col], F.col("_us"), F.col(tie_col), F.col("_start"), {"ts": F.col(ts_col)}, bucket,
                      prefix="lst_")
    session_start = F.when(F.col("_start"), F.col(ts_col)).otherwise(F.col("lst_ts"))
    return (s.withColumn("started_at", session_start)
            .groupBy(key_col, "started_at")
            .agg(F.max(ts_col).alias("last_event_at"), F.count(F.lit(1)).alias("events")))
