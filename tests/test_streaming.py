"""Batch/stream parity for the stateful and windowed operators."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from vigil.operators import audit as au
from vigil.operators import telemetry as tm
from vigil.sources import standins as si
from vigil.streaming import jobs as sj


def _land(spark, df, tmp_path, parts=4):
    """Write a derived table as several parquet files (the stream source)."""
    p = str(tmp_path / f"src-{uuid.uuid4().hex}")
    df.repartition(parts).write.parquet(p)
    return p, spark.read.parquet(p).schema


def _run(stream, name):
    sj.run_to_completion(stream, name)
    return stream.sparkSession.table(name)


def test_chain_stream_matches_batch(spark, tables, tmp_path):
    audit = si.audit_events(tables.events)
    # one file per tenant-ordered slice keeps arrival order = event order per tenant
    p = str(tmp_path / "audit")
    audit.orderBy("created_at", "id").coalesce(1).write.parquet(p)
    s = sj.file_stream(spark, p, spark.read.parquet(p).schema)
    got = {r["id"]: (r["prev_hash"], r["event_hash"]) for r in _run(sj.chain_stream(s), "chain_s").collect()}
    exp = {r["id"]: (r["prev_hash"], r["event_hash"])
           for r in au.build_chain(au.with_hash_columns(audit)).collect()}
    assert got == exp


def test_chain_stream_marks_late_events(spark, tables, tmp_path):
    """The older half arrives second: its events are chained after the newer
    ones, in whole links, and marked."""
    audit = si.audit_events(tables.events)
    cut = audit.agg(F.percentile_approx(F.col("created_at").cast("timestamp").cast("double"), 0.5)).first()[0]
    old = F.col("created_at").cast("timestamp").cast("double") < cut
    p = str(tmp_path / "late")
    audit.where(~old).coalesce(1).write.parquet(p)
    import time
    time.sleep(1.1)  # file order is by modification time
    audit.where(old).coalesce(1).write.mode("append").parquet(p)
    s = sj.file_stream(spark, p, spark.read.parquet(p).schema, max_files_per_trigger=1)
    rows = _run(sj.chain_stream(s), "chain_late").collect()
    assert {r["id"] for r in rows if r["late"]} == {r["id"] for r in audit.where(old).collect()}
    heads = {r["event_hash"] for r in rows}
    assert all(r["prev_hash"] in heads or r["prev_hash"] == "" for r in rows)
    assert sum(r["prev_hash"] == "" for r in rows) == audit.select("tenant_id").distinct().count()


def test_hourly_ingest_stream_matches_batch(spark, tables, tmp_path):
    mv = si.memory_documents(tables.documents).select("id", "created_at")
    p, schema = _land(spark, mv, tmp_path)
    got = {r["hour"]: r["vectors_ingested"] for r in
           _run(sj.hourly_ingest_stream(sj.file_stream(spark, p, schema, 10)), "g4_s").collect()}
    exp = {r["hour"]: r["n"] for r in mv.groupBy(F.date_trunc("hour", F.col("created_at").cast("timestamp"))
                                                   .alias("hour")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # windows whose end is past (max event time - watermark) are still open
    import datetime as dt
    max_ts = mv.agg(F.max("created_at")).first()[0]
    closed = {h: n for h, n in exp.items() if h + dt.timedelta(hours=1) <= max_ts - dt.timedelta(hours=1)}
    assert closed and {h: n for h, n in got.items() if h in closed} == closed


def test_dedupe_stream(spark, tables, tmp_path):
    docs = si.memory_documents(tables.documents).withColumn("content_hash", F.sha2("content", 256))
    p, schema = _land(spark, docs.select("id", "tenant_id", "scope", "content_hash", "created_at"), tmp_path, 1)
    s = sj.dedupe_stream(sj.file_stream(spark, p, schema), ["tenant_id", "scope", "content_hash"], "created_at",
                         "3650 days")
    got = _run(s, "d3_s").count()
    assert got == docs.select("tenant_id", "scope", "content_hash").distinct().count()


def test_latest_state_stream_matches_batch(spark, tables, tmp_path):
    ev = si.session_events(tables.events)
    p, schema = _land(spark, ev, tmp_path)
    s = sj.latest_state_stream(sj.file_stream(spark, p, schema, 1), watermark="3650 days")
    sj.run_to_completion(s, "k3_s", mode="update")
    got = spark.table("k3_s").groupBy("session_id").agg(F.max_by("pod", F.struct("ts", "event_id")).alias("pod"))
    exp = tm.latest_state(ev).select("session_id", "pod")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in exp.collect())


def test_session_and_failure_window_streams_run(spark, tables, tmp_path):
    ev = si.session_events(tables.events)
    p, schema = _land(spark, ev, tmp_path)
    n = _run(sj.session_stream(sj.file_stream(spark, p, schema, 10)), "k1_s").count()
    assert n > 0
    ra = si.router_audit(tables.events)
    p2, schema2 = _land(spark, ra, tmp_path)
    rows = _run(sj.failure_window_stream(sj.file_stream(spark, p2, schema2, 10)), "i4_s").collect()
    assert all(r["fails"] >= 1 for r in rows)


def test_hold_alert_stream_matches_batch(spark, tables, tmp_path):
    p = si.probe_samples(tables.events).withColumn("cond", F.col("mem") > 50)
    path = str(tmp_path / "samples")
    p.orderBy("ts", "event_id").coalesce(1).write.parquet(path)
    s = sj.file_stream(spark, path, spark.read.parquet(path).schema)
    got = {r["tie"]: r["firing"] for r in _run(sj.hold_alert_stream(s, "pool", "cond", 120), "k15_s").collect()}
    batch = tm.hold_alerts(p, "pool", "ts", "event_id", {"q": (F.col("cond"), 120)})
    exp = {r["event_id"]: r["firing_q"] for r in batch.collect()}
    assert got == exp


def test_lifecycle_stream_runs(spark, tables, tmp_path):
    ev = si.session_events(tables.events)
    p, schema = _land(spark, ev, tmp_path)
    rows = _run(sj.lifecycle_stream(sj.file_stream(spark, p, schema, 10)), "k2_s").collect()
    assert rows and all(r["uses"] >= 1 for r in rows)


def test_failure_window_stream_matches_batch(spark, tables, tmp_path):
    ra = si.router_audit(tables.events)
    p, schema = _land(spark, ra, tmp_path, 1)
    got = {(r["tenant_id"], r["window_start"]): r["fails"]
           for r in _run(sj.failure_window_stream(sj.file_stream(spark, p, schema)), "i4_par").collect()}
    b = (ra.where(F.col("action") == "chat_router_v1_brain_failure")
         .groupBy("tenant_id", F.window(F.col("created_at").cast("timestamp"), "60 seconds", "10 seconds").alias("w"))
         .agg(F.count(F.lit(1)).alias("n")))
    exp = {(r["tenant_id"], r["w"]["start"]): r["n"] for r in b.collect()}
    # every window the stream finalised equals the batch count (open windows
    # near the end of the data are still held by the watermark)
    assert got and all(exp[k] == v for k, v in got.items())
    assert len(got) >= 0.9 * len(exp)


def test_session_stream_matches_batch(spark, tables, tmp_path):
    ev = si.session_events(tables.events)
    p, schema = _land(spark, ev, tmp_path, 1)
    got = {(r["session_id"], r["started_at"]): r["use_count"]
           for r in _run(sj.session_stream(sj.file_stream(spark, p, schema)), "k1_par").collect()}
    b = (ev.groupBy("session_id", F.session_window(F.col("ts").cast("timestamp"), "300 seconds").alias("s"))
         .agg(F.count(F.lit(1)).alias("n")))
    exp = {(r["session_id"], r["s"]["start"]): r["n"] for r in b.collect()}
    assert got and all(exp[k] == v for k, v in got.items())


def test_latest_state_ttl_drops_idle_sessions(spark, tmp_path):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    base = [("s1", "p", "a", "t", t0, 1), ("s2", "p", "b", "t", t0, 2)]
    later = [("s2", "p", "c", "t", t0 + dt.timedelta(days=3), 3)]
    schema = "session_id string, pool string, pod string, template string, ts timestamp_ntz, event_id long"
    d = str(tmp_path / "ttl")
    spark.createDataFrame(base, schema).coalesce(1).write.parquet(d + "/1")
    spark.createDataFrame(later, schema).coalesce(1).write.parquet(d + "/2")
    s = sj.latest_state_stream(spark.readStream.schema(spark.read.parquet(d + "/1").schema)
                               .option("maxFilesPerTrigger", 1).parquet(d + "/*"), ttl_seconds=3600, watermark="1 minute")
    sj.run_to_completion(s, "k3_ttl", mode="update")
    rows = spark.table("k3_ttl").collect()
    assert {(r["session_id"], r["pod"]) for r in rows} >= {("s1", "a"), ("s2", "c")}


# -- late rows -----------------------------------------------------------------------

def _land_in_order(spark, parts, tmp_path, name):
    """One file per part; the source takes them in the order given."""
    import os
    p = str(tmp_path / name)
    seen = set()
    for i, df in enumerate(parts):
        df.coalesce(1).write.mode("append").parquet(p)
        new = {f for f in os.listdir(p) if f.startswith("part-")} - seen
        for f in new:
            os.utime(os.path.join(p, f), (1_700_000_000 + 10 * i,) * 2)
        seen |= new
    return p, parts[0].schema


def _gated(spark, parts, tmp_path, name, time_col, watermark):
    src, schema = _land_in_order(spark, parts, tmp_path, f"{name}-src")
    out = str(tmp_path / f"{name}-gate")
    sj.run_gate(sj.file_stream(spark, src, schema), name + uuid.uuid4().hex[:6], out, time_col, watermark)
    late = sj.late_rows(spark, out)
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    return sj.on_time_rows(spark, out, schema), late, whole


def _dropped(stream, name, mode="append"):
    spark = stream.sparkSession
    h = (stream.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", sj.checkpoint_location(spark, name)).trigger(availableNow=True).start())
    h.awaitTermination()
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in h.recentProgress for op in p["stateOperators"])


def _halves(df, ts):
    """The newer half first, then the older one: that is late."""
    cut = df.agg(F.percentile_approx(F.col(ts).cast("timestamp").cast("double"), 0.5)).first()[0]
    old = F.col(ts).cast("timestamp").cast("double") < cut
    return [df.where(~old), df.where(old)]


STREAMS = {
    "g4": ("created_at", lambda t: si.memory_documents(t.documents).select("id", "created_at"), lambda s, w: sj.hourly_ingest_stream(s, w)),
    "i4": ("created_at", lambda t: si.router_audit(t.events), lambda s, w: sj.failure_window_stream(s, watermark=w)),
    "d3": ("created_at", lambda t: si.memory_documents(t.documents).select("id", "scope", "created_at"), lambda s, w: sj.dedupe_stream(s, ["id"], "created_at", w)),
    "k1": ("ts", lambda t: si.session_events(t.events), lambda s, w: sj.session_stream(s, watermark=w)),
    "k15": ("ts", lambda t: si.probe_samples(t.events).withColumn("cond", F.col("mem") > 50), lambda s, w: sj.hold_alert_stream(s, "pool", "cond", 120)),
}


@pytest.mark.parametrize("name", STREAMS)
def test_late_rows_go_to_a_side_table(spark, tables, tmp_path, name):
    ts, rows, job = STREAMS[name]
    parts = _halves(rows(tables), ts)
    stream, late, whole = _gated(spark, parts, tmp_path, name, ts, "10 minutes")
    out = str(tmp_path / f"{name}-gate")
    on_time = spark.read.parquet(out).where(~F.col("late").cast("boolean")).drop("late")
    assert on_time.count() + late.count() == whole.count()
    both = on_time.unionByName(late.select(on_time.columns))
    assert both.exceptAll(whole.select(both.columns)).isEmpty() and whole.select(both.columns).exceptAll(both).isEmpty()
    assert late.count() > 0 and on_time.count() >= parts[0].count()
    assert _dropped(job(stream, "10 minutes"), f"late_{name}") == 0


def test_the_windows_behind_a_gate_count_what_was_in_time(spark, tables, tmp_path):
    parts = _halves(si.memory_documents(tables.documents).select("id", "created_at"), "created_at")
    stream, late, whole = _gated(spark, parts, tmp_path, "g4w", "created_at", "10 minutes")
    got = {r["hour"]: r["vectors_ingested"] for r in _run(sj.hourly_ingest_stream(stream, "10 minutes"), "g4_gate").collect()}
    rest = whole.exceptAll(late.select(whole.columns))
    exp = {r["h"]: r["n"] for r in rest.groupBy(F.date_trunc("hour", F.col("created_at").cast("timestamp")).alias("h"))
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(exp[h] == n for h, n in got.items()) and len(got) >= len(exp) - 2


def test_rows_without_time_are_late(spark, tmp_path):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    schema = "id long, ts timestamp_ntz, late_by long"
    parts = [spark.createDataFrame([(1, t0, 0), (2, None, 0)], schema), spark.createDataFrame([(3, t0 - dt.timedelta(seconds=60), 60),
             (4, t0 - dt.timedelta(seconds=61), 61), (5, t0 - dt.timedelta(seconds=59), 59), (6, None, 0)], schema)]
    _, late, _ = _gated(spark, parts, tmp_path, "none", "ts", "60 seconds")
    assert sorted(r["id"] for r in late.collect()) == [2, 3, 4, 6]


# -- exact windows per event -----------------------------------------------------------

def test_trailing_count_stream_equals_batch(spark, tables, tmp_path):
    """Four files of shuffled events: every event that the watermark has passed has the batch's count."""
    from vigil.functions.windows import trailing_agg
    ev = si.session_events(tables.events).select("event_id", "ts", "pool")
    p, schema = _land(spark, ev, tmp_path)
    s = sj.trailing_count_stream(sj.file_stream(spark, p, schema, 1), "pool", "ts", "event_id", 3600, 2, "3650 days")
    assert _run(s, "k17_held").count() == 0  # nothing is settled while the watermark holds everything back
    far = ev.limit(1).select(F.lit(-1).cast(ev.schema["event_id"].dataType).alias("event_id"),
                             (F.col("ts") + F.expr("INTERVAL 7300 DAYS")).alias("ts"), F.lit("pool-0").alias("pool"))
    src, schema = _land_in_order(spark, [ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1"), far], tmp_path, "k17")
    rows = _run(sj.trailing_count_stream(sj.file_stream(spark, src, schema), "pool", "ts", "event_id", 3600, 2, "3650 days"), "k17_s").collect()
    got = {r["id"]: (r["n_in_window"], r["over_limit"]) for r in rows}
    exp = {r["event_id"]: (r["n"], r["n"] > 2) for r in trailing_agg(ev, ["pool"], "ts", 3600, None, "n").collect()}
    assert got == exp and any(over for _, over in exp.values())


# -- lifecycle -----------------------------------------------------------------------

def test_lifecycle_streams_equal_batch_counters(spark, tables, tmp_path):
    ev = si.session_events(tables.events)
    cuts = ev.agg(F.percentile_approx(F.col("ts").cast("timestamp").cast("double"), [0.3, 0.6])).first()[0]
    at = F.col("ts").cast("timestamp").cast("double")
    parts = [ev.where(at < cuts[0]), ev.where((at >= cuts[0]) & (at < cuts[1])), ev.where(at >= cuts[1])]
    src, schema = _land_in_order(spark, parts, tmp_path, "k2")
    out = str(tmp_path / "deltas")
    (sj.lifecycle_delta_stream(sj.file_stream(spark, src, schema), watermark="0 seconds").writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", str(tmp_path / "k2c")).trigger(availableNow=True).start().awaitTermination())
    deltas = spark.readStream.schema(spark.read.parquet(out).schema).parquet(out)
    sj.run_to_completion(sj.lifecycle_counter_stream(deltas), "k2_exact", mode="complete")
    columns = ["pool", *sj.LIFECYCLE_DELTAS]
    got = sorted(tuple(r) for r in spark.table("k2_exact").select(columns).collect())
    sessions = tm.session_expiry(tm.session_records(ev, extra_keys=("pool",)), ev.agg(F.max("ts")).scalar())
    exp = sorted(tuple(r) for r in tm.lifecycle_counters(sessions, ev).select(columns).collect())
    assert got == exp


def test_sessions_come_back_or_are_forgotten(spark, tmp_path):
    """``s`` expires while others are active, then comes back: the same session, or a
    new one where its state was forgotten in between."""
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    schema = "session_id string, pool string, template string, kind string, event_id long, ts timestamp_ntz"
    who = ("s", "x", "y", "z", "s")
    parts = [spark.createDataFrame([(k, "p", "view", "use", i, t0 + dt.timedelta(days=i))], schema) for i, k in enumerate(who)]
    src, schema = _land_in_order(spark, parts, tmp_path, "back")
    for forget, created, reused in ((30 * 86400, 1, 1), (86400, 2, 0)):
        out = str(tmp_path / f"d{forget}")
        (sj.lifecycle_delta_stream(sj.file_stream(spark, src, schema), watermark="0 seconds", forget_seconds=forget).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / f"c{forget}")).trigger(availableNow=True).start().awaitTermination())
        mine = spark.read.parquet(out).where("session_id = 's'")
        assert tuple(mine.agg(F.sum("created"), F.sum("reused")).first()) == (created, reused)
        if created == 1:
            assert sorted(r["expired"] for r in mine.collect() if r["expired"]) == [-1, 1]


# -- typed state -----------------------------------------------------------------------

def test_session_state_goes_on_from_a_snapshot(spark, tables, tmp_path):
    """Restarted from the stored newest changes of the first half, the stream ends where the batch does."""
    ev = si.session_events(tables.events)
    newer, older = _halves(ev, "ts")
    snap = str(tmp_path / "snapshot")
    tm.latest_state(older).write.parquet(snap)
    snapshot = spark.read.parquet(snap)
    src, schema = _land_in_order(spark, [newer.where("event_id % 2 = 0"), newer.where("event_id % 2 = 1")], tmp_path, "k3")
    s = sj.session_state_stream(sj.file_stream(spark, src, schema), 10 ** 9, "3650 days", snapshot)
    sj.run_to_completion(s, "k3_typed", mode="update")
    seen = spark.table("k3_typed").where("not expired").select("session_id", "pod", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    known = snapshot.select("session_id", "pod", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long"))
    got = seen.unionByName(known).groupBy("session_id").agg(F.max_by("pod", F.struct("ts", "event_id")).alias("pod"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tm.latest_state(ev).select("session_id", "pod").collect()))


def test_older_changes_do_not_replace_the_snapshot(spark, tmp_path):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    schema = "session_id string, pool string, pod string, template string, ts timestamp_ntz, event_id long"
    snapshot = spark.createDataFrame([("s1", "p", "new", "t", t0, 5), ("s2", "p", "old", "t", t0, 5)], schema)
    late = spark.createDataFrame([("s1", "p", "older", "t", t0 - dt.timedelta(minutes=1), 9), ("s2", "p", "newer", "t", t0, 6)], schema)
    src, sch = _land_in_order(spark, [late], tmp_path, "older")
    sj.run_to_completion(sj.session_state_stream(sj.file_stream(spark, src, sch), 10 ** 6, "1 day", snapshot), "k3_old", mode="update")
    assert [(r["session_id"], r["pod"]) for r in spark.table("k3_old").collect()] == [("s2", "newer")]


def test_timers_drop_idle_sessions(spark, tmp_path):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    schema = "session_id string, pool string, pod string, template string, ts timestamp_ntz, event_id long"
    parts = [spark.createDataFrame([("s1", "p", "a", "t", t0, 1), ("s2", "p", "b", "t", t0, 2)], schema),
             spark.createDataFrame([("s2", "p", "c", "t", t0 + dt.timedelta(minutes=50), 3)], schema),
             spark.createDataFrame([("s3", "p", "d", "t", t0 + dt.timedelta(minutes=90), 4)], schema)]
    src, sch = _land_in_order(spark, parts, tmp_path, "timers")
    sj.run_to_completion(sj.session_state_stream(sj.file_stream(spark, src, sch), 3600, "1 minute"), "k3_timers", mode="update")
    rows = spark.table("k3_timers").collect()
    assert {(r["session_id"], r["pod"]) for r in rows if r["expired"]} == {("s1", "a")}  # s2 was used again in time
    assert {(r["session_id"], r["pod"]) for r in rows if not r["expired"]} == {("s1", "a"), ("s2", "b"), ("s2", "c"), ("s3", "d")}


def test_processing_time_state_has_a_ttl(spark, tmp_path):
    import datetime as dt
    schema = "session_id string, pool string, pod string, template string, ts timestamp_ntz, event_id long"
    src, sch = _land_in_order(spark, [spark.createDataFrame([("s1", "p", "a", "t", dt.datetime(2024, 1, 1), 1)], schema)], tmp_path, "pt")
    stream = sj.session_state_stream(sj.file_stream(spark, src, sch), 3600, event_time=False)
    h = (stream.writeStream.outputMode("update").format("memory").queryName("k3_pt")
         .option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start())
    try:  # processing time never comes to an end by itself
        deadline = time.time() + 40
        while time.time() < deadline and spark.table("k3_pt").isEmpty():
            time.sleep(0.5)
        assert [r["pod"] for r in spark.table("k3_pt").collect()] == ["a"]
    finally:
        h.stop()


# -- counters -----------------------------------------------------------------------

def test_decision_counters_by_window_equal_batch(spark, tables, tmp_path):
    from vigil.operators import policy as pol
    ev = tables.events.select("ts", F.element_at(F.array(F.lit("allow"), F.lit("deny"), F.lit("requires_approval"), F.lit(None)),
                                                 (F.col("event_id") % 4 + 1).cast("int")).alias("decision"),
                              (F.col("event_id") % 7 == 0).alias("policy_unavailable"), F.col("value").alias("latency_ms"))
    p, schema = _land(spark, ev, tmp_path, 1)
    rows = _run(sj.decision_counter_stream(sj.file_stream(spark, p, schema), "ts"), "c11_s").collect()
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")
    exp = {r["h"]: r for r in ev.groupBy(hour).agg(*pol.counter_columns(ev)).collect()}
    assert rows and len(rows) >= len(exp) - 2
    for r in rows:
        b = exp[r["window_start"]]
        assert [r[c] for c in ("total", "allow", "deny", "requires_approval", "errors")] == [b[c] for c in ("total", "allow", "deny", "requires_approval", "errors")]
        assert abs(r["latency_sum"] - b["latency_sum"]) < 1e-6
