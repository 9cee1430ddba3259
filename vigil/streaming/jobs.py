"""Streaming jobs.

Every function takes a streaming DataFrame and returns a streaming
DataFrame; callers pick the sink (``writeStream`` with a checkpoint under
the shared ``spark.checkpoint.dir``).  Event time must be ``TimestampType``
for watermarks, so the driver's ``timestamp_ntz`` columns are cast once at
the source (``with_event_time``).
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import audit as au
from ..session import scratch_path


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int = 1) -> DataFrame:
    """Parquet files landing in ``path`` as a stream; the checkpoint of
    the query that reads it is the persisted high-water mark."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def with_event_time(df: DataFrame, col: str, out: str = "event_time") -> DataFrame:
    return df.withColumn(out, F.col(col).cast("timestamp"))


def checkpoint_location(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"stream-{name}")


# ---------------------------------------------------------------- late rows
#: Groups over which the gate's step is dealt out; no key of the data is one.
GATE_PARTS = 64


def mark_late(stream: DataFrame, time_col: str, watermark: str, parts: int = GATE_PARTS) -> DataFrame:
    """Every row with ``late``: whether its time is not after the watermark of the
    micro-batch it arrives in.  A windowed or stateful step behind the same
    watermark would drop such rows without a trace.

    The step keeps no state; it runs as a stateful one because only that knows the
    watermark.  Rows are dealt out by a hash of the whole row.  Null times can't
    be placed and count as late."""
    timed = with_event_time(stream, time_col, "_time").withWatermark("_time", watermark)
    dealt = timed.withColumn("_part", F.pmod(F.xxhash64(*stream.columns), F.lit(parts)).cast("int"))
    columns = stream.columns
    schema = T.StructType([*stream.schema.fields, T.StructField("late", T.BooleanType())])

    def step(key, pdfs, state):
        limit = state.getCurrentWatermarkMs()
        for pdf in pdfs:
            at = pdf["_time"].astype("datetime64[us]").astype("int64")
            out = pdf[columns].copy()
            out["late"] = pdf["_time"].isna() | (at <= limit * 1000) if limit > 0 else pdf["_time"].isna()
            yield out

    marked = dealt.groupBy("_part").applyInPandasWithState(step, schema, "none int", "append", GroupStateTimeout.NoTimeout)
    # a projection: a sink that partitions by column takes no columnar rows
    return marked.select(*columns, F.coalesce("late", F.lit(True)).alias("late"))


def run_gate(stream: DataFrame, name: str, path: str, time_col: str, watermark: str) -> None:
    """Write everything available of ``stream`` to the table at ``path``, in a
    partition for rows in time and one for late rows (the side table)."""
    spark = stream.sparkSession
    (mark_late(stream, time_col, watermark).writeStream.format("parquet").partitionBy("late").outputMode("append")
     .option("checkpointLocation", checkpoint_location(spark, f"gate-{name}")).option("path", path)
     .trigger(availableNow=True).start().awaitTermination())


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The side table of a gate (batch)."""
    return spark.read.parquet(path).where(F.col("late").cast("boolean")).drop("late")


def on_time_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows in time of a gate as a stream for any of the jobs below.  The sink's
    log shows whole micro-batches of the gate only, and no file limit is set here:
    so a batch of this stream ends where one of the gate did, its watermark never
    runs ahead of the gate's, and nothing more is dropped."""
    whole = T.StructType([*schema.fields, T.StructField("late", T.BooleanType())])
    return spark.readStream.schema(whole).parquet(path).where(~F.col("late")).drop("late")


# ---------------------------------------------------------------- G4
def hourly_ingest_stream(vectors: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Vectors per tumbling hour; a window is emitted once the
    watermark passes its end (append mode)."""
    v = with_event_time(vectors, "created_at")
    return (v.withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("vectors_ingested"))
            .select(F.col("w.start").alias("hour"), "vectors_ingested"))


# ---------------------------------------------------------------- I4 / K17
def failure_window_stream(audit: DataFrame, window: str = "60 seconds", slide: str = "10 seconds",
                          max_fails: int = 2, watermark: str = "2 minutes") -> DataFrame:
    """I4 stream form: failures per tenant in sliding windows; the breaker
    is open for a window with at least ``max_fails`` failures."""
    a = with_event_time(audit.where(F.col("action") == "chat_router_v1_brain_failure"), "created_at")
    return (a.withWatermark("event_time", watermark)
            .groupBy("tenant_id", F.window("event_time", window, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("fails"))
            .select("tenant_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "fails", (F.col("fails") >= max_fails).alias("breaker_open")))


def trailing_count_stream(events: DataFrame, key_col: str, time_col: str, id_col: str, window_seconds: int, limit: int,
                          watermark: str = "2 minutes") -> DataFrame:
    """I4 / K17 stream form, exact per event: key, id, time, the events of the key in
    (t - window, t], and whether they are more than ``limit``.

    An event goes out once the watermark has passed it, for then none with an
    earlier time can come; so arrival order does not matter.  A key's state is
    its events of the window and of the watermark's delay, as two arrays."""
    e = with_event_time(events, time_col, "_time").select(
        F.col(key_col).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), "_time").withWatermark("_time", watermark)
    wide = window_seconds * 1_000_000

    def step(key, pdfs, state):
        past, open_us, open_ids = state.get if state.exists else ([], [], [])
        waiting = list(zip(open_us, open_ids))
        for pdf in pdfs:
            waiting += zip(pdf["_time"].astype("datetime64[us]").astype("int64").tolist(), pdf["id"].tolist())
        waiting.sort()
        mark = state.getCurrentWatermarkMs() * 1000
        n = bisect.bisect_right(waiting, (mark, 1 << 62))
        settled, waiting = waiting[:n], waiting[n:]
        known = sorted([*past, *(us for us, _ in settled)])
        if settled:
            count = [bisect.bisect_right(known, us) - bisect.bisect_right(known, us - wide) for us, _ in settled]
            yield pd.DataFrame({"key": key[0], "id": [i for _, i in settled], "event_time": pd.to_datetime([us for us, _ in settled], unit="us"),
                                "n_in_window": count, "over_limit": [c > limit for c in count]})
        past = known[bisect.bisect_right(known, mark - wide):]
        if not past and not waiting:
            state.remove()
            return
        state.update((past, [us for us, _ in waiting], [i for _, i in waiting]))
        wake = waiting[0][0] if waiting else past[-1] + wide
        state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    return e.groupBy("key").applyInPandasWithState(
        step, "key string, id long, event_time timestamp, n_in_window long, over_limit boolean",
        "past array<long>, open_us array<long>, open_ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- C11
def decision_counter_stream(decisions: DataFrame, time_col: str, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """C11 stream form: decision counters per tumbling window (``decision``, and
    ``error`` and ``latency_ms`` as :func:`policy.decision_counters` takes them)."""
    from ..operators.policy import counter_columns

    d = with_event_time(decisions, time_col)
    return (d.withWatermark("event_time", watermark).groupBy(F.window("event_time", window).alias("w")).agg(*counter_columns(d))
            .select(F.col("w.start").alias("window_start"), "*").drop("w"))


# ---------------------------------------------------------------- D3 / J3
def dedupe_stream(df: DataFrame, keys, time_col: str, watermark: str = "1 day") -> DataFrame:
    """D3 / J3 stream form: drop repeats of a key seen within the watermark
    (state is bounded by the watermark, late copies are dropped)."""
    t = with_event_time(df, time_col)
    return t.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(list(keys))


# ---------------------------------------------------------------- K1
def session_stream(events: DataFrame, gap: str = "300 seconds", watermark: str = "10 minutes") -> DataFrame:
    """K1 stream form: sessions as event-time session windows (gap = ttl)."""
    e = with_event_time(events, "ts")
    return (e.withWatermark("event_time", watermark)
            .groupBy("session_id", F.session_window("event_time", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("use_count"))
            .select("session_id", F.col("s.start").alias("started_at"), F.col("s.end").alias("expires_at"),
                    "use_count"))


# ---------------------------------------------------------------- K3
LATEST_STATE_SCHEMA = "session_id string, pool string, pod string, template string, ts timestamp, event_id long"


def latest_state_stream(changes: DataFrame, ttl_seconds: int = 86400, watermark: str = "10 minutes") -> DataFrame:
    """K3 (+ K4 state TTL) stream form: newest state per session kept in
    keyed state and re-emitted when it changes (update mode).  A session's
    state is dropped once the watermark passes its last activity + ttl, so
    state holds live sessions only."""
    c = (changes.select("session_id", "pool", "pod", "template", F.col("ts").cast("timestamp").alias("ts"),
                        F.col("event_id").cast("long"))
         .withWatermark("ts", watermark))
    ttl_ms = ttl_seconds * 1000

    def upd(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        for pdf in pdfs:
            i = pdf.sort_values(["ts", "event_id"]).index[-1]
            row = pdf.loc[i]
            cand = (row["pool"], row["pod"], row["template"], row["ts"].to_pydatetime(), int(row["event_id"]))
            if best is None or (cand[3], cand[4]) > (best[3], best[4]):
                best = cand
        state.update(best)
        # already-expired sessions (late rows) expire at the next watermark move
        expire = int(pd.Timestamp(best[3]).timestamp() * 1000) + ttl_ms
        state.setTimeoutTimestamp(max(expire, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([{"session_id": key[0], "pool": best[0], "pod": best[1], "template": best[2],
                             "ts": best[3], "event_id": best[4]}])

    return c.groupBy("session_id").applyInPandasWithState(
        upd, LATEST_STATE_SCHEMA, "pool string, pod string, template string, ts timestamp, event_id long",
        "update", GroupStateTimeout.EventTimeTimeout)


class LatestSession(StatefulProcessor):
    """K3 / K4 on typed state: the newest change of a session is a value state.

    In event time a timer drops it ``ttl_ms`` after its last activity; in
    processing time the state store's own TTL does.  An initial state (a table of
    newest changes, such as K3's batch result) stands for all that came before."""

    COLUMNS = ("pool", "pod", "template", "ts", "event_id")

    def __init__(self, ttl_ms: int, event_time: bool):
        self.ttl_ms, self.event_time = ttl_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = "pool string, pod string, template string, ts timestamp, event_id long"
        self.last = handle.getValueState("last", schema) if self.event_time else handle.getValueState("last", schema, self.ttl_ms)

    def _keep(self, best: tuple) -> None:
        self.last.update(best)
        if self.event_time:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(pd.Timestamp(best[3]).timestamp() * 1000) + self.ttl_ms)

    def _newest(self, pdfs: Iterator[pd.DataFrame], best: tuple | None) -> tuple | None:
        for pdf in pdfs:
            row = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            cand = (row["pool"], row["pod"], row["template"], row["ts"].to_pydatetime(), int(row["event_id"]))
            if best is None or cand[3:] > best[3:]:
                best = cand
        return best

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._keep(self._newest(iter([initialState]), None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = tuple(self.last.get()) if self.last.exists() else None
        best = self._newest(rows, had)
        if best != had:
            self._keep(best)
            yield pd.DataFrame([dict(zip(("session_id", *self.COLUMNS, "expired"), (key[0], *best, False)))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            gone = tuple(self.last.get())
            self.last.clear()
            yield pd.DataFrame([dict(zip(("session_id", *self.COLUMNS, "expired"), (key[0], *gone, True)))])

    def close(self) -> None:
        pass


def _changes(changes: DataFrame) -> DataFrame:
    return changes.select("session_id", "pool", "pod", "template", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))


def session_state_stream(changes: DataFrame, ttl_seconds: int = 86400, watermark: str = "10 minutes", snapshot: DataFrame | None = None,
                         event_time: bool = True) -> DataFrame:
    """K3 + K4 stream form on ``transformWithStateInPandas``: the newest state per
    session whenever it changes, and once more with ``expired`` when its TTL drops
    it.  ``snapshot``: newest changes so far (columns of ``changes``), from which the
    stream goes on."""
    c = _changes(changes).withWatermark("ts", watermark)
    start = None if snapshot is None else _changes(snapshot).groupBy("session_id")
    return c.groupBy("session_id").transformWithStateInPandas(
        LatestSession(ttl_seconds * 1000, event_time), LATEST_STATE_SCHEMA + ", expired boolean", "Update",
        "EventTime" if event_time else "ProcessingTime", start)


# ---------------------------------------------------------------- E2
CHAIN_OUT = ("id long, tenant_id string, created_at timestamp, prev_hash string, event_hash string, late boolean")


def chain_stream(audit: DataFrame, chain_key: str = "tenant_id") -> DataFrame:
    """E2 stream form: the last hash per chain key is the only state; each
    micro-batch's events of a key are chained in (created_at, id) order
    after it (append mode).  A hash that has gone out can't be changed, so an
    event that arrives after a newer one is chained where it arrives and
    marked ``late``: the links stay whole in arrival order, and a check by
    event time (E3) reports the late events as out of order."""
    a = au.with_hash_columns(audit).select(
        F.col("id").cast("long"), F.col(chain_key).alias("tenant_id"),
        F.col("created_at").cast("timestamp").alias("created_at"), au.hash_body().alias("body"))

    def step(key, pdfs, state):
        last, newest, newest_id = state.get if state.exists else ("", -(1 << 62), 0)
        out = []
        for pdf in pdfs:
            out.append(pdf)
        if not out:
            return
        pdf = pd.concat(out).sort_values(["created_at", "id"])
        prevs, hashes, late = [], [], []
        times = pdf["created_at"].astype("datetime64[us]").astype("int64").tolist()
        for body, at, event_id in zip(pdf["body"].tolist(), times, pdf["id"].tolist()):
            h = hashlib.sha256((last + body).encode("utf-8")).hexdigest()
            prevs.append(last)
            hashes.append(h)
            late.append((at, event_id) < (newest, newest_id))
            newest, newest_id = max((newest, newest_id), (at, event_id))
            last = h
        state.update((last, newest, newest_id))
        yield pd.DataFrame({"id": pdf["id"].values, "tenant_id": pdf["tenant_id"].values,
                            "created_at": pdf["created_at"].values, "prev_hash": prevs, "event_hash": hashes, "late": late})

    return a.groupBy("tenant_id").applyInPandasWithState(step, CHAIN_OUT, "last_hash string, newest long, newest_id long", "append",
                                                         GroupStateTimeout.NoTimeout)


def run_to_completion(stream: DataFrame, name: str, mode: str = "append", trigger_once: bool = True) -> str:
    """Run a stream over everything available into a memory table (tests,
    local runs) with its checkpoint under the shared checkpoint folder."""
    spark = stream.sparkSession
    q = (stream.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", checkpoint_location(spark, name)))
    q = q.trigger(availableNow=True) if trigger_once else q
    h = q.start()
    h.awaitTermination()
    return name


# ---------------------------------------------------------------- K2
def lifecycle_stream(events: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """K2 stream form: per pool and tumbling window, sessions seen, uses,
    reuses (uses beyond the first per session is approximated per window by
    uses − sessions) and errors."""
    e = with_event_time(events, "ts")
    return (e.withWatermark("event_time", watermark)
            .groupBy("pool", F.window("event_time", window).alias("w"))
            .agg(F.approx_count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("uses"),
                 F.count_if(F.col("kind") == "error").alias("errors"))
            .select("pool", F.col("w.start").alias("window_start"), "sessions", "uses",
                    (F.col("uses") - F.col("sessions")).alias("reused"), "errors"))


LIFECYCLE_STATE = "first_us long, last_us long, last_id long, last_template string, uses long, closed boolean, expired boolean"
LIFECYCLE_DELTAS = ("created", "reused", "destroyed", "expired", "active", "errors")


def lifecycle_delta_stream(events: DataFrame, ttl_seconds: int = 300, watermark: str = "10 minutes", forget_seconds: int = 30 * 86400) -> DataFrame:
    """K2, first step: per session what each micro-batch, and each passing of its
    time to live, adds to its pool's counters (``LIFECYCLE_DELTAS``, which may be
    negative: a session that comes back is neither expired nor destroyed).

    Exact, as the batch form: a session is created once, each further event
    reuses it, it is closed while its newest event is a purchase and expired while
    the watermark is more than the time to live past it.  A session's state is
    forgotten ``forget_seconds`` after its last event."""
    e = with_event_time(events, "ts").select("session_id", "pool", "template", "kind", F.col("event_id").cast("long").alias("event_id"),
                                             "event_time").withWatermark("event_time", watermark)
    ttl, keep = ttl_seconds * 1000, max(forget_seconds, ttl_seconds + 1) * 1000

    def step(key, pdfs, state):
        had = state.get if state.exists else None
        first, last, last_id, template, uses, closed, expired = had or (0, -1, 0, None, 0, False, False)
        errors = 0
        for pdf in pdfs:
            if not len(pdf):
                continue
            pdf = pdf.sort_values(["event_time", "event_id"])
            us = pdf["event_time"].astype("datetime64[us]").astype("int64")
            first = int(us.iloc[0]) if not uses else min(first, int(us.iloc[0]))
            newest = (int(us.iloc[-1]), int(pdf["event_id"].iloc[-1]))
            if newest > (last, last_id) or not uses:
                last, last_id, template = *newest, pdf["template"].iloc[-1]
            uses += len(pdf)
            errors += int((pdf["kind"] == "error").sum())
        mark = state.getCurrentWatermarkMs()
        now_closed, now_expired = template == "purchase", mark * 1000 > last + ttl * 1000
        old = (1, max(had[4] - 1, 0), int(had[5] or had[6]), int(had[6]), int(not (had[5] or had[6])), 0) if had else (0,) * 6
        new = (1, uses - 1, int(now_closed or now_expired), int(now_expired), int(not (now_closed or now_expired)), errors)
        delta = [b - a for a, b in zip(old, new)]
        if any(delta):
            yield pd.DataFrame([{"session_id": key[0], "pool": key[1], **dict(zip(LIFECYCLE_DELTAS, delta))}])
        if mark > last // 1000 + keep:
            state.remove()
            return
        state.update((first, last, last_id, template, uses, now_closed, now_expired))
        wake = last // 1000 + (keep if now_expired else ttl)
        state.setTimeoutTimestamp(max(wake + 1, mark + 1))

    schema = "session_id string, pool string, " + ", ".join(f"{c} long" for c in LIFECYCLE_DELTAS)
    return e.groupBy("session_id", "pool").applyInPandasWithState(step, schema, LIFECYCLE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def lifecycle_counter_stream(deltas: DataFrame) -> DataFrame:
    """K2, second step: running counters per pool as the sum of the deltas (complete
    or update mode); state is one row per pool."""
    return deltas.groupBy("pool").agg(*[F.sum(c).alias(c) for c in LIFECYCLE_DELTAS])


# ---------------------------------------------------------------- K15
HOLD_STATE = "first_us long, island_start_us long, last_cond boolean"


def hold_alert_stream(samples: DataFrame, key_col: str, cond_col: str, hold_seconds: int,
                      tie_col: str = "event_id") -> DataFrame:
    """K15 stream form: per key, the start of the current run of true
    samples is the only state; a sample fires when the run has lasted at
    least the hold time (samples of a micro-batch are taken in time order)."""
    s = samples.select(F.col(key_col).alias("key"), F.col(tie_col).cast("long").alias("tie"),
                       F.col("ts").cast("timestamp").alias("ts"),
                       F.coalesce(F.col(cond_col), F.lit(False)).alias("c"))
    hold_us = hold_seconds * 1_000_000

    def step(key, pdfs, state):
        rows = [p for p in pdfs]
        if not rows:
            return
        pdf = pd.concat(rows).sort_values(["ts", "tie"])
        first_us, start_us, last_c = state.get if state.exists else (None, None, None)
        us_list = (pdf["ts"].astype("int64") // 1000).tolist()
        firing = []
        for us, c in zip(us_list, pdf["c"].tolist()):
            if first_us is None:
                first_us = us
            if c:
                if start_us is None:
                    start_us = us if last_c is False else first_us if last_c is None else us
                firing.append(us - start_us >= hold_us)
            else:
                start_us = None
                firing.append(False)
            last_c = bool(c)
        state.update((first_us, start_us, last_c))
        yield pd.DataFrame({"key": key[0], "tie": pdf["tie"].values, "ts": pdf["ts"].values, "firing": firing})

    return s.groupBy("key").applyInPandasWithState(step, "key string, tie long, ts timestamp, firing boolean",
                                                   HOLD_STATE, "append", GroupStateTimeout.NoTimeout)
