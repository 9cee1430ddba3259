"""Stand-in views: the driver tables re-shaped into the reference's data model.

Each builder is a pure DataFrame transform over one or two driver tables, so
its cost grows with the tables.  ``vigil.plans.oracle_sql`` holds the same
mappings written as DuckDB SQL for the correctness oracle.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import AS_OF, json_str, ts_ntz


def _k(events: DataFrame) -> Column:
    return json_str("props", "k").try_cast("int")


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def audit_events(events: DataFrame) -> DataFrame:
    """``audit_events`` rows from ``events`` (FIXTURES §2.1)."""
    e = events.select("event_id", "ts", "user_id", "event_type", _k(events).alias("k"))
    et, uid, k = F.col("event_type"), F.col("user_id"), F.col("k")
    actor = (F.when(et == "click", "workflow:executor_dispatch")
             .when(et == "view", "workflow:vector_search")
             .when(et == "purchase", "workflow:memory_ingest")
             .when(et == "signup", "approver:alice")
             .otherwise("workflow:chat_router_v1"))
    action = (F.when(et == "click", "executor_run")
              .when(et == "view", "memory_read")
              .when(et == "purchase", "memory_write")
              .when(et == "signup", "policy_approval")
              .otherwise("chat_router_v1_brain_failure"))
    target = (F.when((et == "signup") & (uid % 3 == 0), F.concat(F.lit("req-other-"), _s(uid)))
              .when(et == "signup", F.concat(F.lit("req-"), _s(uid)))
              .otherwise(F.concat(F.lit("user:"), _s(uid % 20))))
    decision = (F.when(et == "error", F.when(uid % 2 == 0, "kimi").otherwise("openai"))
                .when(et == "signup", F.when(k % 4 == 0, "denied").otherwise("allowed"))
                .when(k < 10, "denied").when(k < 30, "requires_approval")
                .otherwise("allowed"))
    policy = (F.when(k % 25 == 0, F.lit('{"policy_id":"fallback","reasons":["policy_unavailable"]}}'))
              .otherwise(F.lit('{"policy_id":"executor-core-v1"}}')))
    payload = F.concat(F.lit('{"request_id":"req-'), _s(uid), F.lit('","policy":'), policy)
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("t"), _s(uid % 5)).alias("tenant_id"),
        actor.alias("actor"), action.alias("action"), target.alias("target"),
        decision.alias("decision"), payload.alias("payload"),
        F.col("ts").alias("created_at"),
    )


def memory_vectors(embeddings: DataFrame, documents: DataFrame,
                   as_of: _dt.datetime = AS_OF) -> DataFrame:
    """``memory_vectors``: every document, with its embedding where there is
    one (the column is nullable, as in the reference)."""
    e = embeddings.select("vec_id", "embedding", "label")
    # hashed before the join: who asks for the hash alone doesn't shuffle the texts
    d = documents.select("doc_id", "text", "lang", "source", F.sha2(F.col("text"), 256).alias("content_hash"))
    j = d.join(e, e.vec_id == d.doc_id, "left")
    return j.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("t"), _s(F.coalesce(F.col("label").cast("long"), F.col("doc_id")) % 3)).alias("tenant_id"),
        F.col("lang").alias("scope"),
        F.col("text").alias("content"),
        F.col("source"),
        F.array("lang", "source").alias("tags"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        "content_hash",
        (ts_ntz(as_of) - F.make_dt_interval(mins=F.col("doc_id"))).alias("created_at"),
    )


def memory_documents(documents: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """Ingest requests for the cache/dedupe operators: tenant t1, scope = lang."""
    return documents.select(
        F.col("doc_id").alias("id"),
        F.lit("t1").alias("tenant_id"),
        F.col("lang").alias("scope"),
        F.col("text").alias("content"),
        F.col("source"),
        (ts_ntz(as_of) - F.make_dt_interval(mins=F.col("doc_id"))).alias("created_at"),
    )


def table_stats(events: DataFrame) -> DataFrame:
    """A metrics snapshot (one row per relation) derived from ``events``.

    Invented inputs: the monitoring report's ratios and alerts (G6, G7) run over
    a metrics table that its user keeps; this one is made from ``events``.
    """
    k = _k(events)
    return (events.select("event_type", "value", k.alias("k"))
            .groupBy(F.concat(F.col("event_type"), F.lit("_events")).alias("relname"))
            .agg(F.count(F.lit(1)).alias("n_live_tup"),
                 F.count_if(F.col("value") < 5).alias("n_dead_tup"),
                 F.sum("k").cast("long").alias("heap_blks_hit"),
                 F.count_if(F.col("k") < 5).alias("heap_blks_read"),
                 F.count_if(F.col("k") % 2 == 0).alias("seq_scan"),
                 F.count_if((F.col("k") % 2 == 1) & (F.col("k") < 40)).alias("idx_scan")))


def index_stats(events: DataFrame) -> DataFrame:
    """Per-index usage counters, invented from ``events`` as above."""
    k = _k(events)
    suffix = (F.when(F.col("user_id") % 3 == 0, "_embedding")
              .when(F.col("user_id") % 3 == 1, "_tenant_scope").otherwise("_content_hash"))
    return (events.select(F.concat(F.lit("idx_"), F.col("event_type"), suffix).alias("index_name"),
                          k.alias("k"))
            .groupBy("index_name")
            .agg(F.sum("k").cast("long").alias("index_scans"),
                 F.count(F.lit(1)).alias("tuples_read"),
                 F.count_if(F.col("k") > 50).alias("tuples_fetched")))


def daily_sales(orders: DataFrame) -> DataFrame:
    """Daily sales from ``orders``: Sales = orders, Revenue = total price,
    Customers = distinct customers."""
    return (orders.groupBy(F.to_date("o_orderdate").alias("date"))
            .agg(F.count(F.lit(1)).alias("sales"),
                 F.round(F.sum("o_totalprice"), 2).alias("revenue"),
                 F.countDistinct("o_custkey").alias("customers")))


def policy_requests(events: DataFrame, nation: DataFrame) -> DataFrame:
    """Policy-input rows from ``events`` (FIXTURES §2.2): task type from the
    event type (``click`` as ``ping``; ``error`` carries a nation name so the
    registry allow-list takes part; ``signup`` has none), admin scope for
    every 7th user, network on when k%5=0, payload k*2000 bytes."""
    e = events.select("event_id", "user_id", "event_type", "value", _k(events).alias("k"))
    n = nation.select("n_nationkey", "n_name")
    j = e.join(n, (F.col("user_id") % 25) == F.col("n_nationkey"), "left")
    uid, et, k = F.col("user_id"), F.col("event_type"), F.col("k")
    user_scope = F.concat(F.lit("user:"), _s(uid % 20))
    rscope = (F.when(uid % 7 == 0, F.concat(F.lit("admin:"), _s(uid % 20)))
              .when(uid % 11 == 0, F.lit(""))
              .when(uid % 13 == 0, F.concat(F.lit("user:"), _s((uid + 1) % 20)))
              .otherwise(user_scope))
    task = (F.when(et == "click", "ping").when(et == "error", F.col("n_name"))
            .when(et == "signup", "").otherwise(et))
    return j.select(
        F.concat(F.lit("req-"), _s("event_id")).alias("request_id"),
        F.concat(F.lit("t"), _s(uid % 5)).alias("tenant_id"),
        user_scope.alias("subject_scope"),
        F.lit("workflow").alias("role"),
        (uid % 3 == 0).alias("network_admin"),
        rscope.alias("resource_scope"),
        task.alias("task_type"),
        F.when(et == "purchase", "memory.ingest").otherwise("executor.execute").alias("action"),
        (k % 5 == 0).alias("network_enabled"),
        (k * 2000).cast("long").alias("payload_size"),
        F.col("value").alias("latency_ms"),
    )


def policy_workflows(nation: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """Registry rules from ``nation``: one rule per nation, task type = nation
    name, every 4th disabled."""
    nk = F.col("n_nationkey")
    return (nation
            .select(nk.cast("long").alias("id"),
                    F.concat(F.lower(F.regexp_replace("n_name", " ", "_")), F.lit("_v1")).alias("workflow_id"),
                    F.col("n_name").alias("task_type"),
                    F.lit("*").alias("tenant_id"), F.lit("*").alias("scope_pattern"),
                    F.concat(F.lit('{"max_runtime_s":'), _s(nk * 10), F.lit("}")).alias("constraints"),
                    (nk % 4 != 0).alias("enabled"),
                    (ts_ntz(as_of) - F.make_dt_interval(days=nk + 30)).alias("created_at"),
                    (ts_ntz(as_of) - F.make_dt_interval(days=nk)).alias("updated_at")))


def policy_results(events: DataFrame) -> DataFrame:
    """Raw policy-service replies (JSON text) per request, from ``events``:
    complete results, results missing fields, scalar reasons, and missing
    replies (k%25=0) for the fallback path."""
    k = F.col("k")
    ks = _s(k)
    full = F.concat(
        F.lit('{"result":{"policy_id":"executor-core-v1","policy_version":"2026-02-20","decision":"'),
        F.when(k < 10, "deny").otherwise("allow"), F.lit('","allow":'),
        F.when(k < 10, "false").otherwise("true"),
        F.lit(',"requires_approval":false,"risk_score":'), ks, F.lit(',"reasons":'),
        F.when(k < 10, '["task_type_not_allowed","scope_mismatch"]').otherwise("[]"), F.lit("}}"))
    sparse = F.concat(F.lit('{"result":{"decision":"allow","risk_score":'), ks, F.lit("}}"))
    scalar = F.lit('{"result":{"policy_id":"executor-core-v1","policy_version":"2026-02-20",'
                   '"decision":"requires_approval","risk_score":45,"reasons":"high_risk_requires_approval"}}')
    odd = F.lit('{"result":{"decision":"maybe"}}')
    rj = (F.when(k % 25 == 0, F.lit(None).cast("string")).when(k % 7 == 0, sparse)
          .when(k % 3 == 0, scalar).when(k % 11 == 0, odd).otherwise(full))
    return events.select(
        F.concat(F.lit("req-"), _s("event_id")).alias("request_id"),
        F.when(F.col("event_type") == "click", "ping").otherwise(F.col("event_type")).alias("task_type"),
        F.col("value").alias("latency_ms"),
        _k(events).alias("k")).select("request_id", "task_type", "latency_ms", rj.alias("result_json"))


# ------------------------------------------------------------------ request tables
def ingest_requests(documents: DataFrame) -> DataFrame:
    """Memory-ingest requests from ``documents`` with missing fields mixed in."""
    d = F.col("doc_id")
    return documents.select(
        d,
        F.when(d % 50 == 0, F.lit("")).when(d % 45 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("t"), _s(d % 3))).alias("tenant_id"),
        F.when(d % 40 == 0, F.lit("")).otherwise(F.col("lang")).alias("scope"),
        F.col("text"),
        F.when(d % 10 == 0, F.lit("explicit")).when(d % 9 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("source")).alias("source"),
        F.when(d % 4 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("req-doc-"), _s(d))).alias("request_id"),
        F.when(d % 3 == 0, F.lit(None).cast("array<string>")).otherwise(F.array("lang", "source")).alias("tags"),
        F.when(d % 5 == 0, F.lit(None).cast("array<struct<subject:string,predicate:string,object:string,confidence:double>>"))
        .otherwise(F.array(
            F.struct(F.concat(F.lit("doc-"), _s(d)).alias("subject"), F.lit("written_in").alias("predicate"),
                     F.col("lang").alias("object"), (d % 100 / F.lit(100.0)).alias("confidence")),
            F.struct(F.concat(F.lit("doc-"), _s(d)).alias("subject"), F.lit("came_from").alias("predicate"),
                     F.when(d % 7 == 0, F.lit("api_key store")).when(d % 11 == 0, F.lit("")).otherwise(F.col("source")).alias("object"),
                     F.lit(0.9).alias("confidence")))).alias("facts"))


def search_requests(benchmark: DataFrame) -> DataFrame:
    i = F.col("item_id")
    return benchmark.select(
        i, F.concat(F.lit("t"), _s(i % 3)).alias("tenant_id"),
        F.when(i % 9 == 0, F.lit("")).otherwise(F.lit("en")).alias("scope"),
        F.col("text").alias("query"),
        F.when(i % 4 == 0, F.lit(None).cast("int")).when(i % 4 == 1, F.lit(0))
        .when(i % 4 == 2, F.lit(120)).otherwise((i % 12).cast("int")).alias("k"))


def audit_append_requests(events: DataFrame) -> DataFrame:
    a = audit_events(events)
    i = F.col("id")
    uid = F.regexp_extract(F.col("payload"), r'"request_id":"([^"]*)"', 1)
    payload = (F.when(i % 3 == 0, F.concat(F.lit('{"request_id":"'), uid, F.lit('"}')))
               .otherwise(F.concat(F.lit('{"request_id":"'), uid,
                                   F.lit('","policy_id":"executor-core-v1","policy_version":"2026-02-20"}'))))
    return a.select(i, F.when(i % 19 == 0, F.lit("")).otherwise(F.col("actor")).alias("actor"),
                    "action", "target", "decision", payload.alias("payload"))


def dispatch_requests(events: DataFrame) -> DataFrame:
    k = F.col("k")
    task = (F.when(k % 4 == 0, F.lit('"ping"')).when(k % 4 == 1, F.lit("[1,2]"))
            .when(k % 13 == 0, F.lit("{not json"))
            .otherwise(F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('"}'))))
    return (events.select("event_id", "user_id", "event_type", _k(events).alias("k"))
            .select("event_id", F.concat(F.lit("t"), _s(F.col("user_id") % 5)).alias("tenant_id"),
                    F.when(F.col("user_id") % 23 == 0, F.lit("")).otherwise(F.lit("ops")).alias("scope"),
                    task.alias("task")))


def approval_requests(events: DataFrame) -> DataFrame:
    k = F.col("k")
    e = events.select("event_id", "user_id", _k(events).alias("k"))
    return e.select(
        "event_id",
        F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("req-"), _s("user_id")))
        .alias("request_id"),
        F.when(k % 3 == 0, "approved").when(k % 3 == 1, "rejected").otherwise("maybe").alias("decision"),
        F.when(k % 17 == 0, F.lit("")).otherwise(F.lit("alice")).alias("approver"),
        F.when(k % 2 == 0, F.lit("ok")).alias("comment"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit("executor-core-v1")).alias("policy_id"),
        F.lit(None).cast("string").alias("policy_version"))


def rule_upserts(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    s = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left")
    k = F.col("s_suppkey")
    return s.select(
        k,
        F.when(k % 10 == 0, F.lit("  ")).otherwise(F.col("n_name")).alias("task_type"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.lower("s_name"), F.lit(" ")))
        .alias("workflow_id"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.lit("workflow"))
        .when(k % 4 == 2, F.lit("task_type_only")).otherwise(F.lit("")).alias("policy_scope"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit(" t1 ")).alias("tenant_id"),
        F.when(k % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("user:*")).alias("scope_pattern"),
        F.when(k % 3 == 0, F.lit(False)).when(k % 3 == 1, F.lit(None).cast("boolean"))
        .otherwise(F.lit(True)).alias("enabled"),
        F.lit(None).cast("string").alias("actor"))


def conversation_requests(conversations: DataFrame) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    return conversations.select(
        c, t, F.col("role"),
        F.when(c % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("t"), _s(c % 3))).alias("tenant_id"),
        F.when(t == 0, F.lit("")).otherwise(F.concat(F.lit("conv:"), _s(c))).alias("scope"),
        F.when(t % 3 == 2, F.lit(None).cast("string")).otherwise(F.col("text")).alias("message"),
        F.when(F.col("role") == "user", F.col("text")).alias("text"),
        F.when(t % 4 == 0, F.lit("OpenAI")).when(t % 4 == 1, F.lit(None).cast("string"))
        .when(t % 4 == 2, F.lit("bogus")).otherwise(F.lit("none")).alias("provider"),
        F.when(t % 5 == 0, F.lit("custom/model")).alias("model"),
        F.when(t % 2 == 0, F.lit(0.7)).alias("temperature"),
        F.when((t % 5 == 0), F.lit(None).cast("int")).when(t % 5 == 1, F.lit(0))
        .when(t % 5 == 2, F.lit(25)).otherwise(t.cast("int")).alias("k"),
        F.when(c % 6 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("U"), _s(c))).alias("user_id"))


def metadata_responses(conversations: DataFrame) -> DataFrame:
    """Mail-metadata replies in the shapes that the poller meets: a full
    response with a JSON body text, one with broken text, a numeric status,
    an API error in the body, a bare object."""
    c, t = F.col("conv_id"), F.col("turn")
    body = F.to_json(F.struct(F.concat(_s(c), F.lit("-"), _s(t)).alias("id"), F.col("text").alias("snippet")))
    quoted = F.to_json(F.struct(F.lit(200).alias("statusCode"), body.alias("body")))
    broken = F.to_json(F.struct(F.lit(200).alias("statusCode"), F.concat(F.lit("{"), F.col("text")).alias("body")))
    api = F.concat(F.lit('{"statusCode":200,"body":"{\\"error\\":{\\"code\\":403,\\"message\\":\\"denied '), _s(c), F.lit('\\"}}"}'))
    return conversations.select(c, t, F.when(t % 5 == 0, quoted).when(t % 5 == 1, broken).when(t % 5 == 2, api)
                                .when(t % 5 == 3, F.lit('{"status":503,"message":"unavailable"}')).otherwise(body).alias("response"))


def file_manifest(pages: DataFrame) -> DataFrame:
    """Sandbox file writes from ``pages``: path = URL tail, size = HTML bytes."""
    return pages.select(
        "page_id",
        F.regexp_extract(F.col("url"), r"^[a-z]+://[^/]+/(.*)$", 1).alias("path"),
        (F.col("page_id") % 8).alias("sandbox"),
        F.col("page_id").alias("seq"),
        F.octet_length("html").cast("long").alias("size_bytes"))


def template_rows(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        k,
        F.when(k % 7 == 0, F.lit("")).otherwise(F.col("p_name")).alias("name"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.lit("python:3.11-slim")).alias("base_image"),
        F.when(k % 4 == 0, F.concat(_s("p_size"), F.lit("m"))).when(k % 4 == 1, F.concat(_s("p_size"), F.lit("G")))
        .when(k % 4 == 2, F.concat(_s("p_size"), F.lit("mb"))).otherwise(F.lit("lots")).alias("memory_limit"),
        (F.col("p_size") * 80).alias("timeout"))


def candidate_seeds(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        k,
        F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("task_type"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("tenant_id"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("size:"), _s("p_size")))
        .alias("scope"),
        F.lit(None).cast("string").alias("summary"),
        F.when(k % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("ok")).alias("outcome"))


def recipient_lists(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@mail.example.com;"),
                   F.when(k % 3 == 0, F.lit(" bad-address, ")).otherwise(F.lit(",")),
                   F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("ops"), _s("c_nationkey"),
                                                                     F.lit("@corp.example.org"))))
    raw = F.when(k % 11 == 0, F.lit("nobody, ;")).otherwise(raw)
    return customer.select(k, raw.alias("recipient"))


# ------------------------------------------------------------------ registry side tables
def workflow_entity(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Workflow definitions known to the orchestrator: one per supplier,
    named after the supplier's nation, every 6th after the supplier itself
    (those are in no registry)."""
    k = F.col("s_suppkey")
    s = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left")
    base = F.when(k % 6 == 0, F.lower("s_name")).otherwise(F.lower(F.regexp_replace("n_name", " ", "_")))
    return s.select(F.concat(base, F.lit("_v1")).alias("name"),
                    F.when(k % 9 == 0, F.lit(False)).when(k % 4 == 0, F.lit(None).cast("boolean"))
                    .otherwise(F.lit(True)).alias("active"))


def candidate_events(supplier: DataFrame, nation: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    k = F.col("s_suppkey")
    s = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left")
    return s.select(k.alias("id"),
                    F.when(k % 8 == 0, F.lit(None).cast("string")).when(k % 5 == 0, F.col("s_name"))
                    .otherwise(F.col("n_name")).alias("task_type"),
                    F.concat(F.lit("t"), _s(k % 3)).alias("tenant_id"), F.lit("*").alias("scope"),
                    F.lit("seed").alias("source"),
                    (ts_ntz(as_of) - F.make_dt_interval(hours=k)).alias("created_at"))


def revision_rows(nation: DataFrame) -> DataFrame:
    """Published revisions in row form: revision ``rev-<region>`` holds the
    rules of that region's nations."""
    rules = policy_workflows(nation).join(nation.select(F.col("n_nationkey").cast("long").alias("id"),
                                                        "n_regionkey"), "id")
    return rules.select(F.concat(F.lit("rev-"), _s("n_regionkey")).alias("revision_id"),
                        "workflow_id", "task_type", "tenant_id", "scope_pattern", "constraints", "enabled")


def revisions(region: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    r = F.col("r_regionkey")
    return region.select(
        F.concat(F.lit("rev-"), _s(r)).alias("revision_id"), F.lit("published").alias("status"),
        (ts_ntz(as_of) - F.make_dt_interval(days=F.lit(5) - r)).alias("published_at"),
        (r == 2).alias("is_active"))


def mail_items(conversations: DataFrame) -> DataFrame:
    """Mail metadata from ``conversations``: id = conv_id-turn, internalDate
    in turn order, headers as an array of structs."""
    c, t = F.col("conv_id"), F.col("turn")
    headers = F.array(
        F.struct(F.lit("From").alias("name"), F.concat(F.col("role"), F.lit("@example.com")).alias("value")),
        F.struct(F.when(t % 2 == 0, F.lit("subject")).otherwise(F.lit("Subject")).alias("name"),
                 F.col("text").alias("value")),
        F.struct(F.lit("Date").alias("name"), F.concat(F.lit("2024-01-"), F.lpad(_s(c % 28 + 1), 2, "0")).alias("value")))
    headers = F.when(t % 7 == 3, F.slice(headers, 1, 1)).otherwise(headers)
    return conversations.select(
        F.concat(_s(c), F.lit("-"), _s(t)).alias("id"), F.concat(F.lit("thr-"), _s(c)).alias("thread_id"),
        (c * 1000 + t).alias("internal_date"), F.col("text").alias("snippet_source"), headers.alias("headers"))


# ------------------------------------------------------------------ router / feed inputs
def router_responses(conversations: DataFrame) -> DataFrame:
    """Model-service replies per conversation turn: success, provider error,
    empty choice, and bare HTTP failures."""
    c, t = F.col("conv_id"), F.col("turn")
    content = F.to_json(F.struct(F.col("text").alias("content")))
    body = (F.when(t % 4 == 0, F.concat(F.lit('{"choices":[{"message":'), content, F.lit("}]}")))
            .when(t % 4 == 1, F.concat(F.lit('{"error":{"message":"rate limited '), _s(c), F.lit('"}}')))
            .when(t % 4 == 2, F.lit('{"choices":[{"message":{}}]}')).otherwise(F.lit("{}")))
    return conversations.select(
        c, t, F.col("text"), body.alias("body"),
        F.when(t % 4 == 0, 200).when(t % 4 == 1, 429).when(t % 4 == 2, 0).otherwise(502).alias("status_code"),
        F.when((t % 4 == 3) & (c % 2 == 0), F.lit("upstream timeout")).alias("http_error"),
        F.when((t % 4 == 3) & (c % 3 == 0), F.lit("bad gateway")).alias("http_message"))


def router_audit(events: DataFrame) -> DataFrame:
    """Router audit rows from ``events``: completions with the packed
    decision string, and provider failures (error events)."""
    uid = F.col("user_id")
    prov = F.when(uid % 2 == 0, F.lit("kimi")).otherwise(F.lit("openai"))
    model = F.when(uid % 3 == 0, F.lit("moonshot:v1-8k")).otherwise(F.lit("gpt-4o-mini"))
    attempt = F.when(uid % 5 == 0, F.lit("2")).otherwise(F.lit("1"))
    packed = F.concat(prov, F.lit(":"), model, F.lit(":attempt"), attempt, F.lit(":hash"),
                      F.sha2(_s("event_id"), 256), F.lit(":len"), _s(F.col("event_id") % 997),
                      F.lit(":latency"), _s(F.floor("value").cast("int")))
    err = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("t"), _s(uid % 5)).alias("tenant_id"),
        F.lit("workflow:chat_router_v1").alias("actor"),
        F.when(err, "chat_router_v1_brain_failure").otherwise("chat_completion").alias("action"),
        F.concat(F.lit("user:"), _s(uid % 20)).alias("target"),
        F.when(err, prov).otherwise(packed).alias("decision"), F.col("ts").alias("created_at"))


def list_responses(conversations: DataFrame) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    mid = lambda x: F.concat(F.lit('{"id":"'), _s(c), F.lit("-"), _s(t), F.lit(x), F.lit('","threadId":"thr-'),
                              _s(c), F.lit('"}'))
    body = (F.when(t % 3 == 0, F.concat(F.lit('{"messages":['), mid("a"), F.lit(","), mid("b"),
                                        F.lit('],"resultSizeEstimate":2}')))
            .when(t % 3 == 1, F.lit('{"resultSizeEstimate":0}'))
            .otherwise(F.concat(F.lit('{"messages":['), mid("a"), F.lit('],"resultSizeEstimate":1}'))))
    resp = (F.when(t % 4 == 0, F.lit('{"statusCode":200,"body":{}}'))
            .when(t % 4 == 1, F.lit('{"status":503,"message":"unavailable"}'))
            .when(t % 4 == 2, F.lit('{"messages":[],"resultSizeEstimate":0}'))
            .otherwise(F.lit('{"error":"boom"}')))
    raw = (F.when(t % 4 == 0, F.lit("")).when(t % 4 == 1, F.concat(F.lit('{"id":"'), _s(c), F.lit('"}')))
           .when(t % 4 == 2, F.lit("{broken")).otherwise(F.col("text")))
    return conversations.select(c, t, body.alias("body"), resp.alias("response"), raw.alias("raw"))


def kev_feed(part: DataFrame) -> DataFrame:
    """Known-exploited list entries from ``part`` (list order = p_partkey)."""
    k = F.col("p_partkey")
    desc = F.concat(F.lit("  "), F.col("p_type"), F.lit("\t\t"), F.col("p_name"), F.lit("  "),
                    F.repeat(F.lit("x "), F.col("p_size") * 4))
    return part.select(k.alias("pos"), F.concat(F.lit("CVE-2024-"), F.lpad(_s(k), 5, "0")).alias("cveID"),
                       F.col("p_brand").alias("vendorProject"), F.col("p_name").alias("product"),
                       F.concat(F.lit("2024-02-"), F.lpad(_s(F.col("p_size") % 28 + 1), 2, "0")).alias("dueDate"),
                       F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(desc).alias("shortDescription"))


def nvd_feed(part: DataFrame) -> DataFrame:
    """New-CVE list entries from ``part``: score = p_size / 5."""
    k = F.col("p_partkey")
    score = F.col("p_size") / F.lit(5.0)
    return part.select(
        k.alias("pos"), F.concat(F.lit("CVE-2023-"), F.lpad(_s(k), 5, "0")).alias("id"),
        F.concat(F.lit("2024-01-"), F.lpad(_s(F.col("p_size") % 28 + 1), 2, "0"), F.lit("T10:00:00.000"))
        .alias("published"),
        F.when(k % 3 == 0, score).alias("cvss_v31"), F.when(k % 3 == 1, score).alias("cvss_v30"),
        F.when(k % 6 == 2, score).alias("cvss_v2"),
        F.array(F.struct(F.lit("es").alias("lang"), F.concat(F.lit("es: "), F.col("p_name")).alias("value")),
                F.struct(F.lit("en").alias("lang"),
                         F.concat(F.col("p_name"), F.lit("  "), F.col("p_type")).alias("value"))).alias("descriptions"))


# ------------------------------------------------------------------ telemetry inputs
def session_events(events: DataFrame) -> DataFrame:
    """Session activity from ``events``: session = user, pool = user % 4."""
    uid = F.col("user_id")
    return events.select(
        "event_id", "ts", F.concat(F.lit("sess-"), _s(uid)).alias("session_id"),
        F.concat(F.lit("pool-"), _s(uid % 4)).alias("pool"),
        F.concat(F.lit("pod-"), _s(uid % 4), F.lit("-"), _s(F.col("event_id") % 3)).alias("pod"),
        F.col("event_type").alias("template"),
        F.when(F.col("event_type") == "error", "error").otherwise("use").alias("kind"))


def probe_samples(events: DataFrame) -> DataFrame:
    """Pool health probes from ``events``: status 500 for error events, a
    timeout (null) for every 10th view, cpu = 7k mod 100, memory = k."""
    k = F.col("k")
    et = F.col("event_type")
    return events.select("event_id", "ts", "user_id", "event_type", "value", _k(events).alias("k")).select(
        "event_id", "ts", F.concat(F.lit("pool-"), _s(F.col("user_id") % 4)).alias("pool"),
        F.when(et == "error", F.lit(500)).when((et == "view") & (k % 10 == 0), F.lit(None).cast("int"))
        .otherwise(F.lit(200)).alias("probe_status"),
        ((k * 7) % 100).alias("cpu"), k.alias("mem"), (F.col("value") * 10).alias("elapsed_ms"),
        F.floor("value").cast("long").alias("counter"))


def pool_snapshot(probes_classified: DataFrame, events: DataFrame) -> DataFrame:
    """One row per pool: latest probe result plus capacity attributes
    (sessions = distinct users seen; the rest from the pool number)."""
    latest = (probes_classified.groupBy("pool")
              .agg(F.max_by(F.struct("status", "response_time_ms", "mem", "probe_status"),
                            F.struct("ts", "event_id")).alias("_p"))
              .select("pool", "_p.*"))
    sess = events.groupBy(F.concat(F.lit("pool-"), _s(F.col("user_id") % 4)).alias("pool")).agg(
        F.countDistinct("user_id").alias("current_sessions"))
    p = F.substring(F.col("pool"), 6, 4).cast("int")
    return latest.join(sess, "pool", "left").select(
        F.col("pool").alias("name"),
        F.when(p % 2 == 0, F.lit("us-east")).otherwise(F.lit("eu-west")).alias("region"),
        (p % 3 + 1).cast("double").alias("weight"), (p % 2).alias("priority"), F.lit(40).alias("max_sessions"),
        F.coalesce(F.col("current_sessions"), F.lit(0)).alias("current_sessions"),
        F.col("mem").alias("queue_depth"), "status", "response_time_ms",
        F.when(F.col("probe_status") == 500, F.lit("open")).otherwise(F.lit("closed")).alias("breaker_state"),
        (p % 3 + 2).alias("current_replicas"))


def exec_results(conversations: DataFrame) -> DataFrame:
    """Sandbox execution results from ``conversations``: every third turn
    fails with a Python traceback."""
    c, t = F.col("conv_id"), F.col("turn")
    tb = F.concat(F.lit("warn: deprecated\nTraceback (most recent call last):\n  File \"main.py\", line "), _s(t),
                  F.lit("\n    "), F.col("text"), F.lit("\nValueError: bad value "), _s(c), F.lit("\n"))
    stderr = F.when(t % 3 == 0, tb).when(t % 3 == 1, F.concat(F.lit("note: "), _s(c))).otherwise(F.lit(""))
    ext = (F.when(c % 5 == 0, ".png").when(c % 5 == 1, ".jpg").when(c % 5 == 2, ".jpeg").when(c % 5 == 3, ".svg")
           .otherwise(".json"))
    fname = F.concat(F.lit("plot_"), _s(t), ext)
    return conversations.select(
        c, t, F.when(t % 3 == 0, 1).otherwise(0).alias("exit_code"), stderr.alias("stderr"),
        F.when(t % 4 == 0, F.lit("")).otherwise(F.col("text")).alias("stdout"),
        (F.length("text") / F.lit(1000.0)).alias("execution_time"), fname.alias("filename"))
