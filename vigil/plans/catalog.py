"""Query catalog: every registered job reads the driver tables of ``sf_dir``
(whole tables) and returns a DataFrame whose column names match the DuckDB
oracle in ``oracle_sql.SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators import analytics as an
from ..sources import standins as si
from ..sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir, _fn=fn: _fn(Tables(spark, sf_dir))
        return fn
    return deco


def _audit(t: Tables) -> DataFrame:
    return si.audit_events(t.events)


# ---------------------------------------------------------------- F
@register("f1_decision_distribution")
def _f1(t): return an.decision_distribution(_audit(t))


@register("f2_approval_rate_by_day")
def _f2(t): return an.approval_rate_by_day(_audit(t))


@register("f3_deny_rate_by_scope")
def _f3(t): return an.deny_rate_by_scope(_audit(t))


@register("f4_policy_unavailable_by_day")
def _f4(t): return an.policy_unavailable_by_day(_audit(t))


@register("f5_approval_sla")
def _f5(t): return an.approval_sla(_audit(t))


def _vectors(t: Tables) -> DataFrame:
    return si.memory_vectors(t.embeddings, t.documents)


# ---------------------------------------------------------------- G
@register("g1_storage_stats")
def _g1(t): return an.storage_stats(_vectors(t))


@register("g2_top_scopes")
def _g2(t): return an.top_scopes(_vectors(t))


def _sketches(t: Tables) -> DataFrame:
    path = _scratch(t, "sketches")
    an.hourly_sketches(_vectors(t)).write.parquet(path)
    return t.spark.read.parquet(path)


def _close(estimate: str, exact: DataFrame) -> Column:
    """Whether an estimate is within three standard errors of the exact number."""
    n = exact.scalar()
    return F.abs(F.col(estimate) - n) <= F.greatest(F.lit(1.0), F.lit(3 * 1.04 / 2 ** (an.SKETCH_LG / 2)) * n)


@register("g1_sketched_stats")
def _g1s(t):
    """G1 from stored hourly sketches."""
    s = an.sketched_storage_stats(_sketches(t))
    close = _close("unique_contents", _vectors(t).agg(F.countDistinct("content_hash")))
    return s.withColumn("contents_close", close).drop("unique_contents")


@register("g2_sketched_scopes")
def _g2s(t):
    """G2 from stored hourly sketches."""
    return an.sketched_top_scopes(_sketches(t)).drop("unique_contents")


@register("g3_recent_vectors")
def _g3(t): return an.recent_vectors(_vectors(t))


@register("g4_hourly_ingest")
def _g4(t): return an.hourly_ingest(_vectors(t))


@register("g5_audit_summary")
def _g5(t): return an.audit_summary(_audit(t))


@register("g6_table_health")
def _g6(t): return an.table_health(si.table_stats(t.events))


@register("g7_health_alerts")
def _g7(t): return an.health_alerts(si.table_stats(t.events))


@register("g8_top_indexes")
def _g8(t): return an.top_indexes(si.index_stats(t.events))


# ---------------------------------------------------------------- L
@register("l1_rolling_mean")
def _l1(t): return an.rolling_mean(si.daily_sales(t.orders))


@register("l2_summary_stats")
def _l2(t):
    s = an.summary_stats(si.daily_sales(t.orders))
    return s.select("metric", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


LINE_METRICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("l2_line_stats")
def _l2b(t):
    """L2 over the largest table."""
    s = an.summary_stats(t.lineitem, LINE_METRICS)
    return s.select("metric", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@register("l3_headline_totals")
def _l3(t): return an.headline_totals(si.daily_sales(t.orders))


@register("l4_histogram_price_30")
def _l4a(t): return an.histogram(t.lineitem, "l_extendedprice", 30)


@register("l4_histogram_acctbal_20")
def _l4b(t): return an.histogram(t.customer, "c_acctbal", 20)


@register("l5_mean_pop_std")
def _l5(t):
    return an.mean_and_pop_std(t.lineitem, "l_quantity").select(F.round("mean", 9).alias("mean"),
                                                                 F.round("std_pop", 9).alias("std_pop"))


# ---------------------------------------------------------------- C
from ..operators import policy as pol  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def _decisions(t: Tables) -> DataFrame:
    return pol.evaluate(si.policy_requests(t.events, t.nation), si.policy_workflows(t.nation))


@register("c1_c5_policy_decision")
def _c1(t):
    return _decisions(t).select("request_id", "risk_score", F.array_join("reasons", ",").alias("reasons"),
                                "requires_approval", "allow", "decision", "policy_id", "policy_version")


def _normalized(t: Tables) -> DataFrame:
    return pol.normalize_result(si.policy_results(t.events))


@register("c6_normalize_result")
def _c6(t):
    return _normalized(t).select("request_id", "policy_id", "policy_version", "decision", "allow",
                                 "requires_approval", "risk_score",
                                 F.array_join("reasons", ",").alias("reasons"))


def _with_fallback(t: Tables, mode: str) -> DataFrame:
    n = _normalized(t)
    # a missing reply has no result: blank the normalised fields so C7 applies
    miss = F.col("result_json").isNull()
    cols = ["policy_id", "policy_version", "decision", "allow", "requires_approval", "risk_score", "reasons"]
    n = n.select("request_id", "task_type", "latency_ms", "result_json",
                 *[F.when(~miss, F.col(c)).alias(c) for c in cols])
    return pol.fallback(n, mode)


@register("c7_fallback_closed")
def _c7(t):
    return _with_fallback(t, "closed").select(
        "request_id", "policy_id", "decision", "allow", "requires_approval", "risk_score",
        F.array_join("reasons", ",").alias("reasons"), "policy_unavailable")


@register("c8_workflow_gate")
def _c8(t):
    n = _normalized(t)
    n = n.withColumn("decision", F.when(F.col("result_json").isNotNull(), F.col("decision")))
    return pol.workflow_gate(n).select("request_id", "gate_decision", "status", "message",
                                       "approval_endpoint", "gate_reason")


@register("c9_enforce_mode")
def _c9(t):
    return pol.enforce(_with_fallback(t, "open"), "enforce").select("request_id", "decision")


@register("c10_runtime_gate")
def _c10(t):
    d = _decisions(t)
    return pol.runtime_gate(pol.enforce(d, "enforce")).select("request_id", "task_type", "runtime_accepted")


@register("c11_decision_counters")
def _c11(t):
    c = pol.decision_counters(_with_fallback(t, "open"))
    return c.withColumn("latency_sum", F.round("latency_sum", 6))


# ---------------------------------------------------------------- B
from ..operators import validate as va  # noqa: E402


@register("b1_validate_ingest")
def _b1(t):
    return va.validate_ingest(si.ingest_requests(t.documents)).select(
        "doc_id", "error", "source_norm", "request_id_norm", F.array_join("tags_norm", ",").alias("tags"),
        F.array_join(F.transform("facts_norm", lambda f: F.concat_ws(" ", f["subject"], f["predicate"], f["object"])), ";").alias("facts"))


@register("b2_validate_search")
def _b2(t):
    return va.validate_search(si.search_requests(t.benchmark)).select("item_id", "error", "k_norm")


@register("b3_validate_audit")
def _b3(t):
    return va.validate_audit(si.audit_append_requests(t.events)).select("id", "error")


@register("b4_validate_dispatch")
def _b4(t):
    return va.validate_dispatch(si.dispatch_requests(t.events)).select("event_id", "error")


@register("b5_validate_approval")
def _b5(t):
    return va.validate_approval(si.approval_requests(t.events)).select(
        "event_id", "error", "audit_decision", "audit_actor", "comment_norm", "policy_id_norm",
        "policy_version_norm")


@register("b6_normalize_rule_upsert")
def _b6(t):
    r = si.rule_upserts(t.supplier, t.nation)
    n = va.normalize_rule_upsert(r.withColumn("actor", F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string"))))
    return n


@register("b7_validate_rule_key")
def _b7(t):
    s = t.supplier
    k = F.col("s_suppkey")
    req = s.select(k, F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.lower("s_name")).alias("workflow_id"),
                   F.when(k % 6 == 0, F.lit(" ")).otherwise(F.lit("ping")).alias("task_type"))
    return va.validate_rule_key(req).select("s_suppkey", "workflow_id_norm", "task_type_norm", "error")


@register("b8_candidate_seed_defaults")
def _b8(t):
    return va.candidate_seed_defaults(si.candidate_seeds(t.part))


@register("b9_normalize_router_input")
def _b9(t):
    return va.normalize_router_input(si.conversation_requests(t.conversations)).select(
        "conv_id", "turn", "tenant_norm", "scope_norm", F.length("message_norm").alias("message_chars"),
        "provider_norm", "model_norm", "temperature_norm", "validation_errors")


@register("b10_chat_input_guard")
def _b10(t):
    return va.chat_input_guard(si.conversation_requests(t.conversations)).select(
        "conv_id", "turn", "error", "tenant_norm", "scope_norm",
        F.length("message_norm").alias("message_chars"), "k_norm")


@register("b11_parse_form_body")
def _b11(t):
    p = F.col("page_id")
    own = F.when(p % 4 == 0, F.create_map(F.lit("user_id"), F.concat(F.lit("U"), p.cast("string")), F.lit("ref"), F.lit("top")))
    raw = F.when(p % 3 == 0, F.concat(F.lit("extra=a%20b&ref=raw&extra="), p.cast("string"), F.lit("&bad=%zz")))
    q = t.pages.select("page_id", F.regexp_extract("url", r"\?([^#]*)", 1).alias("body"), raw.alias("raw_body"), own.alias("fields"))
    entries = F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return va.parse_form_body(q, raw_col="raw_body", fields_col="fields").select("page_id", F.array_join(F.array_sort(entries), "&").alias("params_text"))


@register("b12_slack_scope")
def _b12(t):
    req = si.conversation_requests(t.conversations).select("conv_id", "turn", "user_id")
    return va.slack_scope(req).select("conv_id", "turn", "tenant_id", "scope", "user_id_norm")


@register("b13_secret_rejection")
def _b13(t):
    return va.secret_rejections(t.documents, "doc_id")


@register("b14_fact_filter")
def _b14(t):
    facts = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("subject"),
        F.col("l_returnflag").alias("predicate"), F.col("l_linestatus").alias("object"),
        (F.lit(1.0) - F.col("l_discount") * 5).alias("confidence"),
        F.when(F.col("l_orderkey") % 10 == 0, "explicit").otherwise("api").alias("request_source"))
    return va.filter_facts(facts).select("l_orderkey", "l_linenumber", "subject", "predicate", "object",
                                         F.round("confidence", 6).alias("confidence"))


@register("b15_redact_injection")
def _b15(t):
    c = t.conversations
    return c.select("conv_id", "turn", va.redact_injection("text").alias("redacted"))


@register("b16_secret_line_scan")
def _b16(t): return va.secret_line_scan(t.documents, "doc_id", "text")


@register("b17_credential_key_scan")
def _b17(t):
    leak = F.when(F.col("page_id") % 6 == 0, F.concat(F.lit('\n{"clientSecret": "'), F.col("url"), F.lit('"}\n{"PrivateKey":1}'))).otherwise("")
    return va.credential_key_scan(t.pages.withColumn("html", F.concat("html", leak)), "page_id", "html")


@register("b18_sensitive_file_scan")
def _b18(t):
    return va.sensitive_file_scan(si.file_manifest(t.pages)).select("page_id", "path", "secret_like", "env_file")


@register("b19_suspicious_diff_scan")
def _b19(t): return va.suspicious_diff_scan(t.documents, "doc_id", "text")


@register("b20_path_safety")
def _b20(t): return va.path_safety(si.file_manifest(t.pages)).select("page_id", "path", "path_error")


@register("b21_size_quotas")
def _b21(t):
    # files 3000 times as large, so that sandboxes run over their quota
    m = si.file_manifest(t.pages).withColumn("size_bytes", F.col("size_bytes") * 3000)
    return va.size_quotas(m).select(
        "page_id", "sandbox", "size_bytes", "file_ok", "running_total", "accepted")


@register("b22_sanitize_error")
def _b22(t):
    c = t.conversations
    return c.select("conv_id", "turn", va.sanitize_error(F.col("text")).alias("sanitized"))


@register("b23_template_errors")
def _b23(t): return va.template_errors(si.template_rows(t.part)).select("p_partkey", "errors", "valid")


@register("b24_rule_search")
def _b24(t):
    return va.rule_search(si.policy_workflows(t.nation), "Nation_1", enabled_only=True).select(
        "id", "workflow_id", "task_type")


@register("b25_split_recipients")
def _b25(t):
    r = si.recipient_lists(t.customer)
    return r.select("c_custkey", va.split_recipients("recipient").alias("recipients"))


@register("b26_html_escape")
def _b26(t):
    html = F.col("html")
    return t.pages.select("page_id", va.html_escape_mail(html).alias("mail_escaped"),
                          va.html_escape_full(html).alias("full_escaped"))


@register("b27_mime_subject")
def _b27(t):
    text = F.col("text")
    return t.documents.select("doc_id", va.mime_subject(text).alias("subject"),
                              va.base64url(text).alias("text_b64url"))


# ---------------------------------------------------------------- D
from ..operators import vectors as vx  # noqa: E402
from ..functions.vectors import l2_norm as _l2  # noqa: E402

TOPK = 5


@register("d1_content_hash")
def _d1(t): return vx.content_hash(t.documents, "text").select("doc_id", "content_hash")


@register("d2_cache_lookup")
def _d2(t):
    """Ingest requests against the stored table."""
    req = vx.content_hash(si.ingest_requests(t.documents).withColumnRenamed("text", "content"))
    found = vx.cache_lookup(req, _vectors(t))
    return found.select("doc_id", "tenant_id", "scope", "content_hash", "cached", "cached_id",
                        F.when(F.col("cached_embedding").isNotNull(), F.size("cached_embedding")).alias("cached_dims"))


@register("d2_first_seen")
def _d2f(t):
    docs = vx.content_hash(si.memory_documents(t.documents))
    return vx.first_seen_cache(docs).select("id", "tenant_id", "scope", "content_hash", "cached")


@register("d3_idempotent_insert")
def _d3(t):
    batch = vx.content_hash(si.memory_documents(t.documents))
    return vx.idempotent_insert(batch, _vectors(t)).select("id", "tenant_id", "scope", "content_hash")


@register("d4_truncate")
def _d4(t):
    e = vx.truncate(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), 16)
    return e.select("vec_id", F.size("embedding").alias("dims"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_values"))


@register("d9_l2_normalize")
def _d9(t):
    e = vx.normalize(t.embeddings.select("vec_id", (F.col("embedding").cast("array<double>")).alias("embedding")))
    return e.select("vec_id", (F.round(_l2("embedding"), 6) + F.lit(0.0)).alias("norm"),
                    (F.round(F.try_element_at("embedding", F.lit(1)), 6) + F.lit(0.0)).alias("x1"))


def _queries(mv: DataFrame, t: Tables) -> DataFrame:
    """Search requests: the vectors that ``benchmark`` names, as queries."""
    asked = t.benchmark.select(F.col("item_id").alias("id"))
    return (mv.where(F.col("embedding").isNotNull()).join(asked, "id", "left_semi")
            .select(F.col("id").alias("query_id"), "tenant_id", "scope", F.col("embedding").alias("query_vec")))


def _exact_matches(t: Tables) -> DataFrame:
    mv = _vectors(t)
    return vx.exact_topk(_queries(mv, t), mv, TOPK)


def _shown(m: DataFrame) -> DataFrame:
    return m.select("query_id", "rank", "id", (F.round("cosine_distance", 6) + F.lit(0.0)).alias("cosine_distance"))


@register("d10_d11_topk_exact")
def _d11(t): return _shown(_exact_matches(t))


@register("d10_d11_topk_blocked")
def _d11b(t):
    """The same search as a large batch of requests takes it."""
    mv = _vectors(t)
    return _shown(vx.blocked_topk(_queries(mv, t), mv, TOPK))


def _ivf(t: Tables):
    """Index of all vectors with the lists of the guidance, its queries and
    its probes: (vectors, index, queries, lists, probes)."""
    mv = _vectors(t).where(F.col("embedding").isNotNull())
    n = mv.count()
    lists = vx.ivf_lists(n)
    return mv, vx.ivf_build(mv.drop("content", "tags"), lists, _scratch(t, "ivf")), _queries(mv, t), lists, vx.ivf_probes(lists, n)


@register("d12_ivf_all_lists")
def _d12a(t):
    """With every list among the probes the index search is the exact one."""
    _, index, q, lists, _ = _ivf(t)
    return _shown(vx.ivf_search(q, index, TOPK, lists + 1)[0])


@register("d12_ivf_certain")
def _d12b(t):
    """Read as far as the bound asks, the index gives the exact result."""
    _, index, q, _, probes = _ivf(t)
    return _shown(vx.ivf_search(q, index, TOPK, probes, certain=True)[0])


@register("d12_ivf_recall")
def _d12(t):
    """Recall at the lists and probes of the guidance, and the share read."""
    mv, index, q, lists, probes = _ivf(t)
    approx, probed = vx.ivf_search(q, index, TOPK, probes)
    recall = vx.recall_at_k(approx, vx.exact_topk(q, mv, TOPK), TOPK)
    share = vx.share_read(q, mv, probed).first()[0]
    return recall.select("*", F.lit(lists).alias("lists"), F.lit(probes).alias("probes"), F.lit(share).alias("share_read"))


@register("d13_keyword_search")
def _d13(t):
    mv = _vectors(t)
    index = vx.trigram_index(mv, _scratch(t, "trigrams"))
    return vx.keyword_search_indexed(index, mv, "t1", "en", "ing", 5).select("id", "tenant_id", "scope", "created_at")


@register("d13_keyword_scan")
def _d13s(t):
    """The same search without an index."""
    return vx.keyword_search(_vectors(t), "t1", "en", "ing", 5).select("id", "tenant_id", "scope", "created_at")


KEYWORD_TERMS = ("Tion", "ou th", "e, 5%", "qzx")


@register("d13_rows_read")
def _d13r(t):
    mv = _vectors(t)
    return vx.keyword_report(vx.trigram_index(mv, _scratch(t, "trigrams")), mv, "t1", "en", list(KEYWORD_TERMS))


def _mixed_widths(t: Tables) -> DataFrame:
    """Vectors as clients send them: every 7th has half the width, and some
    documents have none."""
    mv = _vectors(t)
    return mv.select("id", F.when(F.col("id") % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))


@register("d14_dimension_check")
def _d14(t): return vx.dimension_check(_mixed_widths(t), 64)


@register("d15_vector_text")
def _d15(t):
    e = vx.vector_text(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")))
    back = F.transform(F.split(F.regexp_extract("embedding_text", r"^\[(.*)\]$", 1), ","), lambda x: x.cast("double"))
    return e.select("vec_id", F.size(back).alias("dims"), (back == F.col("embedding")).alias("same"))


@register("d16_dimension_reject")
def _d16(t):
    ok, bad = vx.split_by_dimension(_mixed_widths(t), 64)
    return bad.select("id", "reject_reason")


def _matches_with_content(t: Tables) -> DataFrame:
    """Top-k matches with their content, redacted where it is used."""
    found = vx.matched_rows(_exact_matches(t), _vectors(t), "content")
    return found.withColumn("content", va.redact_injection("content"))


@register("d17_context_assembly")
def _d17(t):
    m = _matches_with_content(t)
    c = vx.assemble_context(m)
    return c.select("query_id", "context_count", F.length("context_text").alias("context_chars"),
                    F.sha2("context_text", 256).alias("context_sha256"))


@register("b28_search_response")
def _b28(t):
    mv = _vectors(t)
    asked = _queries(mv, t).join(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    r = vx.search_response(asked.withColumn("k_norm", F.lit(TOPK)), _exact_matches(t), mv)
    shown = F.transform("results", lambda e: F.concat_ws("|", e["id"].cast("string"), e["scope"], F.array_join(e["tags"], "+"), e["source"],
                                                         e["created_at"].cast("string"), F.sha2(e["content"], 256)))
    return r.select("query_id", "status", "mode", "tenant_id", "scope", "k", "results_count", F.sha2("query", 256).alias("query_sha256"),
                    F.array_join(shown, ";").alias("results"))


@register("d5_d7_pca_fit")
def _d5(t):
    mv = t.embeddings.select(F.col("embedding").cast("array<double>").alias("embedding"))
    mean, model = vx.pca_fit(mv, 64, expected_dims=64)
    spark = t.spark
    return spark.createDataFrame([(64, len(mean), round(vx.explained_variance_total(model), 9))],
                                 "components int, input_dims int, explained_variance_total double")


@register("d6_pca_transform")
def _d6(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    mean, model = vx.pca_fit(e, 64)  # all components: the norm of the centred vector is kept
    return vx.pca_transform(e, mean, model).select("vec_id", F.size("reduced").alias("dims"),
                                                   F.round(_l2("reduced"), 6).alias("norm"))


@register("d8_compare_methods")
def _d8(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    mean, model = vx.pca_fit(e, 64)
    return vx.compare_methods(e, mean, model, 64).select(
        F.round("mean_norm_truncated", 6).alias("mean_norm_truncated"), F.round("mean_norm_reduced", 6).alias("mean_norm_reduced"),
        F.round("reconstruction_mse", 9).alias("reconstruction_mse"))


# ---------------------------------------------------------------- E / A17
from ..operators import audit as au  # noqa: E402


def _chain(t: Tables) -> DataFrame:
    return au.build_chain(au.with_hash_columns(_audit(t)))


@register("e1_event_hash")
def _e1(t):
    a = au.with_hash_columns(_audit(t)).withColumn("prev_hash", F.lit(""))
    return a.select("id", au.event_hash().alias("event_hash"))


@register("e2_chain_append")
def _e2(t): return _chain(t).select("id", "tenant_id", "prev_hash", "event_hash")


@register("e2_chain_by_day")
def _e2d(t):
    """A chain per tenant and day: as many tasks as there are days."""
    a = au.with_hash_columns(_audit(t)).withColumn("day", F.col("created_at").cast("date"))
    return au.build_chain(a, ("tenant_id", "day")).select("id", "tenant_id", "day", "prev_hash", "event_hash")


@register("e2_append_to_stored")
def _e2a(t):
    """Two batches, the second appended to the stored chains of the first."""
    a = au.with_hash_columns(_audit(t))
    early = F.col("created_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    path = _scratch(t, "chain")
    sn.append(au.build_chain(a.where(early)), path)
    done = t.spark.read.parquet(path)
    more = au.build_chain(a.where(~early), heads=au.chain_heads(done))
    return done.select("id", "tenant_id", "prev_hash", "event_hash").unionByName(more.select("id", "tenant_id", "prev_hash", "event_hash"))


def _stored_chain(t: Tables) -> DataFrame:
    """The built chain as a stored table (reliable checkpoint in the shared
    folder): verification reads it several times, as it would read the
    audit table in production."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(t.spark)
    return _chain(t).checkpoint(eager=True)


@register("e3_chain_verify")
def _e3(t): return au.verify_summary(au.verify_chain(_stored_chain(t)))


def _tampered(chain: DataFrame) -> DataFrame:
    """A later snapshot: every 97th event deleted, every 89th edited."""
    i = F.col("id")
    return (chain.where(i % 97 != 0)
            .withColumn("decision", F.when(i % 89 == 0, F.lit("allowed")).otherwise(F.col("decision"))))


@register("a17_append_only_guard")
def _a17(t):
    c = _stored_chain(t)
    return au.append_only_violations(c, _tampered(c))


@register("e4_audit_row_build")
def _e4(t):
    d = _decisions(t)
    return au.build_audit_rows(d, "workflow:executor_dispatch", "executor_run").select(
        "request_id", "actor", "action", "target", "decision", "payload")


def _packed(t: Tables) -> DataFrame:
    e = t.events.select(
        "event_id", "user_id", "value", F.col("ts").alias("created_at"))
    prov = F.when(F.col("user_id") % 2 == 0, F.lit("kimi")).otherwise(F.lit("openai"))
    model = F.when(F.col("user_id") % 3 == 0, F.lit("moonshot:v1-8k")).otherwise(F.lit("gpt-4o-mini"))
    attempt = F.when(F.col("user_id") % 5 == 0, F.lit(2)).otherwise(F.lit(1))
    h = F.sha2(F.col("event_id").cast("string"), 256)
    dec = au.pack_decision(prov, model, attempt, h, (F.col("event_id") % 997).cast("long"),
                           F.floor("value").cast("int"))
    return e.select("event_id", "created_at", prov.alias("provider_w"), dec.alias("decision"))


@register("e5_packed_decision")
def _e5(t):
    return au.unpack_decision(_packed(t)).select("event_id", "provider", "model", "attempt", "answer_length",
                                                 "latency_ms")


@register("e6_decision_vocabulary")
def _e6(t):
    return au.normalize_decision_vocabulary(_decisions(t).select("request_id", "decision"))


# ---------------------------------------------------------------- H / A
import datetime as _dt  # noqa: E402

from ..functions.common import AS_OF, ts_ntz  # noqa: E402
from ..operators import registry as rg  # noqa: E402
from ..sources import snapshots as sn  # noqa: E402


def _rules(t: Tables) -> DataFrame:
    return si.policy_workflows(t.nation)


@register("h1_list_rules")
def _h1(t): return rg.list_rules(_rules(t))


def _upsert_requests(t: Tables) -> DataFrame:
    """Incoming upserts: normalised supplier requests plus edits of every
    second registry rule (so both insert and conflict paths run)."""
    n = va.normalize_rule_upsert(si.rule_upserts(t.supplier, t.nation).withColumn(
        "actor", F.col("s_suppkey").cast("string"))).where(F.col("error").isNull())
    n = n.select(*sn.RULE_KEY, F.lit("{}").alias("constraints"), "enabled",
                 F.col("actor").cast("long").alias("seq"))
    edits = _rules(t).where(F.col("id") % 2 == 0).select(
        *sn.RULE_KEY, F.lit('{"max_runtime_s":0}').alias("constraints"), (~F.col("enabled")).alias("enabled"),
        F.lit(-1).cast("long").alias("seq"))
    return n.unionByName(edits)


def _rule_history(t: Tables) -> DataFrame:
    up = _upsert_requests(t)
    hist = up.select((F.col("seq") + 1000).alias("id"), *sn.RULE_KEY, "constraints", "enabled",
                     (ts_ntz(AS_OF) - F.make_dt_interval(hours=F.col("seq") + 2)).alias("created_at"),
                     (ts_ntz(AS_OF) - F.make_dt_interval(hours=F.col("seq") + 2)).alias("updated_at"))
    return _rules(t).unionByName(hist)


@register("h2_latest_rule")
def _h2(t):
    return rg.latest_rule(_rule_history(t)).select("workflow_id", "task_type", "id", "tenant_id", "scope_pattern",
                                                   "constraints", "enabled", "updated_at")


@register("h3_unregistered_workflows")
def _h3(t): return rg.unregistered_workflows(si.workflow_entity(t.supplier, t.nation), _rules(t))


@register("h4_unregistered_task_types")
def _h4(t): return rg.unregistered_task_types(si.candidate_events(t.supplier, t.nation), _rules(t))


@register("h5_policy_task_types")
def _h5(t): return rg.policy_task_types(_rules(t))


@register("h6_merge_candidates")
def _h6(t):
    m = rg.merge_candidates(rg.unregistered_workflows(si.workflow_entity(t.supplier, t.nation), _rules(t)),
                            rg.unregistered_task_types(si.candidate_events(t.supplier, t.nation), _rules(t)),
                            rg.policy_task_types(_rules(t)))
    return m.select("status", F.array_join("workflow_ids", ",").alias("workflow_ids"),
                    F.array_join("task_types_workflow", ",").alias("task_types_workflow"),
                    F.array_join("task_types_policy", ",").alias("task_types_policy"),
                    "n_workflow_ids", "n_task_types_workflow", "n_task_types_policy")


@register("h7_publish_rows")
def _h7(t): return rg.publish_rows(_rules(t), "rev-20240131")


@register("h7_publish_revision")
def _h7r(t):
    r = si.revisions(t.region)
    again = rg.publish_revision(r, "rev-1", AS_OF)  # an id that is there
    return again.withColumn("case", F.lit("again")).unionByName(rg.publish_revision(r, "rev-20240131", AS_OF).withColumn("case", F.lit("new")))


@register("h8_payload_roundtrip")
def _h8(t):
    p = rg.publish_payload(_rules(t)).select(F.lit("rev-20240131").alias("revision_id"), "payload")
    return rg.load_payload(p)


@register("h8_stored_rows")
def _h8s(t):
    """The revision as rows: published, stored and read back."""
    path = _scratch(t, "revision")
    sn.append(rg.publish_rows(_rules(t), "rev-20240131"), path)
    return rg.load_revision_rows(t.spark.read.parquet(path))


@register("h9_upsert_log_rows")
def _h9(t):
    n = va.normalize_rule_upsert(si.rule_upserts(t.supplier, t.nation).withColumn(
        "actor", F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string"))))
    return rg.log_rows(n, "draft", "upsert", detail_cols=("workflow_id", "task_type", "tenant_id", "scope_pattern",
                                                          "enabled", "actor", "policy_scope"))


@register("h10_bundle_merge")
def _h10(t):
    spark = t.spark
    static = spark.createDataFrame(
        [(list(pol.STATIC_ALLOWED_TASK_TYPES), 40, 80, None, "")],
        "allowed_task_types array<string>, requires_approval int, deny int, revision_id string, generated_at string")
    active = si.revisions(t.region).where("is_active").select("revision_id")
    m = rg.bundle_merge(static, active)
    return m.select(F.array_join("allowed_task_types", ",").alias("allowed_task_types"), "requires_approval", "deny",
                    "revision_id", "generated_at")


@register("h11_runtime_publish_validation")
def _h11(t):
    k = F.col("n_nationkey")
    body = (F.when(k % 5 == 0, F.lit('{"workflows":"oops"}')).when(k % 7 == 0, F.lit("not json"))
            .when(k % 3 == 0, F.concat(F.lit('{"workflows":[{"task_type":"'), F.col("n_name"), F.lit('"}]}')))
            .otherwise(F.concat(F.lit('{"revision_id":" rev-'), k.cast("string"),
                                F.lit(' ","workflows":[{"task_type":"'), F.col("n_name"), F.lit('"},{}]}'))))
    req = t.nation.select("n_nationkey", body.alias("body"), ts_ntz(AS_OF).alias("received_at"))
    return rg.validate_runtime_publish(req).select("n_nationkey", "error", "revision_id", "count")


@register("h13_enabled_reflection")
def _h13(t):
    cur = si.revisions(t.region).where("is_active")
    return rg.enabled_count_and_reflection(_rules(t), cur, "rev-2")


@register("h14_revision_history")
def _h14(t):
    counts = si.revision_rows(t.nation).groupBy("revision_id").agg(F.count(F.lit(1)).alias("rules"))
    return rg.revision_history(si.revisions(t.region).join(counts, "revision_id", "left"))


@register("h14_rollback")
def _h14b(t):
    return rg.rollback(_rules(t), si.revision_rows(t.nation), "rev-1", "rev-rollback-1", AS_OF)


@register("a1_scan_projection")
def _a1(t): return _vectors(t).select("id", "tenant_id", "scope", "source", "created_at")


@register("a2_newest_sample")
def _a2(t):
    return sn.newest_sample(_vectors(t), 5000).select("id", "created_at")


@register("a3_parse_vector_text")
def _a3(t):
    mv = _vectors(t).select("id", F.to_json("embedding").alias("embedding_text"))
    p = mv.select("id", vx.parse_vector_text("embedding_text").alias("v"))
    return p.select("id", F.size("v").alias("dims"),
                    F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_values"))


@register("a10_h12_upsert_rules")
def _a10(t):
    return sn.upsert_rules(_rules(t), _upsert_requests(t), AS_OF, order_col="seq").select(
        *sn.RULE_KEY, "constraints", "enabled", "created_at", "updated_at")


def _cursor(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("inbox", 250000, _dt.datetime(2024, 1, 30)), ("archive", 5, _dt.datetime(2024, 1, 1))],
                                   "key string, last_seen_internal_date long, updated_at timestamp_ntz")


@register("a11_upsert_cursor")
def _a11(t):
    items = si.mail_items(t.conversations)
    return sn.advance_cursor(items, _cursor(t), AS_OF)


@register("a12_seed_if_absent")
def _a12(t):
    return sn.seed_if_absent(_rules(t), pol.STATIC_ALLOWED_TASK_TYPES, AS_OF).drop("id")


@register("a13_delete_by_key")
def _a13(t):
    sup, nat = t.supplier, t.nation
    s = sup.join(nat, sup.s_nationkey == nat.n_nationkey)
    dels = s.where(F.col("s_suppkey") % 3 == 0).select(
        F.concat(F.lower(F.regexp_replace("n_name", " ", "_")), F.lit("_v1")).alias("workflow_id"),
        F.col("n_name").alias("task_type"), F.lit("*").alias("tenant_id"), F.lit("*").alias("scope_pattern"))
    return sn.delete_by_key(_rules(t), dels).select("id", *sn.RULE_KEY)


@register("a14_j3_new_since_cursor")
def _a14(t):
    return sn.new_since_cursor(si.mail_items(t.conversations), _cursor(t)).select("id", "internal_date", "status")


@register("a16_metrics_exposition")
def _a16(t): return sn.metrics_exposition(pol.decision_counters(_with_fallback(t, "open")))


# ---------------------------------------------------------------- I
from ..operators import routing as ro  # noqa: E402
from ..operators import feeds as fd  # noqa: E402

LOOKBACK_MIN = 24 * 60


@register("i1_select_model")
def _i1(t):
    r = si.conversation_requests(t.conversations)
    c = F.col("conv_id")
    r = r.withColumn("use_case", F.when(c % 4 == 0, F.lit("daily_digest")).when(c % 4 == 1, F.lit(None).cast("string"))
                     .otherwise(F.lit("chat")))
    return ro.select_model(r).select("conv_id", "turn", "provider_norm", "selected_model", "selected_by")


def _parsed(t: Tables) -> DataFrame:
    return ro.parse_response(si.router_responses(t.conversations))


@register("i2_parse_response")
def _i2(t):
    return _parsed(t).select("conv_id", "turn", "http_status", "router_status",
                             F.length("answer").alias("answer_chars"), F.sha2("answer", 256).alias("answer_sha256"))


@register("i3_primary_fallback")
def _i3(t):
    p = _parsed(t)
    prim = p.select("conv_id", "turn", F.col("content").alias("primary_content"))
    fb = p.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("fallback_content"))
    j = ro.choose_primary_fallback(prim.join(fb, ["conv_id", "turn"], "left"))
    return j.select("conv_id", "turn", "is_fallback", "attempt", "failed",
                    F.sha2("content", 256).alias("content_sha256"))


@register("i4_breaker_guard")
def _i4(t):
    a = si.router_audit(t.events).where(F.col("action") == "chat_router_v1_brain_failure")
    return ro.breaker_guard(a).select("id", "tenant_id", "fails", "breaker_open")


@register("i5_provider_latency")
def _i5(t):
    return ro.provider_latency(si.router_audit(t.events), AS_OF, LOOKBACK_MIN).select(
        "provider", F.round("avg_latency", 6).alias("avg_latency"), "total")


@register("i6_provider_failures")
def _i6(t): return ro.provider_failures(si.router_audit(t.events), AS_OF, LOOKBACK_MIN)


@register("i7_provider_ranking")
def _i7(t):
    a = si.router_audit(t.events)
    r = ro.rank_providers(ro.provider_latency(a, AS_OF, LOOKBACK_MIN), ro.provider_failures(a, AS_OF, LOOKBACK_MIN))
    return r.select("provider", "avg_latency", "total", "failures", F.round("failure_rate", 6).alias("failure_rate"),
                    F.round("score", 6).alias("score"), "rank", "selected")


@register("i8_build_prompt")
def _i8(t):
    m = _matches_with_content(t)
    ctx = vx.assemble_context(m)
    q = _vectors(t).select(F.col("id").alias("query_id"),
                           va.redact_injection(F.col("content")).alias("message"))
    asked = _queries(_vectors(t), t).select("query_id")
    p = ro.build_prompt(q.join(asked, "query_id", "left_semi").join(ctx, "query_id", "left"))
    return p.select("query_id", "prompt_chars", F.sha2("user_prompt", 256).alias("user_prompt_sha256"))


@register("i9_cap_answer")
def _i9(t):
    d = t.documents.select("doc_id", F.col("text").alias("content"), "n_chars")
    start = ts_ntz(AS_OF) - F.make_dt_interval(mins=F.col("doc_id"))
    d = d.withColumn("started_at", start).withColumn(
        "ended_at", start + F.make_dt_interval(secs=(F.col("n_chars") % 60).cast("decimal(18,6)")))
    return ro.cap_answer(d).select("doc_id", "answer_length", "audit_hash", "latency_ms")


@register("i10_answer_fallback")
def _i10(t):
    c = t.conversations
    ans = F.when(F.col("turn") % 5 == 0, F.lit("   ")).when(F.col("turn") % 5 == 1, F.lit(None).cast("string")) \
        .otherwise(F.col("text"))
    s = ro.answer_fallback(ans)
    return c.select("conv_id", "turn", F.length(s).alias("answer_chars"), F.sha2(s, 256).alias("answer_sha256"))


def _digest_rows(t: Tables) -> DataFrame:
    p = _parsed(t)
    c = F.col("conv_id")
    p = p.select("conv_id", "turn", F.col("text").alias("facts"), "answer", "router_status",
                 (F.col("turn") % 3 != 0).alias("router_ok"),
                 F.when(c % 2 == 0, F.concat(F.lit("Digest <"), c.cast("string"), F.lit(">"))).alias("subject"))
    return ro.digest_text(p)


@register("i11_digest_text")
def _i11(t):
    return _digest_rows(t).select("conv_id", "turn", F.length("final_message").alias("final_chars"),
                                  F.sha2("final_message", 256).alias("final_sha256"),
                                  F.sha2("html_message", 256).alias("html_sha256"))


@register("i11_newsletter_text")
def _i11n(t):
    p = _parsed(t).select("conv_id", "turn", F.col("text").alias("facts"), "answer", "router_status", (F.col("turn") % 3 != 0).alias("router_ok"))
    n = ro.newsletter_text(p)
    return n.select("conv_id", "turn", "failed", F.sha2("newsletter", 256).alias("newsletter_sha256"))


@register("i12_outcome_episode")
def _i12(t):
    d = _digest_rows(t).select(
        F.concat(F.lit("t"), (F.col("conv_id") % 3).cast("string")).alias("tenant_id"),
        F.lit("security-digest").alias("scope"), "outcome",
        F.concat(F.lit("req-conv-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("request_id"))
    return ro.episode_rows(d, AS_OF)


# ---------------------------------------------------------------- J / B29-B31
@register("j1_split_messages")
def _j1(t):
    return fd.split_messages(si.list_responses(t.conversations)).select("conv_id", "turn", "message_id", "thread_id")


@register("j2_header_lookup")
def _j2(t):
    m = si.mail_items(t.conversations)
    return m.select("id", fd.header("headers", "From").alias("from"), fd.header("headers", "Subject").alias("subject"),
                    fd.header("headers", "Date").alias("date"))


@register("j4_no_messages_marker")
def _j4(t):
    r = si.list_responses(t.conversations).withColumn(
        "key", F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")))
    return fd.no_message_markers(r, "key")


@register("j5_newest_kev")
def _j5(t): return fd.newest_kev(si.kev_feed(t.part), "pos").select("pos", "cveID", "vendorProject", "product",
                                                                     "dueDate")


@register("j6_first_cves")
def _j6(t): return fd.first_cves(si.nvd_feed(t.part), "pos").select("pos", "id", "cvss", "description_en")


@register("j7_normalize_text")
def _j7(t):
    k = si.kev_feed(t.part)
    return k.select("pos", fd.normalize_text("shortDescription").alias("note"),
                    fd.normalize_text("shortDescription", ellipsis=True).alias("note_executor"))


@register("j8_factual_digest")
def _j8(t):
    d = fd.factual_digest(si.kev_feed(t.part), si.nvd_feed(t.part), AS_OF)
    return d.select("date_label", "kev_total", "nvd_total", F.length("factual_digest").alias("digest_chars"),
                    F.sha2("factual_digest", 256).alias("digest_sha256"))


@register("j9_email_prompt")
def _j9(t):
    m = si.mail_items(t.conversations)
    m = m.select("id", "thread_id", fd.header("headers", "From").alias("from"),
                 fd.header("headers", "Subject").alias("subject"), fd.header("headers", "Date").alias("date"))
    p = fd.email_prompt(m)
    return p.select("id", "tenant_id", "scope", F.length("prompt").alias("prompt_chars"),
                    F.sha2("prompt", 256).alias("prompt_sha256"), F.col("meta.thread_id").alias("meta_thread_id"),
                    F.col("meta.subject").alias("meta_subject"))


@register("b29_normalize_http")
def _b29(t):
    return fd.normalize_http(si.list_responses(t.conversations)).select("conv_id", "turn", "http_status", "http_error",
                                                                         "ok")


@register("b29_normalize_metadata")
def _b29m(t):
    r = fd.normalize_metadata(si.metadata_responses(t.conversations))
    return r.select("conv_id", "turn", "http_status", "http_error", "ok", F.get_json_object("body", "$.id").alias("body_id"),
                    F.length(F.get_json_object("body", "$.rawText")).alias("raw_chars"))


@register("b30_tolerant_parse")
def _b30(t):
    return fd.tolerant_parse(si.list_responses(t.conversations)).select("conv_id", "turn", "parse_status", "sample")


@register("b31_first_message")
def _b31(t):
    m = si.mail_items(t.conversations).select("thread_id", "id", "internal_date", "snippet_source")
    return fd.first_message(m, "thread_id", "internal_date", "id", "snippet_source").select(
        "thread_id", "id", "internal_date", "snippet", "status")


# ---------------------------------------------------------------- K
from ..operators import telemetry as tm  # noqa: E402


def _snap_time(t: Tables):
    """Telemetry snapshot time: the newest event (a scalar subquery)."""
    return t.events.agg(F.max("ts")).scalar()


def _sessions(t: Tables) -> DataFrame:
    ev = si.session_events(t.events)
    return tm.session_expiry(tm.session_records(ev, extra_keys=("pool",)), _snap_time(t))


@register("k1_session_expiry")
def _k1(t): return _sessions(t).select("session_id", "template", "age", "idle_time", "ttl", "is_expired", "use_count")


@register("k2_lifecycle_counters")
def _k2(t): return tm.lifecycle_counters(_sessions(t), si.session_events(t.events))


@register("k3_latest_state")
def _k3(t):
    return tm.latest_state(si.session_events(t.events), pool="pool-1").select("session_id", "pool", "pod", "template",
                                                                               "ts")


@register("k4_ttl_alive_sessions")
def _k4(t):
    s = tm.session_records(si.session_events(t.events))
    return tm.ttl_alive(s, "last_used", 86400, _snap_time(t)).select("session_id", "last_used", "expires_at")


@register("k4_ttl_alive_files")
def _k4f(t):
    m = si.file_manifest(t.pages).withColumn(
        "created_at", ts_ntz(AS_OF) - F.make_dt_interval(mins=F.col("page_id") * 10))
    return tm.ttl_alive(m, "created_at", 86400, ts_ntz(AS_OF)).select("page_id", "path", "expires_at")


@register("k5_session_changes")
def _k5(t):
    ch = t.events.select("event_id", "ts", F.concat(F.lit("sess-"), F.col("user_id").cast("string")).alias("session_id"),
                  F.when(F.col("event_type") == "click", "migrate").otherwise("restore").alias("kind"),
                  F.concat(F.lit("pod-"), (F.col("event_id") % 5).cast("string")).alias("new_pod"),
                  F.when((F.col("event_type") == "click") & (F.col("event_id") % 2 == 0),
                         F.concat(F.lit("pool-"), (F.col("event_id") % 4).cast("string"))).alias("new_pool"))
    return tm.apply_session_changes(ch)


def _probes(t: Tables) -> DataFrame:
    return tm.classify_probe(si.probe_samples(t.events))


def _pools(t: Tables) -> DataFrame:
    return si.pool_snapshot(_probes(t), t.events)


@register("k6_affinity_lookup")
def _k6(t):
    aff = t.events.select(
        "event_id", F.concat(F.lit("sess-"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit("pool-"), (F.col("event_id") % 4).cast("string")).alias("pool"), F.col("ts").alias("created_at"))
    return tm.affinity_lookup(aff, _pools(t), _snap_time(t))


@register("k7_classify_probe")
def _k7(t): return _probes(t).select("event_id", "pool", "status", "response_time_ms", "outcome")


@register("k8_available_pools")
def _k8(t): return tm.available_pools(_pools(t)).select("name", "status", "current_sessions", "queue_depth")


@register("k9_order_pools")
def _k9(t): return tm.order_pools(_pools(t), "eu-west").select("name", "region", "priority", "order_rank")


def _top(t: Tables) -> DataFrame:
    return tm.score_pools(tm.order_pools(tm.available_pools(_pools(t)), "eu-west"))


@register("k10_score_pools")
def _k10(t): return _top(t).select("name", F.round("score", 9).alias("score"), "score_rank")


@register("k13_pool_stats")
def _k13(t): return tm.pool_stats(_pools(t))


@register("k14_scaling_targets")
def _k14(t):
    ev = si.session_events(t.events)
    last = ev.groupBy("session_id", "pool").agg(F.max_by("template", F.struct("ts", "event_id")).alias("last"))
    s = last.withColumn("phase", F.when(F.col("last") == "signup", "Pending").otherwise("Active"))
    return tm.scaling_targets(s, _pools(t))


@register("k15_hold_alerts")
def _k15(t):
    p = si.probe_samples(t.events)
    rules = {"ExecutorHighQueueDepth": (F.col("mem") > 50, 120),
             "ExecutorHighCPUUtilization": (F.col("cpu") > 90, 300),
             "ExecutorPoolDown": (F.col("probe_status") == 500, 60)}
    fired = tm.hold_alerts(p, "pool", "ts", "event_id", rules)
    # one row per (pool, alert) with firing samples: unpivot the three flags
    long = fired.select("pool", "ts", F.inline(F.array(*[
        F.struct(F.lit(n).alias("alert"), F.col(f"firing_{n}").alias("firing")) for n in rules])))
    return (long.where("firing").groupBy("pool", "alert")
            .agg(F.count(F.lit(1)).alias("firing_samples"), F.min("ts").alias("first_firing")))


@register("k16_counter_rate")
def _k16(t):
    return tm.counter_increase(si.probe_samples(t.events), "pool", "ts", "event_id", "counter").select(
        "event_id", "pool", F.round("increase", 6).alias("increase"), "rate_positive")


@register("k17_rate_limit")
def _k17(t):
    return tm.rate_limit(t.events.select("event_id", "user_id", "ts"), "user_id", "ts").select(
        "event_id", "user_id", "requests_in_window", "rejected")


@register("k18_package_key")
def _k18(t):
    p = t.part
    pk = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    lang = F.when(F.col("p_partkey") % 3 == 0, F.lit("javascript")).otherwise(F.lit("python"))
    return p.select("p_partkey", tm.package_key(pk, lang).alias("cache_key"))


@register("k19_cache_stats")
def _k19(t): return tm.cache_stats(si.file_manifest(t.pages))


@register("k20_execution_result")
def _k20(t):
    r = tm.execution_result(si.exec_results(t.conversations))
    return r.select("conv_id", "turn", "status", "error_message", F.sha2("error_traceback", 256).alias("traceback_sha256"))


@register("k21_artifact_type")
def _k21(t):
    r = si.exec_results(t.conversations)
    return r.select("conv_id", "turn", "filename", tm.artifact_type("filename").alias("artifact_type"))


@register("k22_format_size")
def _k22(t):
    m = si.file_manifest(t.pages)
    return m.select("page_id", tm.format_size("size_bytes").alias("size"),
                    tm.format_size(F.col("size_bytes") * F.lit(1048576.0) * F.col("page_id")).alias("scaled_size"))


@register("k23_display_text")
def _k23(t):
    r = tm.execution_result(si.exec_results(t.conversations))
    r = r.withColumn("artifacts", F.array(F.struct(F.col("filename").alias("name"),
                                                   tm.artifact_type("filename").alias("type"))))
    d = tm.display_text(r)
    return d.select("conv_id", "turn", F.length("display").alias("display_chars"), F.sha2("display", 256).alias("display_sha256"))


# ---------------------------------------------------------------- end-to-end flows
from .memory_ingest import ingest_job  # noqa: E402
from .memory_search import search_job  # noqa: E402


def _ingest(t: Tables):
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    wide = F.col("embedding").cast("array<double>").alias("embedding")
    base = si.ingest_requests(t.documents)
    # every 8th request is a write over 100 000 characters, which needs approval; texts
    # grow and vectors widen behind the join, which shuffles both as they are stored
    long = F.when(F.col("doc_id") % 8 == 3, F.repeat(F.concat(F.col("text"), F.lit(" ")), F.floor(F.lit(100000) / (F.length("text") + 1)).cast("int") + 1)).otherwise(F.col("text"))
    req = base.join(e, "doc_id", "left").withColumn("embedding", wide).withColumn("text", long).withColumn(
        "created_at", ts_ntz(AS_OF) - F.make_dt_interval(mins=F.col("doc_id")))
    mean, model = vx.pca_fit(e.select(wide), 16)
    stored = _vectors(t).where(F.col("id") % 2 == 0).select("id", "tenant_id", "scope", "content_hash")
    return ingest_job(req, stored, mean, model, 64)


@register("flow_memory_ingest_rows")
def _fi(t):
    return _ingest(t).vectors.select("request_id", "tenant_id", "scope", "content_hash", F.size("embedding").alias("dims"))


@register("flow_memory_ingest_outcomes")
def _fo(t):
    """One outcome per request: the counts add up to the requests."""
    return _ingest(t).outcomes.select("request_id", "tenant_id", "scope", "outcome", "error", F.col("id").isNotNull().alias("has_id"))


@register("flow_memory_ingest_facts")
def _ff(t):
    return _ingest(t).facts


@register("flow_memory_search")
def _fs(t):
    mv = _vectors(t)
    q = si.search_requests(t.benchmark).join(
        mv.select(F.col("id").alias("item_id"), F.col("embedding").alias("query_vec")), "item_id", "inner") \
        .withColumnRenamed("item_id", "query_id")
    resp, _ = search_job(q, mv)
    return resp.select("query_id", "tenant_id", "scope", F.col("k").alias("k_norm"), "results_count",
                       F.array_join(F.transform("results", lambda e: e["id"].cast("string")), ",").alias("result_ids"))


# ---------------------------------------------------------------- A4-A9 file sources and sinks
def _scratch(t: Tables, name: str) -> str:
    import uuid
    from ..session import scratch_path
    return scratch_path(t.spark, f"{name}-{uuid.uuid4().hex}")


@register("a4_read_embeddings_json")
def _a4(t):
    from ..sources import files as fs
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    # landed JSON lines in both accepted shapes: bare arrays and {"embedding": [...]}
    lines = e.select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.to_json("embedding"))
                     .otherwise(F.to_json(F.struct("vec_id", "embedding"))).alias("value"))
    path = _scratch(t, "a4")
    lines.select("value").write.text(path)
    back = fs.read_embeddings_json(t.spark, path)
    return back.agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size("embedding")).alias("min_dims"),
                    F.max(F.size("embedding")).alias("max_dims"),
                    F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)), 6).alias("sum_values"))


@register("a5_write_reduced_json")
def _a5(t):
    from ..sources import files as fs
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    mean, model = vx.pca_fit(e, 16)
    path = _scratch(t, "a5")
    fs.write_reduced_json(vx.pca_transform(e, mean, model), path)
    return t.spark.read.json(path).groupBy("original_dims", "reduced_dims").agg(F.count(F.lit(1)).alias("rows"))


@register("a6_a7_model_roundtrip")
def _a6(t):
    from ..sources import files as fs
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    mean, model = vx.pca_fit(e, 16)
    base = _scratch(t, "a6")
    fs.export_model_json(t.spark, mean, model, f"{base}/json")
    fs.save_model(t.spark, mean, model, f"{base}/model")
    mean2, model2 = fs.load_model(t.spark, f"{base}/model")
    a = vx.pca_transform(e, mean, model, out="r1")
    b = vx.pca_transform(e.withColumnRenamed("embedding", "e2"), mean2, model2, col="e2", out="r2").select("vec_id", "r2")
    doc = t.spark.read.text(f"{base}/json").select(
        F.get_json_object("value", "$.n_components").cast("int").alias("n_components"))
    same = a.join(b, "vec_id").agg(F.count_if(F.col("r1") == F.col("r2")).alias("identical_rows"),
                                   F.count(F.lit(1)).alias("rows"))
    return same.select("*", doc.select("n_components").scalar().alias("n_components"))


@register("a8_append_audit_rows")
def _a8(t):
    rows = au.build_audit_rows(_decisions(t), "workflow:executor_dispatch", "executor_run")
    path = _scratch(t, "a8")
    sn.append(rows, path)
    sn.append(rows, path)  # a retried batch is a second append; ids make it visible
    back = t.spark.read.parquet(path)
    return back.groupBy("decision").agg(F.count(F.lit(1)).alias("rows"),
                                        F.countDistinct("request_id").alias("requests"))


@register("k1_sessions_from_events")
def _k1s(t):
    ev = si.session_events(t.events)
    return tm.sessionize(ev, "session_id", "ts", "event_id", 300)  # gap = session ttl


@register("a9_returning_ids")
def _a9(t):
    """The ids that an append returns, with the request each stands for.
    The ingest runs once: its rows are written and the batch is read back."""
    stored = sn.append_returning(_ingest(t).vectors, _scratch(t, "a9"), "id", "request_id", "content_hash")
    return stored.select("request_id", "id", "content_hash")


@register("a15_landed_feed")
def _a15(t):
    """The KEV stand-in landed as many feed documents of at most 100
    entries each (JSON lines), read back with the feed reader."""
    from ..sources import files as fs
    kev = si.kev_feed(t.part)
    docs = (kev.groupBy(F.floor(F.col("pos") / 100).alias("doc"))
            .agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(
                "pos", "cveID", "vendorProject", "product", "dueDate", "shortDescription"))).alias("vulnerabilities")))
                 .alias("value")))
    path = _scratch(t, "a15")
    docs.select("value").write.text(path)
    schema = ("vulnerabilities array<struct<pos:bigint,cveID:string,vendorProject:string,product:string,"
              "dueDate:string,shortDescription:string>>")
    back = fs.read_landed_feed(t.spark, path, "vulnerabilities", schema, multi_line=False)
    return back.select(F.col("pos").alias("entry_pos"), "cveID", "vendorProject", "dueDate")
