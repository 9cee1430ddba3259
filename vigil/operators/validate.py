"""Validation, projection and scan operators.

Each per-request rule of the reference becomes a column expression over a
table of requests.  Rejected rows are kept with their reason (``error``)
rather than dropped, so callers split valid / rejected with two filters
over the same (cached or checkpointed) frame.  Text scans explode lines
with ``posexplode(split(...))`` and filter with ``rlike``: fully parallel,
no driver work, and each whole text is scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import as_col, blank_to_null, ordered_errors, truthy
from ..functions import patterns as P


def _first_error(*checks: tuple[Column, str]) -> Column:
    """The message of the first failing check (ordered ``when`` chain)."""
    out = None
    for cond, msg in checks:
        out = F.when(cond, F.lit(msg)) if out is None else out.when(cond, F.lit(msg))
    return out


def content_request_id(*cols) -> Column:
    """A deterministic request id for rows that carry none (the reference
    draws a random one; a content-derived id keeps reruns idempotent)."""
    return F.concat(F.lit("req-"), F.substring(F.sha2(F.concat_ws("\u0001", *[as_col(c) for c in cols]), 256), 1, 16))


def has_secret(c) -> Column:
    """True when the text matches any secret pattern."""
    return F.coalesce(as_col(c).rlike(P.SECRET_RE), F.lit(False))


# ---------------------------------------------------------------- B1 / B13
def validate_ingest(df: DataFrame) -> DataFrame:
    """B1 + B13 + B14: required fields, secret rejection, defaults (source,
    tags, request id) and the facts worth keeping, if the request has any."""
    err = _first_error(
        (~(truthy("tenant_id") & truthy("scope") & truthy("text")),
         "Missing required fields: tenant_id, scope, text"),
        (has_secret("text"), "Rejected: potential secret detected in text"))
    more = []
    if "tags" in df.columns:
        more.append(F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags_norm"))
    if "facts" in df.columns:
        explicit = F.coalesce(F.col("source") == "explicit", F.lit(False))
        none = F.array().cast(df.schema["facts"].dataType)
        more.append(F.filter(F.coalesce(F.col("facts"), none), lambda f: keep_fact(
            f["subject"], f["predicate"], f["object"], f["confidence"], explicit)).alias("facts_norm"))
    return df.select(
        "*", *more,
        err.alias("error"),
        F.coalesce(blank_to_null(F.col("source")), F.lit("unknown")).alias("source_norm"),
        F.coalesce(F.nullif(F.col("request_id"), F.lit("")),
                   content_request_id("tenant_id", "scope", "text")).alias("request_id_norm"))


def secret_rejections(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """B13 over a whole table: which rows would be rejected and which
    pattern matched first."""
    t = F.col(text_col)
    which = _first_error(*[(F.coalesce(t.rlike("(?i)" + p), F.lit(False)), p) for p in P.SECRET_PATTERNS])
    # one combined scan per text; the per-pattern scans run only on hits
    return (df.select(F.col(id_col), F.col(text_col), has_secret(text_col).alias("rejected"))
            .select(id_col, "rejected", F.when(F.col("rejected"), which).alias("matched_pattern")))


# ---------------------------------------------------------------- B2 / B3 / B4 / B5
def validate_search(df: DataFrame) -> DataFrame:
    """B2: tenant_id, scope, query required; ``k || 5``."""
    err = _first_error((~(truthy("tenant_id") & truthy("scope") & truthy("query")),
                        "Missing required fields: tenant_id, scope, query"))
    return df.select("*", err.alias("error"),
                     F.coalesce(F.nullif(F.col("k"), F.lit(0)), F.lit(5)).alias("k_norm"))


VALID_AUDIT_DECISIONS = ("allowed", "denied", "requires_approval")


def validate_audit(df: DataFrame) -> DataFrame:
    """First failing rule wins."""
    p = F.col("payload")
    g = lambda k: F.get_json_object(p, f"$.{k}")
    err = _first_error(
        (~(truthy("actor") & truthy("action") & truthy("target") & truthy("decision")),
         "Missing required fields: actor, action, target, decision"),
        (~F.col("decision").isin(*VALID_AUDIT_DECISIONS),
         "Invalid decision. Must be: allowed, denied, or requires_approval"),
        (~(truthy(g("request_id")) & truthy(g("policy_id")) & truthy(g("policy_version"))),
         "payload.request_id, payload.policy_id, payload.policy_version are required"))
    return df.select("*", err.alias("error"))


def validate_dispatch(df: DataFrame) -> DataFrame:
    """tenant_id, scope, task required; task must be a JSON object."""
    v = F.try_parse_json(F.col("task"))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    err = _first_error(
        (~(truthy("tenant_id") & truthy("scope") & truthy("task")),
         "Missing required fields: tenant_id, scope, task"),
        (~is_obj, "task must be an object"))
    return df.select("*", err.alias("error"))


def validate_approval(df: DataFrame) -> DataFrame:
    """Approval validation and mapping to the audit vocabulary."""
    err = _first_error(
        (~(truthy("request_id") & truthy("decision") & truthy("approver")),
         "Missing required fields: request_id, decision, approver"),
        (~F.col("decision").isin("approved", "rejected"), "decision must be approved or rejected"))
    return df.select(
        "*", err.alias("error"),
        F.when(F.col("decision") == "approved", "allowed").otherwise("denied").alias("audit_decision"),
        F.concat(F.lit("approver:"), F.col("approver")).alias("audit_actor"),
        F.coalesce(F.nullif(F.col("comment"), F.lit("")), F.lit("")).alias("comment_norm"),
        F.coalesce(F.nullif(F.col("policy_id"), F.lit("")), F.lit("unknown")).alias("policy_id_norm"),
        F.coalesce(F.nullif(F.col("policy_version"), F.lit("")), F.lit("unknown")).alias("policy_version_norm"))


# ---------------------------------------------------------------- B6 / B7 / B8
def normalize_rule_upsert(df: DataFrame) -> DataFrame:
    """Trim, defaults ``*``, enabled unless false, workflow_id forced to
    ``*`` when empty or the policy scope is ``task_type_only`` (default)."""
    tt = F.coalesce(F.trim(F.col("task_type")), F.lit(""))
    ps = F.coalesce(blank_to_null(F.col("policy_scope")), F.lit("task_type_only"))
    wf = F.coalesce(F.trim(F.col("workflow_id")), F.lit(""))
    return df.select(
        F.when((wf == "") | (ps == "task_type_only"), F.lit("*")).otherwise(wf).alias("workflow_id"),
        tt.alias("task_type"),
        F.trim(F.coalesce(F.nullif(F.col("tenant_id"), F.lit("")), F.lit("*"))).alias("tenant_id"),
        F.trim(F.coalesce(F.nullif(F.col("scope_pattern"), F.lit("")), F.lit("*"))).alias("scope_pattern"),
        F.coalesce(F.col("enabled") != F.lit(False), F.lit(True)).alias("enabled"),
        F.coalesce(F.nullif(F.col("actor"), F.lit("")), F.lit("n8n-ce")).alias("actor"),
        ps.alias("policy_scope"),
        F.when(tt == "", F.lit("task_type is required")).alias("error"))


def validate_rule_key(df: DataFrame) -> DataFrame:
    """get/delete need workflow_id and task_type (trimmed)."""
    wf = F.coalesce(F.trim(F.col("workflow_id")), F.lit(""))
    tt = F.coalesce(F.trim(F.col("task_type")), F.lit(""))
    return df.select("*", wf.alias("workflow_id_norm"), tt.alias("task_type_norm"),
                     F.when((wf == "") | (tt == ""), F.lit("workflow_id and task_type are required"))
                     .alias("error"))


def candidate_seed_defaults(df: DataFrame) -> DataFrame:
    """Seed defaults for candidate events."""
    def d(c, v):
        return F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)))
    tt = d("task_type", "test_policy_task")
    return df.select(
        tt.alias("task_type"), d("tenant_id", "test-tenant").alias("tenant_id"),
        d("scope", "test-scope").alias("scope"),
        F.trim(F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.concat(F.lit("seed "), tt))).alias("summary"),
        d("outcome", "ok").alias("outcome"))


# ---------------------------------------------------------------- B9 / B10 / B12
ROUTER_PROVIDERS = ("openrouter", "openai", "none")


def normalize_router_input(df: DataFrame, default_model: str = "qwen/qwen3-next-80b-a3b-instruct:free") -> DataFrame:
    """Collect every validation error; provider outside the set becomes
    openrouter; temperature 0.2 unless numeric."""
    tenant = F.trim(F.coalesce(F.nullif(F.col("tenant_id"), F.lit("")), F.lit("unknown")))
    scope = F.trim(F.coalesce(F.nullif(F.col("scope"), F.lit("")), F.lit("unknown")))
    msg = F.coalesce(F.nullif(F.col("message"), F.lit("")), F.nullif(F.col("text"), F.lit("")), F.lit(""))
    errs = ordered_errors(((tenant == "") | (tenant == "unknown"), "tenant_id required"),
                          ((scope == "") | (scope == "unknown"), "scope required"),
                          (msg == "", "message required"))
    prov = F.lower(F.coalesce(F.nullif(F.col("provider"), F.lit("")), F.lit("openrouter")))
    prov = F.when(prov.isin(*ROUTER_PROVIDERS), prov).otherwise(F.lit("openrouter"))
    model = F.coalesce(F.nullif(F.col("model"), F.lit("")),
                       F.when(prov == "openai", F.lit("gpt-4o-mini")).otherwise(F.lit(default_model)))
    temp = F.coalesce(F.col("temperature").try_cast("double"), F.lit(0.2))
    return df.select("*", tenant.alias("tenant_norm"), scope.alias("scope_norm"), msg.alias("message_norm"),
                     prov.alias("provider_norm"), model.alias("model_norm"), temp.alias("temperature_norm"),
                     F.when(F.size(errs) > 0, F.array_join(errs, ", ")).alias("validation_errors"))


def chat_input_guard(df: DataFrame, max_chars: int = 6000, max_k: int = 10) -> DataFrame:
    """Trimmed ids required; message cut to ``max_chars`` code points;
    k parsed (leading integer), < 1 or invalid -> 5, clamped to ``max_k``."""
    tenant = F.trim(F.coalesce(F.col("tenant_id"), F.lit("")))
    scope = F.trim(F.coalesce(F.col("scope"), F.lit("")))
    msg = F.coalesce(F.col("message"), F.lit(""))
    err = _first_error((tenant == "", "tenant_id required"), (scope == "", "scope required"),
                       (msg == "", "message required"))
    kraw = F.coalesce(F.nullif(F.col("k").cast("string"), F.lit("")), F.lit("5"))
    kint = F.regexp_extract(kraw, r"^\s*([+-]?\d+)", 1).try_cast("int")
    k = F.when(kint.isNull() | (kint < 1), F.lit(5)).otherwise(F.least(kint, F.lit(max_k)))
    return df.select("*", err.alias("error"), tenant.alias("tenant_norm"), scope.alias("scope_norm"),
                     F.substring(msg, 1, max_chars).alias("message_norm"), k.alias("k_norm"))


def slack_scope(df: DataFrame) -> DataFrame:
    """``slack:user:<id>`` or ``slack:unknown``; tenant ``t1``."""
    uid = F.nullif(F.col("user_id"), F.lit(""))
    return df.select("*", F.lit("t1").alias("tenant_id"),
                     F.when(uid.isNotNull(), F.concat(F.lit("slack:user:"), uid))
                     .otherwise(F.lit("slack:unknown")).alias("scope"),
                     F.coalesce(uid, F.lit("unknown")).alias("user_id_norm"))


def form_entries(body: Column) -> Column:
    """``a=b&c=d`` as (key, value) entries in order.  The value is everything
    after the first ``=``; both are URL-decoded, or both raw if either fails;
    empty keys are skipped.  ``+`` stays literal, as in the reference, by
    escaping it before decoding."""
    pairs = F.filter(F.split(F.coalesce(body, F.lit("")), "&"), lambda p: F.split(p, "=").getItem(0) != "")

    def dec(x):
        return F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))

    def entry(p):
        k, v = F.split(p, "=").getItem(0), F.coalesce(F.regexp_extract(p, "^[^=]*=(.*)$", 1), F.lit(""))
        fine = dec(k).isNotNull() & dec(v).isNotNull()
        return F.struct(F.when(fine, dec(k)).otherwise(k).alias("key"), F.when(fine, dec(v)).otherwise(v).alias("value"))

    return F.transform(pairs, entry)


def parse_form_body(df: DataFrame, col: str = "body", raw_col: str | None = None, fields_col: str | None = None) -> DataFrame:
    """A request's parameters as a map: the top-level fields (a map, if
    given), then the form in ``col``, then that in ``raw_col``; what comes
    later overrides, in a body as well."""
    parts = [F.map_entries(F.coalesce(F.col(fields_col), F.create_map().cast("map<string,string>")))] if fields_col else []
    parts += [form_entries(F.col(c)) for c in (col, raw_col) if c]
    empty = F.create_map().cast("map<string,string>")
    merged = F.aggregate(F.concat(*parts), empty, lambda m, e: F.map_concat(
        F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    return df.select("*", merged.alias("params"))


# ---------------------------------------------------------------- B14 / B15
def keep_fact(subject: Column, predicate: Column, obj: Column, confidence: Column, explicit: Column) -> Column:
    """B14 for one fact."""
    s, p, o = (F.coalesce(c, F.lit("")) for c in (subject, predicate, obj))
    return (~has_secret(F.concat_ws(" ", s, p, o)) & (F.coalesce(confidence >= 0.75, F.lit(False)) | explicit)
            & (s != "") & (p != "") & (o != ""))


def filter_facts(facts: DataFrame, request_source: str = "request_source") -> DataFrame:
    """Keep a fact when no secret is in ``subject predicate object``,
    confidence >= 0.75 or the request source is explicit, and all three
    parts are non-empty."""
    explicit = F.coalesce(F.col(request_source) == "explicit", F.lit(False))
    return facts.where(keep_fact(F.col("subject"), F.col("predicate"), F.col("object"), F.col("confidence"), explicit))


def redact_injection(c) -> Column:
    """The eight redaction patterns, in order, case-insensitive."""
    out = F.coalesce(as_col(c), F.lit(""))
    for pat in P.REDACTION_PATTERNS:
        out = F.regexp_replace(out, "(?i)" + pat, F.lit(P.FILTERED))
    return out


# ---------------------------------------------------------------- B16-B19
def explode_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no starting at 1, line) for every line of every text."""
    return df.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line")) \
             .select(id_col, (F.col("pos") + 1).alias("line_no"), "line")


def secret_line_scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines matching the secret scan that are not on the allow-list."""
    lines = explode_lines(df, id_col, text_col)
    return lines.where(F.col("line").rlike(P.SCAN_INCLUDE_RE) & ~F.col("line").rlike(P.SCAN_EXCLUDE_RE))


def credential_key_scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines naming an OAuth credential key."""
    return explode_lines(df, id_col, text_col).where(F.col("line").rlike(P.CREDENTIAL_KEY_RE))


def sensitive_file_scan(manifest: DataFrame, path_col: str = "path") -> DataFrame:
    """Secret-like file names and tracked ``.env`` files."""
    p = F.col(path_col)
    return manifest.select("*", p.rlike(P.SECRET_FILE_RE).alias("secret_like"),
                           p.rlike(P.ENV_FILE_RE).alias("env_file"))


def suspicious_diff_scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Assignment-like lines naming a credential with a long value."""
    return explode_lines(df, id_col, text_col).where(F.col("line").rlike(P.SUSPICIOUS_DIFF_RE))


# ---------------------------------------------------------------- B20-B23
def path_safety(manifest: DataFrame, path_col: str = "path") -> DataFrame:
    """The first failing path rule, or null when the path is safe."""
    raw = F.col(path_col)
    p = F.trim(F.coalesce(raw, F.lit("")))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    ext_re = "(" + "|".join(e.replace(".", r"\.") for e in P.DANGEROUS_EXTENSIONS) + ")$"
    bad = F.filter(parts, lambda x: ~x.rlike(P.SAFE_COMPONENT_RE) | F.lower(x).rlike(ext_re))
    first_bad = F.try_element_at(bad, F.lit(1))
    comp_reason = (F.when(~first_bad.rlike(P.SAFE_COMPONENT_RE),
                          F.concat(F.lit("Invalid characters in path component: "), first_bad))
                   .otherwise(F.concat(F.lit("Dangerous file extension not allowed: "),
                                       F.regexp_extract(F.lower(first_bad), ext_re, 1))))
    reason = (F.when(raw.isNull() | (raw == ""), F.lit("Empty path"))
              .when(F.instr(p, "\u0000") > 0, F.lit("Path contains null bytes"))
              .when(F.array_contains(parts, ".."), F.concat(F.lit("Path traversal detected: "), p))
              .when(p.startswith("/"), F.concat(F.lit("Absolute paths not allowed: "), p))
              .when(F.size(bad) > 0, comp_reason))
    return manifest.select("*", reason.alias("path_error"))


def size_quotas(manifest: DataFrame, sandbox_col: str = "sandbox", seq_col: str = "seq",
                size_col: str = "size_bytes", max_file_bytes: int = P.MAX_FILE_BYTES,
                max_total_bytes: int = P.MAX_TOTAL_BYTES, bucket_width: int = 100_000) -> DataFrame:
    """Per-file limit and the sandbox quota, with the reference's greedy
    semantics: a write is rejected when it is over the file limit or when
    the bytes accepted so far plus its size exceed the total; rejected
    writes do not count.  ``running_total`` is the accepted usage after the
    row.

    Decided in rounds of prefix sums, no sandbox in one task.  Let ``_pivot`` be
    the largest power of two within a sandbox's room.  Smaller writes surely fit
    until one leaves less room than the pivot; of the others the first that fits
    does so too.  Whichever comes first ends the sandbox's round, and its room has
    then lost at least one binary digit: so there are at most as many rounds as
    the quota has digits, whatever the order of sizes, and later writes that are
    larger than the room don't take part any more.  Rounds are checkpointed in
    the shared folder."""
    from ..functions.windows import running_sum
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(manifest.sparkSession)
    size, key = F.col(size_col), [sandbox_col, seq_col]
    within = manifest.where((size <= max_file_bytes) & (size <= max_total_bytes)).select(*key, F.greatest(size, F.lit(0)).cast("long").alias("_size"))
    accepted = within.where(F.col("_size") == 0).select(*key)
    open_rows = within.where(F.col("_size") > 0).withColumn("_room", F.lit(max_total_bytes).cast("long")).checkpoint(eager=True)
    while not open_rows.isEmpty():
        # bin() has as many digits as the room
        paced = open_rows.withColumn("_pivot", F.expr("shiftleft(1L, length(bin(_room)) - 1)"))
        small = F.col("_size") < F.col("_pivot")
        run = running_sum(paced, [sandbox_col], seq_col, seq_col, F.when(small, F.col("_size")).otherwise(F.lit(0)), "_run", bucket_width)
        left = F.col("_room") - F.col("_run")
        ends = F.when(small, left < F.col("_pivot")).otherwise(F.col("_size") <= left)
        after = F.when(small, left).otherwise(left - F.col("_size"))
        end = (run.where(ends).groupBy(sandbox_col)
               .agg(F.min_by(F.struct(F.col(seq_col).alias("seq"), after.alias("room")), F.col(seq_col)).alias("_end")))
        judged = run.join(end, sandbox_col, "left").checkpoint(eager=True)
        open_now = F.col("_end").isNull() | (F.col(seq_col) < F.col("_end.seq"))
        fine = judged.where((open_now & small) | (F.col(seq_col) == F.col("_end.seq"))).select(*key)
        accepted = accepted.unionByName(fine)
        open_rows = (judged.where((F.col(seq_col) > F.col("_end.seq")) & (F.col("_size") <= F.col("_end.room")))
                     .select(*key, "_size", F.col("_end.room").alias("_room")).checkpoint(eager=True))
    marked = (manifest.join(accepted.withColumn("accepted", F.lit(True)), key, "left")
              .withColumn("accepted", F.coalesce("accepted", F.lit(False))).withColumn("file_ok", size <= max_file_bytes))
    used = F.when(F.col("accepted"), size).otherwise(F.lit(0)).cast("long")
    return running_sum(marked, [sandbox_col], seq_col, seq_col, used, "running_total", bucket_width)


def sanitize_error(c) -> Column:
    """Production error messages."""
    lo = F.lower(F.coalesce(as_col(c), F.lit("")))
    sens = None
    for w in P.SENSITIVE_ERROR_WORDS:
        cond = lo.contains(w)
        sens = cond if sens is None else (sens | cond)
    return (F.when(sens, "Internal server error")
            .when(lo.contains("permission") | lo.contains("access"), "Access denied")
            .when(lo.contains("not found") | lo.contains("no such"), "Resource not found")
            .otherwise("Request failed"))


def template_errors(df: DataFrame) -> DataFrame:
    """Every failing template rule, in order, joined by '; '."""
    errs = ordered_errors(
        (~truthy("name"), "Template name is required"),
        (~truthy("base_image"), "Base image is required"),
        (~F.coalesce(F.col("memory_limit").rlike(r"^\d+[mgMG]$"), F.lit(False)), "__MEM__"),
        ((F.col("timeout") < 1) | (F.col("timeout") > 3600), "Timeout must be between 1 and 3600 seconds"))
    errs = F.transform(errs, lambda e: F.when(e == "__MEM__", F.concat(
        F.lit("Invalid memory limit format: "), F.coalesce(F.col("memory_limit"), F.lit("None")))).otherwise(e))
    return df.select("*", F.array_join(errs, "; ").alias("errors"), (F.size(errs) == 0).alias("valid"))


# ---------------------------------------------------------------- B24-B27
def rule_search(rules: DataFrame, query: str | None, enabled_only: bool = False) -> DataFrame:
    """Enabled filter + case-insensitive substring over three columns."""
    out = rules.where(F.col("enabled")) if enabled_only else rules
    q = (query or "").strip().lower()
    if not q:
        return out
    hay = F.lower(F.concat_ws(" ", F.col("workflow_id"), F.col("task_type"), F.col("scope_pattern")))
    return out.where(hay.contains(F.lit(q)))


def split_recipients(c) -> Column:
    """``a@x.io; b@y.io`` -> valid addresses joined by ', ' (null if none)."""
    raw = F.trim(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"[\r\n]", " "))
    parts = F.filter(F.transform(F.split(raw, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    ok = F.filter(parts, lambda x: x.rlike(P.EMAIL_RE))
    return F.when(F.size(ok) > 0, F.array_join(ok, ", "))


def html_escape_mail(c) -> Column:
    """B26 (mail): only ``<`` and ``>``."""
    return F.replace(F.replace(as_col(c), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_escape_full(c) -> Column:
    """B26 (console): the five entities, ``&`` first."""
    out = as_col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def base64_plain(c) -> Column:
    """Standard base64 of the UTF-8 bytes, without the line wrapping that
    Spark's ``base64`` inserts."""
    return F.regexp_replace(F.base64(F.encode(as_col(c), "UTF-8")), r"[\r\n]", "")


def base64url(c) -> Column:
    """base64url without padding."""
    return F.regexp_replace(F.translate(base64_plain(c), "+/", "-_"), "=+$", "")


def mime_subject(c) -> Column:
    """RFC 2047 encoded-word only when the subject is not ASCII."""
    s = F.trim(F.regexp_replace(F.coalesce(F.nullif(as_col(c), F.lit("")), F.lit("Daily Security Digest")),
                                r"[\r\n]", " "))
    return F.when(s.rlike(r"^[\x00-\x7F]*$"), s).otherwise(F.concat(F.lit("=?UTF-8?B?"), base64_plain(s), F.lit("?=")))
