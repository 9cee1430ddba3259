"""Policy decision (C1-C11): the access-policy rules evaluated as columns
over a table of requests.

Request columns used: ``action``, ``subject_scope``, ``network_admin``,
``resource_scope``, ``task_type``, ``network_enabled``, ``payload_size``.
Every rule is a Catalyst expression; the only data access is the optional
registry join for the dynamic allow-list (C5), done on the *distinct*
enabled task types so the build side is one row per type.  Its size is
checked at runtime by AQE (broadcast under the threshold, sort-merge
otherwise) instead of an unconditional broadcast hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the policy data document (must equal the reference).
STATIC_ALLOWED_TASK_TYPES = ("ping", "health_check", "code_execution", "security_digest_mail")
REQUIRES_APPROVAL_THRESHOLD = 40
DENY_THRESHOLD = 80
POLICY_ID = "executor-core-v1"
POLICY_VERSION = "2026-02-20"
# Runtime gate of the task runner after the policy decision.
RUNTIME_TASK_TYPES = ("ping", "health_check")

EXECUTE = "executor.execute"


def _str(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def risk_score(allowed=STATIC_ALLOWED_TASK_TYPES) -> Column:
    """40 network + 35 unknown task type + 10 admin scope + 20 large payload."""
    tt = _str("task_type")
    return ((F.when(_flag("network_enabled"), 40).otherwise(0))
            + F.when((tt != "") & ~tt.isin(*allowed), 35).otherwise(0)
            + F.when(_str("resource_scope").startswith("admin:"), 10).otherwise(0)
            + F.when(F.coalesce(F.col("payload_size"), F.lit(0)) > 100000, 20).otherwise(0))


def registered_task_types(registry: DataFrame) -> DataFrame:
    """C5 build side: distinct task types of enabled registry rows
    (tenant, scope and constraints do not take part in the decision)."""
    return (registry.where(F.coalesce(F.col("enabled"), F.lit(True)))
            .select(F.coalesce(F.col("task_type"), F.lit("")).alias("_reg_task_type"))
            .distinct()
            .withColumn("_registered", F.lit(True)))


def evaluate(requests: DataFrame, registry: DataFrame | None = None,
             allowed=STATIC_ALLOWED_TASK_TYPES,
             approval_at: int = REQUIRES_APPROVAL_THRESHOLD,
             deny_at: int = DENY_THRESHOLD,
             deny_at_threshold: bool = False) -> DataFrame:
    """Risk score, sorted deny reasons, approval flag, decision.

    ``deny_at_threshold`` turns on the stricter reading (risk >= deny
    threshold is denied); the default keeps the reference behaviour where
    such a request with no other reason is allowed.

    Pass ``registry`` only when ``task_type`` varies per row: with a
    constant task type the lookup degenerates (Catalyst folds the join key);
    decide that single type once instead.
    """
    df = requests
    if registry is not None:
        reg = registered_task_types(registry)
        df = (df.join(reg, _str("task_type") == reg["_reg_task_type"], "left")
              .drop("_reg_task_type"))
        dynamic = F.coalesce(F.col("_registered"), F.lit(False))
    else:
        dynamic = F.lit(False)
    tt = _str("task_type")
    is_exec = F.col("action") == EXECUTE
    type_ok = tt.isin(*allowed) | dynamic
    deny_task = is_exec & ((tt == "") | ~type_ok)
    ss, rs = _str("subject_scope"), _str("resource_scope")
    deny_scope = (ss != "") & (rs != "") & (ss != rs)
    deny_net = is_exec & _flag("network_enabled") & ~_flag("network_admin")
    risk = F.col("risk_score")
    approval = (risk >= approval_at) & (risk < deny_at)
    high = F.lit(False) if not deny_at_threshold else (risk >= deny_at)
    reasons = F.array_sort(F.array_compact(F.array(
        F.when(deny_task, F.lit("task_type_not_allowed")),
        F.when(deny_scope, F.lit("scope_mismatch")),
        F.when(deny_net, F.lit("network_not_allowed")),
        F.when(approval, F.lit("high_risk_requires_approval")),
        F.when(high, F.lit("risk_above_deny_threshold")))))
    out = (df.withColumn("risk_score", risk_score(allowed))
           .withColumn("reasons", reasons)
           .withColumn("requires_approval", approval)
           .withColumn("allow", F.size("reasons") == 0)
           .withColumn("decision", F.when(F.col("allow"), "allow")
                       .when(F.col("requires_approval"), "requires_approval").otherwise("deny"))
           .withColumn("policy_id", F.lit(POLICY_ID))
           .withColumn("policy_version", F.lit(POLICY_VERSION)))
    return out.drop("_registered") if registry is not None else out


RESULT_SCHEMA = ("struct<policy_id:string,policy_version:string,decision:string,allow:boolean,"
                 "requires_approval:boolean,risk_score:bigint,reasons:string>")


REPLY_SCHEMA = ("struct<result:struct<policy_id:string,policy_version:string,decision:string,allow:string,"
                "requires_approval:string,risk_score:string,reasons:string>>")


def normalize_result(df: DataFrame, col: str = "result_json") -> DataFrame:
    """Normalise a policy-service JSON result (parsed once).

    Defaults: ids ``unknown``, decision ``deny``; ``allow`` and
    ``requires_approval`` derived from the decision when absent; a scalar
    ``reasons`` becomes a one-element array; risk as int (0 when absent).
    Fields are read as text (a JSON array/object field arrives as its raw
    JSON), so every shape the service may send parses with one schema."""
    r = F.from_json(F.col(col), REPLY_SCHEMA)["result"]
    decision = F.coalesce(r["decision"], F.lit("deny"))
    reasons_raw = r["reasons"]
    reasons = (F.when(reasons_raw.isNull(), F.array().cast("array<string>"))
               .when(reasons_raw.startswith("["), F.from_json(reasons_raw, "array<string>"))
               .otherwise(F.array(reasons_raw)))
    return df.select(
        "*",
        F.coalesce(r["policy_id"], F.lit("unknown")).alias("policy_id"),
        F.coalesce(r["policy_version"], F.lit("unknown")).alias("policy_version"),
        decision.alias("decision"),
        F.coalesce(r["allow"].try_cast("boolean"), decision == "allow").alias("allow"),
        F.coalesce(r["requires_approval"].try_cast("boolean"), decision == "requires_approval").alias("requires_approval"),
        F.coalesce(r["risk_score"].try_cast("double").cast("int"), F.lit(0)).alias("risk_score"),
        reasons.alias("reasons"))


def fallback(df: DataFrame, fail_mode: str = "open") -> DataFrame:
    """Rows whose policy result is missing get the fail-open (allow) or
    fail-closed (deny + approval) result with reason ``policy_unavailable``."""
    open_mode = fail_mode == "open"
    miss = F.col("decision").isNull()
    fb_decision = "allow" if open_mode else "deny"

    def pick(c, v):
        return F.when(miss, v).otherwise(F.col(c)).alias(c)

    others = [c for c in df.columns if c not in
              ("policy_id", "policy_version", "decision", "allow", "requires_approval", "risk_score", "reasons")]
    return df.select(
        *others,
        pick("policy_id", F.lit("fallback")), pick("policy_version", F.lit("fallback")),
        pick("decision", F.lit(fb_decision)), pick("allow", F.lit(open_mode)),
        pick("requires_approval", F.lit(not open_mode)), pick("risk_score", F.lit(0)),
        pick("reasons", F.array(F.lit("policy_unavailable"))),
        miss.alias("policy_unavailable"))


def workflow_gate(df: DataFrame) -> DataFrame:
    """Workflow gate.  A missing result becomes the workflow's own
    fallback (deny, approval required, ``invalid_policy_response``); a
    non-allow decision yields the error message and, for approval, the
    approval endpoint."""
    miss = F.col("decision").isNull()
    decision = F.when(miss, F.lit("deny")).otherwise(F.col("decision"))
    status = F.when(decision == "allow", "ok").otherwise("error")
    message = (F.when(decision == "allow", F.lit(None).cast("string"))
               .when(decision == "requires_approval", "Policy requires approval")
               .otherwise("Policy denied"))
    endpoint = F.when(decision == "requires_approval", F.lit("/webhook/policy/approval"))
    return df.select("*", decision.alias("gate_decision"), status.alias("status"),
                     message.alias("message"), endpoint.alias("approval_endpoint"),
                     F.when(miss, F.lit("invalid_policy_response")).alias("gate_reason"))


def enforce(df: DataFrame, mode: str = "shadow") -> DataFrame:
    """Shadow passes every request, enforce passes only ``allow``."""
    if mode != "enforce":
        return df
    return df.where(F.coalesce(F.col("allow"), F.lit(False)))


def runtime_gate(df: DataFrame, allowed=RUNTIME_TASK_TYPES) -> DataFrame:
    """The task runner accepts only its own task types."""
    return df.withColumn("runtime_accepted", F.coalesce(F.col("task_type").isin(*allowed), F.lit(False)))


def counter_columns(df: DataFrame, latency_col: str | None = "latency_ms") -> list[Column]:
    """C11's aggregates over ``df``; an unknown decision counts as deny."""
    d = F.col("decision")
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(d == "allow").alias("allow"),
            F.count_if(~F.coalesce(d.isin("allow", "requires_approval"), F.lit(False))).alias("deny"),
            F.count_if(d == "requires_approval").alias("requires_approval"),
            F.count_if(F.coalesce(F.col("policy_unavailable"), F.lit(False))).alias("errors")]
    if latency_col and latency_col in df.columns:
        aggs.append(F.sum(latency_col).alias("latency_sum"))
    return aggs


def decision_counters(df: DataFrame, latency_col: str | None = "latency_ms") -> DataFrame:
    """C11: totals by decision."""
    return df.agg(*counter_columns(df, latency_col))
