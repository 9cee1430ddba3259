"""C1-C4 truth table against a direct reading of the policy rules."""

import itertools

from pyspark.sql import functions as F

from vigil.operators import policy as pol

STATIC = set(pol.STATIC_ALLOWED_TASK_TYPES)


def reference_decision(action, task_type, sscope, rscope, net, admin, size, registered):
    risk = (40 if net else 0) + (35 if task_type != "" and task_type not in STATIC else 0) \
        + (10 if rscope.startswith("admin:") else 0) + (20 if size > 100000 else 0)
    is_exec = action == "executor.execute"
    allowed = task_type in STATIC or task_type in registered
    reasons = set()
    if is_exec and (task_type == "" or not allowed):
        reasons.add("task_type_not_allowed")
    if sscope != "" and rscope != "" and sscope != rscope:
        reasons.add("scope_mismatch")
    if is_exec and net and not admin:
        reasons.add("network_not_allowed")
    approval = 40 <= risk < 80
    if approval:
        reasons.add("high_risk_requires_approval")
    allow = not reasons
    decision = "allow" if allow else ("requires_approval" if approval else "deny")
    return risk, ",".join(sorted(reasons)), approval, allow, decision


def test_truth_table(spark):
    combos = list(itertools.product(
        ["executor.execute", "memory.ingest"], ["", "ping", "custom_job", "registered_job"],
        ["", "user:1"], ["", "user:1", "user:2", "admin:1"], [True, False], [True, False], [10, 200000]))
    rows = [(f"r{i}",) + c for i, c in enumerate(combos)]
    df = spark.createDataFrame(rows, "request_id string, action string, task_type string, subject_scope string, "
                                     "resource_scope string, network_enabled boolean, network_admin boolean, "
                                     "payload_size long")
    reg = spark.createDataFrame([("wf", "registered_job", True), ("wf2", "custom_job", False)],
                                "workflow_id string, task_type string, enabled boolean")
    out = {r["request_id"]: r for r in pol.evaluate(df, reg).select(
        "request_id", "risk_score", F.array_join("reasons", ",").alias("reasons"), "requires_approval",
        "allow", "decision").collect()}
    for rid, *c in rows:
        exp = reference_decision(*c[:6], c[6], {"registered_job"})
        r = out[rid]
        assert (r["risk_score"], r["reasons"], r["requires_approval"], r["allow"], r["decision"]) == exp, (c, r)


def test_example_input_is_allowed(spark):
    df = spark.createDataFrame([("x", "executor.execute", "ping", "user:123", "user:123", False, False, 256)],
                               "request_id string, action string, task_type string, subject_scope string, "
                               "resource_scope string, network_enabled boolean, network_admin boolean, "
                               "payload_size long")
    r = pol.evaluate(df).first()
    assert r["decision"] == "allow" and r["risk_score"] == 0 and r["reasons"] == []


def test_unregistered_task_type_is_denied(spark):
    df = spark.createDataFrame([("x", "executor.execute", "unknown_type", "s", "s", False, False, 1)],
                               "request_id string, action string, task_type string, subject_scope string, "
                               "resource_scope string, network_enabled boolean, network_admin boolean, "
                               "payload_size long")
    r = pol.evaluate(df).first()
    assert r["decision"] == "deny" and "task_type_not_allowed" in r["reasons"]
