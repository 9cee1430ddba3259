"""Policy registry (H1-H14) as set operations on rule tables.

Rules are rows keyed by (workflow_id, task_type, tenant_id, scope_pattern).
A published revision is stored as *rows tagged with the revision id*
(``publish_rows``), which scales with the registry; the single JSON payload
of the reference (``publish_payload``) is offered for registries small
enough to be one document.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import ts_ntz

RULE_KEY = ("workflow_id", "task_type", "tenant_id", "scope_pattern")
RULE_COLS = ("workflow_id", "task_type", "tenant_id", "scope_pattern", "constraints", "enabled")


def list_rules(rules: DataFrame, n: int = 500) -> DataFrame:
    """H1: newest ``n`` rules (report size of the reference listing)."""
    return (rules.select(*RULE_COLS, "updated_at")
            .orderBy(F.col("updated_at").desc_nulls_last(), *[F.col(c).asc() for c in RULE_KEY]).limit(n))


def latest_rule(rules: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """H2: the most recently updated rule per (workflow_id, task_type),
    optionally restricted to the requested keys (many-to-one join)."""
    cols = [c for c in rules.columns if c not in ("workflow_id", "task_type")]
    latest = (rules.groupBy("workflow_id", "task_type")
              .agg(F.max_by(F.struct(*cols), F.struct("updated_at", "id")).alias("_r"))
              .select("workflow_id", "task_type", "_r.*"))
    if requests is None:
        return latest
    return requests.select("workflow_id", "task_type").distinct().join(latest, ["workflow_id", "task_type"], "inner")


def unregistered_workflows(workflow_entity: DataFrame, rules: DataFrame, n: int = 300) -> DataFrame:
    """H3: active workflow names with no registry rule (NOT EXISTS -> anti join)."""
    wf = (workflow_entity.where(F.coalesce(F.col("active"), F.lit(True)))
          .select(F.col("name").alias("workflow_id")).distinct())
    return (wf.join(rules.select("workflow_id"), "workflow_id", "left_anti")
            .orderBy("workflow_id").limit(n))


def unregistered_task_types(candidate_events: DataFrame, rules: DataFrame, n: int = 300) -> DataFrame:
    """H4: task types seen in candidate events with no registry rule."""
    tt = candidate_events.where(F.col("task_type").isNotNull()).select("task_type").distinct()
    return tt.join(rules.select("task_type"), "task_type", "left_anti").orderBy("task_type").limit(n)


def policy_task_types(rules: DataFrame, n: int = 300) -> DataFrame:
    """H5: distinct task types of the registry."""
    return rules.select("task_type").distinct().orderBy("task_type").limit(n)


def merge_candidates(workflow_ids: DataFrame, workflow_task_types: DataFrame, policy_types: DataFrame) -> DataFrame:
    """H6: trim, drop empty, unique, sort (byte order), counts.  Inputs are
    the bounded (≤ 300 row) candidate lists of H3-H5."""
    def clean(df, c):
        return df.select(F.nullif(F.trim(F.col(c)), F.lit("")).alias("v")).agg(
            F.array_sort(F.collect_set("v")).alias("a"))
    w = clean(workflow_ids, "workflow_id").withColumnRenamed("a", "workflow_ids")
    t = clean(workflow_task_types, "task_type").withColumnRenamed("a", "task_types_workflow")
    p = clean(policy_types, "task_type").withColumnRenamed("a", "task_types_policy")
    # three one-row frames side by side: scalar subqueries, no join
    return w.select(F.lit("ok").alias("status"), "workflow_ids",
                    t.select("task_types_workflow").scalar().alias("task_types_workflow"),
                    p.select("task_types_policy").scalar().alias("task_types_policy")) \
            .select("*", F.size("workflow_ids").alias("n_workflow_ids"),
                    F.size("task_types_workflow").alias("n_task_types_workflow"),
                    F.size("task_types_policy").alias("n_task_types_policy"))


def publish_rows(rules: DataFrame, revision_id: str) -> DataFrame:
    """H7 (scalable form): every rule, disabled ones too, tagged with the
    revision id — a revision is a set of rows, written as a table."""
    return rules.select(F.lit(revision_id).alias("revision_id"), *RULE_COLS)


def publish_payload(rules: DataFrame) -> DataFrame:
    """H7 (document form): ``{"workflows": [...]}`` as one JSON text, rules
    in key order.  One row for the whole registry: use for registries that
    fit one document (the reference's revision payload)."""
    s = F.struct(*[F.col(c) for c in RULE_COLS])
    return rules.agg(F.to_json(F.struct(F.sort_array(F.collect_list(s)).alias("workflows"))).alias("payload"))


PAYLOAD_SCHEMA = ("struct<workflows:array<struct<workflow_id:string,task_type:string,tenant_id:string,"
                  "scope_pattern:string,constraints:string,enabled:boolean>>>")


def load_payload(revisions: DataFrame, payload_col: str = "payload") -> DataFrame:
    """H8: revision payload back to rows (``inline``) with its count."""
    p = F.from_json(F.col(payload_col), PAYLOAD_SCHEMA)
    w = F.coalesce(p["workflows"], F.array().cast(
        "array<struct<workflow_id:string,task_type:string,tenant_id:string,scope_pattern:string,"
        "constraints:string,enabled:boolean>>"))
    return revisions.select("revision_id", F.size(w).alias("count"), F.inline_outer(w))


def load_revision_rows(rows: DataFrame) -> DataFrame:
    """H8 (scalable form): the rules of each stored revision with their count; the
    counts are one row per revision, joined many to one."""
    counts = rows.groupBy("revision_id").agg(F.count(F.lit(1)).cast("int").alias("count"))
    return rows.join(counts, "revision_id").select("revision_id", "count", *RULE_COLS)


def publish_revision(revisions: DataFrame, revision_id: str, as_of: _dt.datetime) -> DataFrame:
    """H7: the revision table after publishing: the revision is inserted, or
    overwritten if its id is there, and is the only active one."""
    new = revisions.sparkSession.range(1).select(
        F.lit(revision_id).alias("revision_id"), F.lit("published").alias("status"), ts_ntz(as_of).alias("published_at"), F.lit(True).alias("is_active"))
    others = revisions.where(F.col("revision_id") != revision_id).withColumn("is_active", F.lit(False))
    return others.select(*new.columns).unionByName(new)


def log_rows(df: DataFrame, revision_id, action: str, actor_col: str = "actor", result: str = "ok",
             detail_cols=()) -> DataFrame:
    """H9: publish / upsert / delete log rows with JSON details."""
    rid = revision_id if not isinstance(revision_id, str) else F.lit(revision_id)
    det = F.to_json(F.struct(*[F.col(c) for c in detail_cols])) if detail_cols else F.lit("{}")
    return df.select(rid.alias("revision_id"), F.lit(action).alias("action"),
                     F.coalesce(F.col(actor_col), F.lit("n8n-ce")).alias("actor"),
                     F.lit(result).alias("result"), det.alias("details"))


def bundle_merge(static: DataFrame, runtime: DataFrame) -> DataFrame:
    """The runtime registry overrides the static data field by field.
    Both inputs are one-row frames; each runtime field is a scalar
    subquery, so no join is planned."""
    return static.select(*[
        F.coalesce(runtime.select(F.col(c)).scalar(), F.col(c)).alias(c) if c in runtime.columns else F.col(c)
        for c in static.columns])


def validate_runtime_publish(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Body must parse and carry ``workflows`` as an array; revision id
    defaults to ``rev-<epoch>`` of the given clock column; count."""
    v = F.try_parse_json(F.col(body_col))
    wf = F.variant_get(v, "$.workflows", "variant")
    is_arr = F.coalesce(F.schema_of_variant(wf).startswith("ARRAY"), F.lit(False))
    rid = F.trim(F.coalesce(F.variant_get(v, "$.revision_id", "string"), F.lit("")))
    return df.select("*",
                     F.when(~is_arr, F.lit("workflows must be array")).alias("error"),
                     F.when(rid != "", rid).otherwise(
                         F.concat(F.lit("rev-"), F.timestamp_diff("SECOND", ts_ntz("1970-01-01 00:00:00"),
                                                                  F.col("received_at")).cast("string")))
                     .alias("revision_id"),
                     F.when(is_arr, F.json_array_length(F.to_json(wf))).alias("count"))


def enabled_count_and_reflection(rules: DataFrame, runtime_current: DataFrame, requested_revision: str) -> DataFrame:
    """Enabled-rule count and whether the runtime shows the requested
    revision."""
    cur = runtime_current.select(F.max("revision_id")).scalar()
    return rules.agg(F.count_if(F.col("enabled")).alias("enabled_rules")).select(
        "enabled_rules", cur.alias("current_revision"),
        F.coalesce(cur == F.lit(requested_revision), F.lit(False)).alias("reflected"))


def revision_history(revisions: DataFrame) -> DataFrame:
    """Revisions newest first."""
    return revisions.orderBy(F.col("published_at").desc_nulls_last(), F.col("revision_id").desc())


def rollback(rules: DataFrame, revision_rows: DataFrame, to_revision: str, new_revision: str,
             as_of: _dt.datetime) -> DataFrame:
    """Upsert the rows of ``to_revision`` into the registry (A10) and
    return the rows of the new revision (H7, row form)."""
    from ..sources.snapshots import upsert_rules
    prev = revision_rows.where(F.col("revision_id") == to_revision).select(*RULE_COLS)
    merged = upsert_rules(rules, prev, as_of)
    return publish_rows(merged, new_revision)
