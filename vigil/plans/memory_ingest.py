"""Memory ingest as one set-oriented job.

requests → validation, secret rejection and fact filter (B1, B13, B14) →
policy (C1-C5) → content hash and lookup in the stored table (D1, D2) →
dimension check of the supplied embedding (D16) → first of each key in the
batch (D3) → PCA reduction (D6) → vector rows with their ids and fact rows to
append (A8, A9), one audit row per decided request (E4) and one outcome per
request.

Every request ends in exactly one outcome: rejected, needs_approval, denied,
cached or appended.  Boundaries are two shuffles on the dedupe key.  Nothing
is written here: the caller appends the returned frames
(``sources.snapshots.append``), so that a retry of the job is idempotent.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as au
from ..operators import policy as pol
from ..operators import validate as va
from ..operators import vectors as vx
from ..sources.snapshots import stable_id


class Ingest(NamedTuple):
    vectors: DataFrame  # rows to append to memory_vectors
    facts: DataFrame  # rows to append to memory_facts
    outcomes: DataFrame  # one row per request
    audit: DataFrame  # one row per decided request


def ingest_job(requests: DataFrame, stored: DataFrame, mean, model, expected_dims: int) -> Ingest:
    """``requests``: tenant_id, scope, text, source, request_id, tags, facts,
    embedding, created_at.  ``stored``: the current vector table (id,
    tenant_id, scope, content_hash).  ``mean``/``model``: a fitted reducer (D5).

    A memory write never reads the registry: the task-type rule applies to
    executor.execute only, and the risk score reads the static list."""
    key = list(vx.KEY)
    v = va.validate_ingest(requests).select(
        F.col("request_id_norm").alias("request_id"), "tenant_id", "scope", F.col("text").alias("content"),
        F.col("source_norm").alias("source"), F.col("tags_norm").alias("tags"), F.col("facts_norm").alias("facts"),
        "embedding", "created_at", F.col("error").alias("_invalid"),
        F.lit("memory.ingest").alias("action"), F.lit("memory_ingest").alias("task_type"),
        F.col("scope").alias("subject_scope"), F.col("scope").alias("resource_scope"),
        F.lit(False).alias("network_enabled"), F.lit(False).alias("network_admin"),
        F.length("text").cast("long").alias("payload_size"))
    # a memory write of the request's own scope
    decided = vx.content_hash(pol.evaluate(v))
    width = F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(0))
    closed = (F.when(F.col("_invalid").isNotNull(), "rejected")
              .when(F.col("decision") == "requires_approval", "needs_approval")
              .when(F.col("decision") != "allow", "denied"))
    # what the two shuffles carry: a request that is closed already brings neither its
    # content (a large one needs approval) nor its vector, for it is never appended
    asked = decided.withColumns({"_closed": closed, "_width": width}).select(
        *key, "request_id", "source", "tags", "facts", "created_at", "_invalid", "_closed", "_width",
        *[F.when(F.col("_closed").isNull(), F.col(c)).alias(c) for c in ("content", "embedding")])
    known = vx.cache_lookup(asked, stored)
    outcome = (F.when(F.col("_closed").isNotNull(), F.col("_closed"))
               .when(F.col("cached"), "cached")
               .when(F.col("_width") != expected_dims, "rejected"))
    wrong = F.concat(F.lit(f"Expected {expected_dims} dimensions, got "), F.col("_width").cast("string"))
    judged = known.withColumn("outcome", outcome).withColumn(
        "error", F.when(F.col("_invalid").isNotNull(), F.col("_invalid"))
        .when(F.col("outcome") == "needs_approval", "Policy requires approval").when(F.col("outcome") == "denied", "Policy denied")
        .when(F.col("outcome") == "rejected", wrong))
    # the first request of each key that is still open is appended, the others find it
    mark = F.struct("created_at", "request_id")
    first = judged.where("outcome is null").groupBy(*key).agg(F.min(mark).alias("_first"))
    new_id = stable_id(*key)
    done = judged.join(first, key, "left").withColumn(
        "outcome", F.coalesce("outcome", F.when(mark == F.col("_first"), "appended").otherwise("cached"))).withColumn(
        "id", F.when(F.col("outcome").isin("appended", "cached"), F.coalesce("cached_id", new_id)))
    fresh = done.where("outcome = 'appended'")
    one = fresh.dropDuplicates(key)  # the same request twice in a batch is one row
    reduced = vx.pca_transform(one, mean, model, "embedding", "_reduced")
    vectors = reduced.select("id", "tenant_id", "scope", "content", "source", "tags", "content_hash",
                             F.col("_reduced").alias("embedding"), "created_at", "request_id")
    facts = (done.where("outcome in ('appended', 'cached')")
             .select("request_id", F.explode("facts").alias("f")).select("request_id", "f.*"))
    outcomes = done.select("request_id", "tenant_id", "scope", "outcome", "id", "error")
    audit = au.build_audit_rows(decided.where("_invalid is null"), "workflow:memory_ingest", "memory_write")
    return Ingest(vectors, facts, outcomes, audit)
