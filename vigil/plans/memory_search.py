"""Memory search as one job: validation (B2) → exact top-k
per (tenant, scope) (D10/D11) → response rows (B28)
and one audit row per request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import validate as va
from ..operators import vectors as vx


def search_job(requests: DataFrame, vectors: DataFrame):
    """``requests``: query_id, tenant_id, scope, query, k, query_vec.
    Returns (responses, audit_rows).  Each request's own ``k`` (default 5)
    holds, without an upper bound."""
    v = va.validate_search(requests)
    ok = v.where(F.col("error").isNull())
    m = vx.exact_topk(ok.select("query_id", "tenant_id", "scope", "query_vec", "k_norm"), vectors, "k_norm")
    resp = vx.search_response(ok, m, vectors)
    audit = ok.select(F.lit("workflow:vector_search").alias("actor"), F.lit("memory_read").alias("action"),
                      F.col("scope").alias("target"), F.lit("allowed").alias("decision"), "query_id")
    return resp, audit
