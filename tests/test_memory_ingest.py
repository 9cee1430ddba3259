import datetime as dt
import re

from vigil.operators import vectors as vx
from vigil.plans import catalog
from vigil.plans.memory_ingest import ingest_job
from vigil.sources import standins as si


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def _depth(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


def test_ingest_outcomes(spark):
    """Each kind of request, and what the append carries of it."""
    t0 = dt.datetime(2024, 1, 1)
    vec, long = [1.0, 2.0, 3.0], "x " * 60000
    rows = [("t", "s", "new", "r1", vec, t0), ("t", "s", "new", "r2", vec, t0 + dt.timedelta(1)), ("t", "s", "new", "r1", vec, t0),
            ("t", "s", "held", "r3", vec, t0), ("t", "s", long, "r4", vec, t0), ("t", "s", "api_key x", "r5", vec, t0), (None, "s", "a", "r6", vec, t0),
            ("t", "s", "bare", "r7", None, t0), ("t", "s", "thin", "r8", vec[:2], t0), ("t", "s", None, "r9", vec, t0)]
    req = spark.createDataFrame(
        [(*r, "src", ["tag"], [("a", "b", r[3], 0.9)]) for r in rows],
        "tenant_id string, scope string, text string, request_id string, embedding array<double>, created_at timestamp_ntz, source string, tags array<string>,"
        "facts array<struct<subject:string,predicate:string,object:string,confidence:double>>")
    held = vx.content_hash(spark.createDataFrame([(7, "t", "s", "held")], "id long, tenant_id string, scope string, content string"))
    mean, model = vx.pca_fit(spark.createDataFrame([(vec,), ([2.0, 1.0, 0.0],), ([0.0, 5.0, 1.0],)], "embedding array<double>"), 2)
    job = ingest_job(req, held.drop("content"), mean, model, 3)
    got = {r["request_id"]: (r["outcome"], r["error"], r["id"] is not None) for r in job.outcomes.collect()}
    assert job.outcomes.count() == len(rows)
    missing = ("rejected", "Missing required fields: tenant_id, scope, text", False)
    assert got == {"r1": ("appended", None, True), "r2": ("cached", None, True), "r3": ("cached", None, True),
                   "r4": ("needs_approval", "Policy requires approval", False),
                   "r5": ("rejected", "Rejected: potential secret detected in text", False), "r6": missing, "r9": missing,
                   "r7": ("rejected", "Expected 3 dimensions, got 0", False), "r8": ("rejected", "Expected 3 dimensions, got 2", False)}
    [v] = job.vectors.collect()
    assert (v["request_id"], v["content"], v["tags"], len(v["embedding"])) == ("r1", "new", ["tag"], 2)
    assert sorted(f["object"] for f in job.facts.collect()) == ["r1", "r1", "r2", "r3"]


def test_ingest_carries_no_closed_content(spark, tables):
    """Below the look-up the content of a request that can't be appended is gone."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 500)
    try:
        plan = _plan(catalog._ingest(tables).vectors)
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    lookup = [i for i, x in enumerate(plan) if "Join LeftOuter" in x and "content_hash" in x]
    kept = [i for i, x in enumerate(plan) if re.search(r"CASE WHEN isnull\(_closed#\d+\) THEN (content|text)#\d+ END AS content#", x)]
    assert any(i > lookup[-1] or _depth(plan[i]) > max(_depth(plan[j]) for j in lookup if j < i) for i in kept)


def test_ingest_shuffles_texts_as_stored(tables):
    """The long texts are made, and the stored hashes taken, on the side of the join where no text is shuffled for them."""
    plan = _plan(catalog._ingest(tables).outcomes)
    made = [i for i, x in enumerate(plan) if "repeat(" in x and "Project [" in x]  # a filter may test them where they are read
    assert made
    for i in made:  # the join with the vectors lies below
        below = next((x for x in plan[i + 1:] if "Join" in x), "")
        assert "doc_id" in below and _depth(below) > _depth(plan[i])
    stored = _plan(si.memory_vectors(tables.embeddings, tables.documents).select("id", "content_hash"))
    join = next(_depth(x) for x in stored if "Join" in x)
    hashed = [_depth(x) for x in stored if "sha2(" in x and "Project [" in x]
    assert hashed and min(hashed) > join
