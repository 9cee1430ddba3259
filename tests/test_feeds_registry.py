import datetime as dt

from pyspark.sql import functions as F

from vigil.functions.common import AS_OF
from vigil.operators import feeds as fd
from vigil.operators import registry as rg
from vigil.sources import snapshots as sn

NVD = ("pos long, id string, published string, cvss_v31 double, cvss_v30 double, cvss_v2 double, "
       "descriptions array<struct<lang:string,value:string>>")
KEV = "pos long, cveID string, vendorProject string, product string, dueDate string, shortDescription string"


def test_cvss_fallback_and_js_number_text(spark):
    rows = [(1, "A", "2024-01-02T00:00", None, 10.0, 5.0, [("en", "x  y")]),
            (2, "B", None, None, None, 7.5, [("es", "z")]),
            (3, "C", "2024-01-03", None, None, None, [])]
    out = fd.first_cves(spark.createDataFrame(rows, NVD), "pos").collect()
    assert [(r["cvss"], r["description_en"]) for r in out] == [("10", "x  y"), ("7.5", ""), ("-", "")]


def test_digest_with_empty_lists(spark):
    kev = spark.createDataFrame([], KEV)
    nvd = spark.createDataFrame([], NVD)
    d = fd.factual_digest(kev, nvd, AS_OF).first()["factual_digest"]
    assert d == ("Date: 2024-01-31\nCISA_KEV_Total: 0\nNVD_24h_Total: 0\n\n### CISA KEV (Top 3)\n- none\n\n"
                 "### NVD New CVEs (Top 3)\n- none")


def test_digest_lines(spark):
    kev = spark.createDataFrame([(i, f"CVE-{i}", None, "p", None, "  a\t b  " if i == 4 else None) for i in range(1, 5)], KEV)
    nvd = spark.createDataFrame([(1, "N1", "2024-01-02T10:00", 9.8, None, None, [("en", "d")])], NVD)
    d = fd.factual_digest(kev, nvd, AS_OF).first()["factual_digest"].split("\n")
    assert d[5:9] == ["- CVE-4 | Unknown p | due=-", "  note: a b", "- CVE-3 | Unknown p | due=-",
                      "- CVE-2 | Unknown p | due=-"]
    assert d[-2:] == ["- N1 | CVSS=9.8 | published=2024-01-02", "  summary: d"]


def test_header_lookup_case_insensitive(spark):
    df = spark.createDataFrame([([("SUBJECT", "hi"), ("From", None)],)], "headers array<struct<name:string,value:string>>")
    r = df.select(fd.header("headers", "subject").alias("s"), fd.header("headers", "date").alias("d"),
                  fd.header("headers", "from").alias("f")).first()
    assert (r["s"], r["d"], r["f"]) == ("hi", "Unknown", None)


def test_merge_candidates_and_publish_validation(spark):
    w = spark.createDataFrame([(" b ",), ("a",), ("",), ("a",)], "workflow_id string")
    t = spark.createDataFrame([("x",)], "task_type string")
    p = spark.createDataFrame([], "task_type string")
    r = rg.merge_candidates(w, t, p).first()
    assert (r["workflow_ids"], r["n_workflow_ids"], r["task_types_policy"], r["n_task_types_policy"]) == (["a", "b"], 2, [], 0)
    bodies = [('{"workflows":[{},{}],"revision_id":" r1 "}',), ('{"workflows":{}}',), ("nope",)]
    df = spark.createDataFrame(bodies, "body string").withColumn("received_at", F.lit(dt.datetime(2024, 1, 31)).cast("timestamp_ntz"))
    got = [(x["error"], x["revision_id"], x["count"]) for x in rg.validate_runtime_publish(df).collect()]
    assert got == [(None, "r1", 2), ("workflows must be array", "rev-1706659200", None),
                   ("workflows must be array", "rev-1706659200", None)]


def test_upsert_conflict_stamps_and_keeps_created(spark):
    old = spark.createDataFrame([(1, "*", "ping", "*", "*", "{}", True, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))],
                                "id long, workflow_id string, task_type string, tenant_id string, scope_pattern string, "
                                "constraints string, enabled boolean, created_at timestamp_ntz, updated_at timestamp_ntz")
    inc = spark.createDataFrame([("*", "ping", "*", "*", '{"a":1}', False, 1), ("*", "ping", "*", "*", '{"a":2}', True, 2),
                                 ("w", "new", "*", "*", None, None, 3)],
                                "workflow_id string, task_type string, tenant_id string, scope_pattern string, "
                                "constraints string, enabled boolean, seq long")
    out = {r["task_type"]: r for r in sn.upsert_rules(old, inc, AS_OF, order_col="seq").collect()}
    assert out["ping"]["id"] == 1 and out["ping"]["constraints"] == '{"a":2}' and out["ping"]["enabled"] is True
    assert out["ping"]["created_at"] == dt.datetime(2024, 1, 1) and out["ping"]["updated_at"] == AS_OF
    assert out["new"]["constraints"] == "{}" and out["new"]["enabled"] is True and out["new"]["created_at"] == AS_OF
