import json

from pyspark.sql import functions as F

from vigil.operators import vectors as vx
from vigil.sources import files as fs
from vigil.sources import snapshots as sn
from vigil.sources import standins as si
from vigil.functions.common import AS_OF


def test_embeddings_json_both_shapes(spark, tmp_path):
    p = tmp_path / "emb.jsonl"
    p.write_text('[0.1, 0.2]\n{"embedding": [1.0, 2.0, 3.0]}\n')
    rows = [r["embedding"] for r in fs.read_embeddings_json(spark, str(p)).collect()]
    assert rows == [[0.1, 0.2], [1.0, 2.0, 3.0]]


def test_reduced_json_model_export_and_reload(spark, tables, tmp_path):
    e = tables.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    mean, model = vx.pca_fit(e, 8)
    red = vx.pca_transform(e, mean, model)
    fs.write_reduced_json(red, str(tmp_path / "red"))
    r = spark.read.json(str(tmp_path / "red")).first()
    assert r["original_dims"] == 64 and r["reduced_dims"] == 8 and len(r["reduced_embedding"]) == 8
    fs.export_model_json(spark, mean, model, str(tmp_path / "model_json"))
    doc = json.loads(spark.read.text(str(tmp_path / "model_json")).first()[0])
    assert doc["n_components"] == 8 and len(doc["mean"]) == 64 and len(doc["components"][0]) == 64
    fs.save_model(spark, mean, model, str(tmp_path / "model"))
    mean2, model2 = fs.load_model(spark, str(tmp_path / "model"))
    assert mean2 == mean
    a = [r["reduced"] for r in vx.pca_transform(e, mean2, model2).orderBy("vec_id").limit(3).collect()]
    b = [r["reduced"] for r in red.orderBy("vec_id").limit(3).collect()]
    assert a == b


def test_landed_feed(spark, tmp_path):
    p = tmp_path / "kev.json"
    p.write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-1", "product": "x"}, {"cveID": "CVE-2", "product": "y"}]}))
    rows = fs.read_landed_feed(spark, str(p), "vulnerabilities").orderBy("entry_index").collect()
    assert [r["cveID"] for r in rows] == ["CVE-1", "CVE-2"]


def test_upsert_is_idempotent(spark, tables):
    rules = si.policy_workflows(tables.nation)
    inc = rules.limit(3).withColumn("constraints", F.lit('{"x":1}'))
    once = sn.upsert_rules(rules, inc, AS_OF)
    twice = sn.upsert_rules(once, inc, AS_OF)
    key = lambda df: sorted(tuple(r) for r in df.select(*sn.RULE_KEY, "constraints", "enabled", "updated_at").collect())
    assert key(once) == key(twice)
    assert once.count() == rules.count()
    seeded = sn.seed_if_absent(rules, ["ping"], AS_OF)
    assert sn.seed_if_absent(rules.unionByName(seeded), ["ping"], AS_OF).count() == 0


def test_append_and_metrics_text(spark, tables, tmp_path):
    out = str(tmp_path / "t")
    sn.append(tables.region, out)
    sn.append(tables.region, out)
    assert spark.read.parquet(out).count() == 2 * tables.region.count()
    c = spark.createDataFrame([(1, 2, 3, 0, 12.3456)], "allow long, deny long, requires_approval long, errors long, latency_sum double")
    sn.write_text_lines(sn.metrics_exposition(c), str(tmp_path / "m"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert lines[-1] == "executor_policy_eval_latency_ms_sum 12.346" and len(lines) == 11


def test_newest_sample_guard(spark, tables):
    import pytest
    mv = si.memory_documents(tables.documents)
    assert sn.newest_sample(mv, 10).count() == 10
    with pytest.raises(Exception):
        sn.newest_sample(mv.limit(5), 10, min_rows=100).collect()
    assert sn.newest_sample(mv.limit(5), 10).count() == 5


def test_append_returns_the_batch_it_wrote(spark, tmp_path):
    from vigil.sources import snapshots as sn
    path = str(tmp_path / "t")
    a = spark.range(5).select("id", (F.col("id") * 2).alias("x"))
    b = spark.range(5, 8).select("id", (F.col("id") * 2).alias("x"))
    assert sorted(r["id"] for r in sn.append_returning(a, path, "id").collect()) == [0, 1, 2, 3, 4]
    assert sorted(tuple(r) for r in sn.append_returning(b, path, "id", "x").collect()) == [(5, 10), (6, 12), (7, 14)]
    assert spark.read.parquet(path).count() == 8


def test_stable_ids_tell_nulls_from_values(spark):
    from vigil.sources import snapshots as sn
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), (None, "a", "b"), ("a", "", "b")], "x string, y string, z string")
    ids = [r[0] for r in df.select(sn.stable_id("x", "y", "z")).collect()]
    assert len(set(ids)) == 4 and all(0 <= i < 1 << 60 for i in ids)
