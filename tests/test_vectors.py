import numpy as np
from pyspark.sql import functions as F

from vigil.functions.vectors import cosine_distance
from vigil.operators import vectors as vx


def _data(spark, n=300, d=8, hot_share=0.5, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = "hot" if rng.random() < hot_share else f"g{rng.integers(0, 4)}"
        v = rng.normal(size=d)
        if i % 97 == 0:
            v = np.zeros(d)
        rows.append((i, "t1", g, [float(x) for x in v]))
    return spark.createDataFrame(rows, "id long, tenant_id string, scope string, embedding array<double>"), rows


def _brute(rows, k):
    out = {}
    for qi, _, qg, qv in rows:
        cands = []
        for vi, _, vg, vv in rows:
            if vg != qg:
                continue
            den = np.linalg.norm(qv) * np.linalg.norm(vv)
            dist = None if den == 0 else 1 - float(np.dot(qv, vv)) / den
            cands.append((dist is None, dist if dist is not None else 0.0, vi))
        cands.sort()
        out[qi] = [c[2] for c in cands[:k]]
    return out


def test_blocked_topk_matches_brute_force_with_tiny_blocks(spark):
    df, rows = _data(spark)
    q = df.select(F.col("id").alias("query_id"), "tenant_id", "scope", F.col("embedding").alias("query_vec"))
    res = vx.blocked_topk(q, df, 4, block_rows=17, query_block_rows=11).collect()
    got = {}
    for r in sorted(res, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == _brute(rows, 4)


def test_cosine_expression_matches_numpy(spark):
    df, rows = _data(spark, n=40)
    a = df.alias("a").join(df.alias("b"), F.col("a.id") == F.col("b.id") + 1)
    got = a.select(F.col("a.id"), cosine_distance(F.col("a.embedding"), F.col("b.embedding")).alias("d")).collect()
    emb = {r[0]: np.array(r[3]) for r in rows}
    for r in got:
        x, y = emb[r["id"]], emb[r["id"] - 1]
        den = np.linalg.norm(x) * np.linalg.norm(y)
        if den == 0:
            assert r["d"] is None
        else:
            assert abs(r["d"] - (1 - x @ y / den)) < 1e-12


def _queries(df):
    return df.select(F.col("id").alias("query_id"), "tenant_id", "scope", F.col("embedding").alias("query_vec"))


def _ids(matches):
    got = {}
    for r in sorted(matches.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    return got


def test_scan_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vx, "SCAN_CELLS", 50)
    monkeypatch.setattr(vx, "MERGE_PARTS", 2)
    df, rows = _data(spark)
    assert _ids(vx.exact_topk(_queries(df), df.repartition(5), 4)) == _brute(rows, 4)
    assert _ids(vx.exact_topk(_queries(df), df, 4, limit=0)) == _brute(rows, 4)  # the plan of a large batch


def test_scan_topk_does_not_move_vectors(spark, tmp_path):
    df, _ = _data(spark)
    df.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    m = vx.scan_topk(_queries(df.where("id < 5")), stored, 3)
    plan = m._jdf.queryExecution().executedPlan().toString().splitlines()
    below = plan[next(i for i, line in enumerate(plan) if "MapInArrow" in line):]
    assert any("FileScan" in line or "Scan parquet" in line for line in below)
    assert not any("Exchange" in line for line in below if "broadcast" not in line.lower())


def test_scan_topk_counts_copies_once_and_keeps_own_k(spark):
    df, rows = _data(spark, n=150)
    q = _queries(df).withColumn("k", (F.col("query_id") % 4).cast("int"))
    twice = df.unionByName(df.where("id % 2 = 0"))
    want = {i: ids[: i % 4] for i, ids in _brute(rows, 4).items() if i % 4}
    assert _ids(vx.exact_topk(q, twice, "k", copies=2)) == want
    assert _ids(vx.exact_topk(q, twice, "k", copies=2, limit=0)) == want


def test_scan_topk_without_groups_queries_or_width(spark):
    df, rows = _data(spark, n=60, hot_share=1.0)
    q = df.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    flat = df.drop("tenant_id", "scope")
    assert _ids(vx.exact_topk(q, flat, 2, group_cols=())) == _brute(rows, 2)
    assert vx.exact_topk(q.where("false"), flat, 2, group_cols=()).collect() == []
    assert vx.exact_topk(q, flat.where("false"), 2, group_cols=()).collect() == []
    import pytest
    with pytest.raises(Exception, match="Expected 8 dimensions, got 3"):
        vx.exact_topk(q, flat.withColumn("embedding", F.slice("embedding", 1, 3)), 2, group_cols=()).collect()


def test_ivf_of_any_reach_is_exact_by_its_bound(spark, tmp_path):
    df, rows = _data(spark, n=400, hot_share=0.3)
    index = vx.ivf_build(df, 6, str(tmp_path / "ivf"))
    exact = _brute(rows, 3)
    for probes, certain in ((7, False), (2, True), (1, True)):
        found, probed = vx.ivf_search(_queries(df), index, 3, probes, certain)
        assert _ids(found) == exact
    few, probed = vx.ivf_search(_queries(df), index, 3, 2)
    assert probed.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 2
    assert vx.recall_at_k(few, vx.exact_topk(_queries(df), df, 3), 3).first()["recall_at_3"] < 1


def test_ivf_recall_at_the_guidance(spark, tmp_path):
    """Lists and probes by table size; clustered vectors need less than noise."""
    rng = np.random.default_rng(1)
    for n, noise in ((1000, 0.3), (3000, 0.3), (1000, 1.0)):
        centres = rng.normal(size=(40, 16))
        vec = centres[rng.integers(0, 40, n)] + noise * rng.normal(size=(n, 16))
        df = spark.createDataFrame([(i, "t", "ab"[i % 2], [float(x) for x in v]) for i, v in enumerate(vec)],
                                   "id long, tenant_id string, scope string, embedding array<double>")
        lists = vx.ivf_lists(n)
        index = vx.ivf_build(df, lists, str(tmp_path / f"ivf{n}{noise}"), max_iter=5, train_rows=n // 2)
        q = _queries(df.where("id % 100 < 5"))
        found, probed = vx.ivf_search(q, index, 5, vx.ivf_probes(lists, n))
        assert vx.recall_at_k(found, vx.exact_topk(q, df, 5), 5).first()["recall_at_5"] >= 0.9
        assert 0 < vx.share_read(q, df, probed).first()["share_read"] < 0.75


def test_trigram_index_finds_what_a_scan_finds(spark, tmp_path):
    texts = ["Alpha beta", "ALPHABET soup", "50% off_now", "al", "", None, "straße ÄÖ", "beta alpha", "xalphax", "back\\slash 50%"] * 3
    rows = [(i, f"t{i % 2}", "s", t, i % 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, tenant_id string, scope string, content string, created_at int")
    index = vx.trigram_index(df, str(tmp_path / "tri"))
    for term in ("alpha", "ALPHA", "a", "", "0% o", "off_", "ße ä", "nothing here", "\\sl", "beta alpha"):
        for tenant in ("t1", None):
            want = [tuple(r) for r in vx.keyword_search(df, tenant, "s", term, 4).collect()]
            assert [tuple(r) for r in vx.keyword_search_indexed(index, df, tenant, "s", term, 4).collect()] == want, term
    vx.NAMED_ROWS, kept = 2, vx.NAMED_ROWS
    try:
        assert vx.keyword_search_indexed(index, df, None, "s", "alpha", 50).count() == 12
    finally:
        vx.NAMED_ROWS = kept
    r = vx.keyword_report(index, df, "t0", "s", ["alphab"]).first()
    assert (r["rows_read"], r["matches"], r["group_rows"]) == (0, 0, 15)


def test_trigrams_are_given_out_as_they_are_gathered():
    import pyarrow as pa
    schema = pa.schema([("tri", pa.string()), ("scope", pa.string()), ("ids", pa.list_(pa.int64()))])
    texts = ["".join(chr(97 + (i * k) % 23) for k in range(1, 40)) for i in range(200)] + ["", "ab"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([f"s{i % 2}" for i in range(len(texts))]), pa.array(range(len(texts)))], names=["_text", "scope", "id"])
    given = list(vx.cut_trigrams(iter([batch, batch.slice(0, 0)]), schema, held=100))
    assert max(sum(len(ids) for ids in b["ids"].to_pylist()) for b in given) < 100 + 37
    got = sorted((tri, scope, i) for b in given for tri, scope, ids in zip(*(c.to_pylist() for c in b.columns)) for i in ids)
    assert got == sorted((tri, f"s{i % 2}", i) for i, t in enumerate(texts) for tri in {t[j: j + 3] for j in range(len(t) - 2)})
    assert list(vx.cut_trigrams(iter([batch.slice(200)]), schema)) == []


def test_first_seen_cache_and_idempotent_insert(spark):
    b = spark.createDataFrame([(1, "t", "s", "h1", "x"), (2, "t", "s", "h1", "y"), (3, "t", "s", "h2", "z")],
                              "id long, tenant_id string, scope string, content_hash string, content string")
    c = {r["id"]: r["cached"] for r in vx.first_seen_cache(b).collect()}
    assert c == {1: False, 2: True, 3: False}
    stored = spark.createDataFrame([("t", "s", "h2")], "tenant_id string, scope string, content_hash string")
    ins = vx.idempotent_insert(b, stored).collect()
    assert [(r["id"], r["content"]) for r in ins] == [(1, "x")]
    again = vx.idempotent_insert(b.unionByName(b), stored.unionByName(vx.idempotent_insert(b, stored).select(
        "tenant_id", "scope", "content_hash"))).collect()
    assert again == []


def test_pca_centres_before_projection(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 6)) + 5.0
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(base)], "id long, embedding array<double>")
    mean, model = vx.pca_fit(df, 6)
    red = np.array([r["reduced"] for r in vx.pca_transform(df, mean, model).orderBy("id").collect()])
    assert np.allclose(red.mean(axis=0), 0.0, atol=1e-9)
    m = vx.compare_methods(df, mean, model, 6).first()
    assert m["reconstruction_mse"] < 1e-18


def test_blocked_topk_with_dimension_budget(spark):
    df, rows = _data(spark, n=120, d=8)
    q = df.select(F.col("id").alias("query_id"), "tenant_id", "scope", F.col("embedding").alias("query_vec"))
    res = vx.blocked_topk(q, df, 3, block_budget_bytes=4096).collect()
    got = {}
    for r in sorted(res, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == _brute(rows, 3)


def test_blocked_topk_without_groups(spark):
    df, rows = _data(spark, n=60, hot_share=1.0)
    q = df.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    res = vx.blocked_topk(q, df.drop("tenant_id", "scope"), 2, group_cols=(), block_rows=13).collect()
    got = {}
    for r in sorted(res, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == _brute(rows, 2)


def test_ties_do_not_flood_and_every_query_has_its_own_k(spark):
    """1000 equal vectors: at most k candidates per query and block, by id."""
    dist = np.zeros((3, 1000))
    rows, cols, _ = vx.best_in_block(dist, np.array([5, 1, 2000]))
    assert [int((rows == i).sum()) for i in range(3)] == [5, 1, 1000]
    assert cols[rows == 0].tolist() == [0, 1, 2, 3, 4]
    df = spark.range(1000).select("id", F.lit("t1").alias("tenant_id"), F.lit("s").alias("scope"),
                                  F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    q = df.where("id < 3").select(F.col("id").alias("query_id"), "tenant_id", "scope", F.col("embedding").alias("query_vec"),
                                  (F.col("id") * 60 + 1).cast("int").alias("k"))
    got = vx.blocked_topk(q, df, "k", block_rows=100).groupBy("query_id").agg(F.max("id").alias("m"), F.count("id").alias("n")).collect()
    assert {r["query_id"]: (r["m"], r["n"]) for r in got} == {0: (0, 1), 1: (60, 61), 2: (120, 121)}
