import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions.common import ts_ntz
from vigil.operators import analytics as an


@pytest.mark.parametrize("few", [4096, 3])
def test_exact_quantiles_by_selection(spark, few):
    rng = np.random.default_rng(4)
    columns = {"even": rng.normal(size=3001), "ties": rng.integers(0, 4, 3001).astype(float), "wide": 10.0 ** rng.uniform(-200, 200, 3001),
               "same": np.full(3001, 7.5)}
    rows = [tuple(float(c[i]) for c in columns.values()) + (None, float(i) if i % 3 else None) for i in range(3001)]
    df = spark.createDataFrame(rows, "even double, ties double, wide double, same double, none double, holes double").repartition(6)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = an.exact_quantiles(df, [*columns, "none", "holes"], probs, few=few, accuracy=200)
    columns["holes"] = np.array([float(i) for i in range(3001) if i % 3])
    for name, values in columns.items():
        assert got[name] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
    assert got["none"] == [None] * len(probs)


def test_summary_of_an_empty_table(spark):
    df = spark.createDataFrame([], "sales double, revenue double, customers long")
    rows = an.summary_stats(df).collect()
    assert [(r["metric"], r["count"], r["p50"]) for r in rows] == [("sales", 0, None), ("revenue", 0, None), ("customers", 0, None)]


def test_sketches_merge_over_any_range(spark, tmp_path):
    v = spark.range(40_000).select(
        F.col("id"), (ts_ntz("2024-01-01 00:00:00") + F.make_dt_interval(mins=(F.col("id") % 600).cast("int"))).alias("created_at"),
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("scope"), F.concat(F.lit("t"), (F.col("id") % 50).cast("string")).alias("tenant_id"),
        F.sha2((F.col("id") % 30_000).cast("string"), 256).alias("content_hash"))
    path = str(tmp_path / "sketches")
    an.hourly_sketches(v).write.parquet(path)
    sketches = spark.read.parquet(path)
    assert sketches.count() == 30
    since, until = ts_ntz("2024-01-01 03:00:00"), ts_ntz("2024-01-01 08:00:00")
    for a, b in ((None, None), (since, until), (until, None)):
        part = v if a is None else v.where(F.col("created_at") >= a)
        part = part if b is None else part.where(F.col("created_at") < b)
        got = an.sketched_storage_stats(sketches, a, b).first()
        exact = part.agg(F.count("id"), F.countDistinct("tenant_id"), F.countDistinct("scope"), F.countDistinct("content_hash"),
                         F.min("created_at"), F.max("created_at")).first()
        assert (got[0], got[2], got[4], got[5]) == (exact[0], exact[2], exact[4], exact[5])
        assert abs(got[1] - exact[1]) <= 2 and abs(got[3] - exact[3]) <= 0.05 * exact[3]
        scopes = {r["scope"]: (r["vector_count"], r["unique_contents"]) for r in an.sketched_top_scopes(sketches, 10, a, b).collect()}
        for r in part.groupBy("scope").agg(F.count("id").alias("n"), F.countDistinct("content_hash").alias("c")).collect():
            assert scopes[r["scope"]][0] == r["n"] and abs(scopes[r["scope"]][1] - r["c"]) <= 0.05 * r["c"]
    none = an.sketched_storage_stats(sketches.where("false")).first()
    assert none["total_vectors"] == 0
