import duckdb
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage is given and what it makes, over the whole small table."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        made = stage(spark, docs, SF)
        rows = [r.asDict() for r in made.collect()]
        out.append((name, [r.asDict() for r in docs.collect()], rows, made.columns))
        docs = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema) if name != "packed" else docs
    return out


def test_columns_and_order(stages):
    assert [s[0] for s in stages] == ["quality", "near_duplicates", "repeated_passages", "decontaminated", "packed"]
    for name, given, _, columns in stages[:-1]:
        assert columns == list(given[0])


def test_quality_keeps_rows_as_they_are(stages):
    _, given, kept, _ = stages[0]
    by = {r["doc_id"]: r for r in given}
    assert kept and all(by[r["doc_id"]] == r for r in kept) and len(kept) < len(given)


def test_near_duplicates_stage(stages):
    _, given, kept, _ = stages[1]
    want = brute.near_duplicates([(r["doc_id"], r["text"]) for r in given])
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, (_, c) in want.items() if i == c)


def test_repeated_passages_stage(stages):
    _, given, kept, _ = stages[2]
    words, left = brute.kept_words([(r["doc_id"], r["text"]) for r in given])
    want = {r["doc_id"]: (r["text"] if len(w) == len(k) else " ".join(k)) for r, w, k in zip(given, words, left)}
    assert {r["doc_id"]: r["text"] for r in kept} == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept)


def test_decontaminated_stage(stages):
    _, given, kept, _ = stages[3]
    items = duckdb.connect().execute(f"SELECT item_id, text FROM read_parquet('{SF}/benchmark.parquet')").fetchall()
    hits = brute.contaminated([(r["doc_id"], r["text"]) for r in given], items)
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r, h in zip(given, hits) if h[1] == 0)


def test_packed_stage(stages, spark):
    _, given, pieces, _ = stages[4]
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in given}
    run = cp.run(spark, SF)
    assert run.count() == len(pieces)
    assert run.agg(F.sum("length")).first()[0] == sum(r["length"] for r in pieces)
