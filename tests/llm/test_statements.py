"""Registered queries against their DuckDB statements on the smallest tables."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))
from check_oracle import digest  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from vigil.llm.oracles import SQL  # noqa: E402
from vigil.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_statement(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    made = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in made.collect()]
    cur = con.execute(SQL[name])
    columns, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(made.columns) == sorted(columns) and len(rows) == len(want) > 0
    assert digest(made.columns, rows)[0] == digest(columns, want)[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs_whole(spark, name):
    table = "pages" if "html" in name else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    rows = QUERIES[name](spark, SF)
    whole = spark.read.parquet(f"{SF}/{table}.parquet")
    assert rows.select(key).distinct().count() == whole.select(key).distinct().count()
