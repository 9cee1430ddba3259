"""Every registered query against its DuckDB statement on sf0.001 (the
driver runs the same comparison on sf0.01)."""

import os
import sys

import duckdb
import pytest

from paths import SF_SMALL
from vigil.plans import catalog
from vigil.plans.oracle_sql import SQL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracle import digest  # noqa: E402

NAMES = sorted(set(SQL) & set(catalog.QUERIES))


@pytest.fixture(scope="module")
def duck():
    from vigil.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = catalog.QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_only_the_recall_has_no_statement():
    assert set(catalog.QUERIES) - set(SQL) == {"d12_ivf_recall"}


def test_recall_at_the_guidance(spark):
    row = catalog.QUERIES["d12_ivf_recall"](spark, SF_SMALL).first()
    assert row["queries"] > 0 and row["recall_at_5"] >= 0.9
