"""Every query with SQL against the oracle, by rows and values."""

import duckdb
import pytest

import __spark_entry__ as entry
from lumenweave import catalog
from lumenweave.plans.dialect import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(rows):
    return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = oracle.sql(catalog.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = norm(tuple(r[c] for c in cols) for r in df.collect())
    want = norm(rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    assert len(got) > 0 and got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
