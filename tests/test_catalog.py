"""Driver contract: entry() runs; every registered query matches its DuckDB twin at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tessera.plans.catalog import QUERIES
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"ter_corpus", "meteor_corpus"}


def core(names):
    """The queries of the core; those of the training-data operators have tests of their own."""
    return {n for n in names if n in QUERIES}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["conv_id", "turn", "translation"] and df.count() > 0


def test_registry_shape():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert core(q) - set(s) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(core(E.queries())))
def test_query_against_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in ROWS_ONLY:
        assert len(rows) > 0
        return
    res = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, rows) == rows_of(cols, res.fetchall())
