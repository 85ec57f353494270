"""Every query runs at the smallest scale; those with SQL give the same rows in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from pagemill.plans import book_queries, copies_and_nesting, evaluation_queries, page_queries

PARTS = [book_queries, evaluation_queries, page_queries, copies_and_nesting]
QUERIES = {k: q for p in PARTS for k, q in p.QUERIES.items()}
SQL = {k: q for p in PARTS for k, q in p.SQL.items()}


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def text(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "∅"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, duck, name):
    got = QUERIES[name](spark, tiny).toPandas()
    if name in SQL:
        wanted = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(wanted.columns)
        assert rows(got) == rows(wanted)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
