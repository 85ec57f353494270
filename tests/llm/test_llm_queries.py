import glob
import os

import duckdb
import pytest

from pagemill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tiny, name):
    got = queries.QUERIES[name](spark, tiny)
    rows = {tuple(str(v) for v in r) for r in got.select(sorted(got.columns)).collect()}
    if name.endswith("_found"):
        assert all("None" not in r for r in rows)
    if name in queries.SQL:
        con = duckdb.connect()
        for f in glob.glob(f"{tiny}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
        wanted = con.execute(queries.SQL[name]).df()
        assert rows == {tuple(str(v) for v in r) for r in wanted[sorted(wanted.columns)].itertuples(index=False)}
