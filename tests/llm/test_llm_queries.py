import glob
import os

import duckdb
import pytest

from meridian.llm import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, name):
    got = queries.QUERIES[name](spark, data)
    rows = got.collect()
    assert rows
    if name in queries.SQL:
        c = duckdb.connect()
        for f in glob.glob(f"{data}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
        want = c.execute(queries.SQL[name]).df()
        assert sorted(tuple(r[x] for x in sorted(got.columns)) for r in rows) == sorted(want[sorted(want.columns)].itertuples(index=False, name=None))
