"""The training-data queries that SQL can express against their SQL on the smallest tables."""
import os

import duckdb
import pytest

from dwell.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data absent")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-len('.parquet')]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(queries.oracle_sql()[name])
    order = [[d[0] for d in res.description].index(c) for c in cols]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in res.fetchall()), key=key)
