import glob
import os

import duckdb
import pytest

from loamgraph.llm import queries as Q


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", ["p1_planted", "p3_planted", "p6_planted", "p4_inherited", "p8_check", "p9_check", "p1_json", "p2_neighbours"])
def test_like_sql(spark, small, db, name):
    got = Q.QUERIES[name](spark, small)
    cols = sorted(got.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.select(cols).collect())) == sorted(map(key, db.sql(f"select {', '.join(cols)} from ({Q.SQL[name]})").fetchall()))
