"""Queries of the corpus operators that SQL expresses, against it on the smallest tables."""

import glob
import os

import duckdb
import pytest

from evidra.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(cols).collect()), key=repr)
    assert got == sorted(duck.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall(), key=repr)
