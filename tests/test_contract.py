"""The driver's contract, and queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from corvane import queries as library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query(spark, duck, name):
    df = library.QUERIES[name](spark, SF)
    want = duck.sql(library.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
