"""Every query with an SQL statement gives what DuckDB gives, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from tessera.plans.oracles import ORACLES
from tessera.plans.queries import QUERIES

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{BASE}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda x: ("nan" if math.isnan(x) else f"{x:.6g}") if isinstance(x, float) else str(x)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(ORACLES) & set(QUERIES)))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, BASE)
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert normal(df.collect(), df.columns) == normal(rel.fetchall(), rel.columns)


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
