"""Queries of the subpackage against their SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tessera.llm.oracles import ORACLES
from tessera.llm.queries import QUERIES

BASE = "/root/testdata/sf0.001"
COLUMNS = {"p1_found": "plan_id category_id", "p2_found": "rec_table rec_key", "p3_found": "id kind", "p4_found": "rec_table rec_key markup", "p5_found": "gen_id defect", "p6_found": "id line_no", "p7_found": "window_id doc_id", "p8_found": "doc_id item_id", "p9_found": "doc_id"}

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{BASE}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, rel = QUERIES[name](spark, BASE), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_rows_are_distinct(spark, name):
    rows = QUERIES[name](spark, BASE)
    assert rows.columns == COLUMNS[name].split()
    got = [tuple(r) for r in rows.collect()]
    assert got and len(got) == len(set(got))
