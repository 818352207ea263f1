"""Each query of the engine against its SQL on the driver's tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidelog.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("events", "orders", "customer"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def test_each_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, tables, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = tables.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[k] for c, k in got.dtypes} == kinds
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    assert rows == sorted(tables.execute(f"select {', '.join(columns)} from ({catalogue.ORACLES[name]})").fetchall(), key=str)


def test_lookup_reads_only_what_it_needs(spark):
    plan = catalogue.QUERIES["live_view"](spark, DATA)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,props:string>" in plan


def test_block_index_packs_greedily(spark):
    rows = sorted(map(tuple, catalogue.block_index(spark, DATA).collect()))
    by_file: dict[int, list] = {}
    for r in rows:
        by_file.setdefault(r[0], []).append(r)
    for own in by_file.values():
        assert [r[1] for r in own] == list(range(len(own)))
        assert [r[2] for r in own] == sorted(r[2] for r in own)
        assert all(r[4] <= 4096 or r[3] == 1 for r in own)
