"""Queries against their SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillguard.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df, sql = QUERIES[name](spark, SF), con.sql(SQL[name])
    order = sorted(df.columns)
    assert order == sorted(sql.columns)
    want = [dict(zip(sql.columns, r, strict=True)) for r in sql.fetchall()]
    assert sorted((tuple(r[c] for c in order) for r in want), key=repr) == sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11)) and set(SQL) <= set(QUERIES)
