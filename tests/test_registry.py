"""Every registered query against its SQL on the smallest data set, and the shape of key plans."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
from check import TABLES, normal
from scriptorium.catalog import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.QUERIES, registry.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    order = sorted(frame.columns)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    theirs = sorted(tuple(normal(r[i]) for i in at) for r in result.fetchall())
    mine = sorted(tuple(normal(r[c]) for c in order) for r in frame.collect())
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 20
