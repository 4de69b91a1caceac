"""Registered queries against their SQL, on the tables of sf0.01."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from vecscope.plans.oracles import ORACLES
from vecscope.plans.queries import QUERIES

TABLES = ("embeddings",)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(key(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_golden_sums(spark, sf):
    h = QUERIES["hardness"](spark, sf).toPandas()
    assert (len(h), h.delta0.sum(), h.delta0.min(), h.delta0.max()) == (50, 1411, 10, 75)
    assert (h.me.sum(), h.me.min(), h.me.max()) == (9440, 110, 281)
