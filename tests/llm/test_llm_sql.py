"""Queries of this subpackage that have SQL, on sf0.01."""

import duckdb
import pytest

from vecscope.llm.queries import oracle_sql, queries

TABLES = ("documents", "pages", "benchmark", "labels")


def compare(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries()[name](spark, sf), con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    cut = lambda r, cols: tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in sorted(range(len(cols)), key=lambda i: cols[i]))
    assert sorted((cut(r, got.columns) for r in got.collect()), key=repr) == sorted((cut(r, columns) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - {"op1_quality_rules"}))
def test_equals_sql(spark, sf, name):
    compare(spark, sf, name)


def test_one_query_for_each_operator():
    names = list(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
