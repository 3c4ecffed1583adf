"""Corpus queries with SQL give the rows and columns that DuckDB gives for it."""

import duckdb
import pytest

from skein.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    kinds = {c: str(t).lower() for c, t in zip(expected.columns, expected.types)}
    assert {c: {"string": "varchar"}.get(t, t) for c, t in got.dtypes} == kinds
    order = sorted(got.columns)
    place = [expected.columns.index(c) for c in order]
    assert sorted(str(tuple(r[c] for c in order)) for r in got.collect()) == sorted(str(tuple(r[i] for i in place)) for r in expected.fetchall())
