"""Every query with SQL gives the rows and columns that DuckDB gives for it."""

import duckdb
import pytest

from skein.operators import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    got, expected = catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.collect(), got.columns) == rows(expected.fetchall(), expected.columns)
