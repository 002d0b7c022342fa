"""Every query that has SQL is compared with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from riskcohort.plans import catalog
from riskcohort.plans.fixtures import TABLES

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, small_dir, con, name):
    df = catalog.queries()[name](spark, small_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def test_every_query_has_a_name_and_sql_is_not_orphaned():
    assert set(SQL) <= set(catalog.queries())
