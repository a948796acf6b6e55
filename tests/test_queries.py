"""Each query against its SQL in DuckDB, over the same tables, by names and values of all rows."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, datetime.date):
        return str(x)[:10]
    return str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    wanted = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(got.columns) == sorted(columns)
    values = wanted.fetchall()
    assert rows(got.columns, got.collect()) == rows(columns, values)
    assert values


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.queries() if n not in __spark_entry__.oracle_sql() and n != "pipeline" and not n.startswith("op")))
def test_query_without_sql_runs(spark, name):
    __spark_entry__.queries()[name](spark, SF).collect()
