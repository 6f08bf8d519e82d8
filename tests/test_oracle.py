"""Every core query that has SQL gives DuckDB's rows."""

import decimal
import math
import os

import duckdb
import pytest

from orgpanel.plans import queries, source_queries

QUERIES, SQL = queries.QUERIES | source_queries.QUERIES, queries.SQL | source_queries.SQL
#: names have letters beyond ASCII in the larger one
NAMED = {"weak_names", "org_types", "name_shingles", "lsh_pairs", "close_pairs", "name_components"}
SIZES = os.environ.get("ORGPANEL_TEST_SF", "/root/testdata/sf0.001 /root/testdata/sf0.01").split()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return int(value) if isinstance(value, decimal.Decimal) else value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in data))


@pytest.fixture(scope="module")
def duck():
    found = {}
    for size in SIZES:
        found[size] = duckdb.connect()
        for t in TABLES:
            found[size].execute(f"create view {t} as select * from '{size}/{t}.parquet'")
    return found


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name, size):
    if size != SIZES[0] and name not in NAMED:
        pytest.skip("the small tables will do")
    df = QUERIES[name](spark, size)
    found = duck[size].execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
