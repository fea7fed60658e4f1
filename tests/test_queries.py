"""Every registered query runs, and agrees with its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from cirrostrat import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canon(rows):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{float(x):.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", [n for n in plans.queries() if n in plans.oracles()])
def test_query_agrees_with_sql(spark, sf, duck, name):
    df = plans.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.execute(plans.oracles()[name])
    names = [d[0] for d in want.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert canon(df.select(*columns).collect()) == canon([tuple(r[i] for i in order) for r in want.fetchall()])


@pytest.mark.parametrize("name", [n for n in plans.queries() if n not in plans.oracles()])
def test_query_without_sql_gives_rows(spark, sf, name):
    assert plans.queries()[name](spark, sf).count() > 0
