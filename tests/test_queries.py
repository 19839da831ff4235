from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from kinetrack.plans.queries import NAMES, oracle_sql, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(table) -> list[tuple]:
    df = table.to_pandas(integer_object_nulls=True)
    df = df[sorted(df.columns)]
    cell = lambda x: "" if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = queries()[name](spark, DATA).toArrow()
    want = duck.sql(oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
