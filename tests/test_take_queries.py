from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_queries import DATA, duck, rows  # noqa: F401

from kinetrack.operators import temporal
from kinetrack.plans.take_queries import NAMES, oracle_sql, queries


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    got = queries()[name](spark, DATA).toArrow()
    want = duck.sql(oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_segment_of_a_frame_is_the_range_it_lies_in(spark):
    cases = [(n, k, i) for n in (1, 7, 45) for k in (1, 2, 3, 4, 8, 12) for i in range(n)]
    df = spark.createDataFrame(cases, "n long, k long, i long").withColumn("s", temporal.segment_of(F.col("i"), F.col("n"), F.col("k")))
    df = df.withColumn("r", temporal.segment_range(F.col("n"), F.col("s"), F.col("k")))
    assert df.where("NOT (r.begin <= i AND i < r.end)").count() == 0


def test_host_time_of_device_time(spark):
    clock = spark.createDataFrame([("a", 0, 100_000_000), ("a", 1_000_000_000, 101_000_000), ("a", 2_000_000_000, 99_000_000), ("b", 5, 7)], "k string, t_host_ns long, offset_ns long")
    host = spark.createDataFrame([(x, -500_000_000 + 37_000_011 * i) for i in range(80) for x in "abc"], "k string, h long")
    device = temporal.offset_at_host(host, clock, "h", ["k"], "o").withColumn("d", F.col("h") + F.col("o"))
    back = temporal.to_host(device, clock, "d", ["k"], "back")
    assert back.where("abs(back - h) > 1").count() == 0 and back.where("k <> 'a' AND back <> h").count() == 0


def test_changes_across_blocks(spark):
    values = [0, 0, 1, 1, 1, 2, 2, 2, 2, 0, None, None]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    assert sorted(r["i"] for r in temporal.changes(df, "v", "i", block=4).collect()) == [0, 2, 5, 9, 10]
