from __future__ import annotations

import bisect

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetrack.operators import temporal

MS = 1_000_000
CLOCK = [(100 * MS, 200 * MS), (200 * MS, 210 * MS), (300 * MS, 190 * MS)]


def frame(spark, values, name="t"):
    return spark.createDataFrame(list(enumerate(values)), f"i long, {name} long")


def nearest(right, t):
    k = bisect.bisect_left(right, t)
    if k == 0 or k == len(right):
        return 0 if k == 0 else len(right) - 1
    return k if right[k] - t < t - right[k - 1] else k - 1


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(right=st.lists(st.integers(-40, 40), min_size=1, max_size=25).map(sorted), left=st.lists(st.integers(-60, 60), min_size=1, max_size=25), bucket=st.sampled_from([None, 7, 1000]))
def test_asof_matches_binary_search(spark, right, left, bucket):
    r, q = frame(spark, right), frame(spark, left)
    near = {x["i"]: x["m"] for x in temporal.asof_nearest(q, r, "t", order="i", bucket_ns=bucket).select("i", F.col("match.i").alias("m")).collect()}
    assert [near[i] for i in range(len(left))] == [nearest(right, t) for t in left]
    back = {x["i"]: x["m"] for x in temporal.asof_backward(q, r, "t", order="i", bucket_ns=bucket).select("i", F.col("match.i").alias("m")).collect()}
    assert [back[i] for i in range(len(left))] == [bisect.bisect_right(right, t) - 1 if t >= right[0] else None for t in left]


def test_nearest_goldens_and_empty(spark):
    r, q = frame(spark, [0, 10, 20, 30]), frame(spark, [-5, 4, 5, 6, 20, 999])
    assert [x["m"] for x in temporal.asof_nearest(q, r, "t", order="i").select("i", F.col("match.i").alias("m")).orderBy("i").collect()] == [0, 0, 0, 1, 2, 3]
    assert [x["m"] for x in temporal.asof_nearest(q, r.limit(0), "t", order="i").select("i", F.col("match.i").alias("m")).orderBy("i").collect()] == [None] * 6


def test_keys_keep_groups_apart(spark):
    r = spark.createDataFrame([("a", 0, 1), ("b", 0, 2)], "k string, t long, v int")
    q = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "k string, t long")
    got = {x["k"]: x["v"] for x in temporal.asof_nearest(q, r, "t", ["k"]).select("k", F.col("match.v").alias("v")).collect()}
    assert got == {"a": 1, "b": 2, "c": None}


def test_clock_offsets(spark):
    clock = spark.createDataFrame(CLOCK, "t_host_ns long, offset_ns long")
    times = frame(spark, [150 * MS, 225 * MS, 250 * MS, 50 * MS, 400 * MS])
    got = temporal.offset_at_host(times, clock, "t").orderBy("i").collect()
    assert [x["offset_ns"] for x in got] == [205 * MS, 205 * MS, 200 * MS, 200 * MS, 190 * MS]
    assert [x["offset_ns"] for x in temporal.offset_at_host(times, clock.limit(0), "t").collect()] == [0] * 5


def test_clock_inverse_is_exact(spark):
    clock = spark.createDataFrame([(0, 100 * MS), (1000 * MS, 101 * MS), (2000 * MS, 102 * MS)], "t_host_ns long, offset_ns long")
    times = frame(spark, list(range(-500 * MS, 2500 * MS, 37 * MS)))
    device = temporal.device_from_host(times, clock, "t")
    assert temporal.to_host(device, clock, "t_device_ns", out="back").where("back <> t").count() == 0


def test_places_and_rows_before_do_not_depend_on_blocks(spark):
    rows = spark.createDataFrame([(k, (i * 37) % 50 - 20, i % 7 if i % 5 else None) for k in ("a", None) for i in range(50)] + [("b", 3, 1)], "k string, t long, v int")
    want = rows.toPandas().sort_values("t")
    for block in (1, 7, 1000):
        got = temporal.running(rows, ["t"], ["k"], block, "n", {"p": "v", "pt": "t"}).toPandas()
        for key in ("a", "b", None):
            mine, own = (x[x.k.isna() if key is None else x.k == key].sort_values("t") for x in (got, want))
            assert mine.n.tolist() == list(range(len(own)))
            assert mine.pt.tolist()[1:] == own.t.tolist()[:-1] and mine.p.fillna(-1).tolist()[1:] == own.v.fillna(-1).tolist()[:-1] and mine.p.isna().tolist()[0]
    assert temporal.advances(rows.where("k = 'a'"), "t", "t", ["k"], 7).where("NOT advances").count() == 0
    late = temporal.ordinal(rows, "t", ["k"], "n", 7)
    assert temporal.without_two(late, "n", ["k"]).groupBy("k").count().orderBy("k").collect() == [(None, 48), ("a", 48), ("b", 1)]


def test_counting_unfolds_in_runs(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 0), ("c", 2 * temporal.RUN + 1), ("d", None)], "g string, n long")
    got = temporal.counted(rows, "n")
    assert {r["g"]: (r["c"], r["a"], r["b"]) for r in got.groupBy("g").agg(F.countDistinct("k").alias("c"), F.min("k").alias("a"), F.max("k").alias("b")).collect()} == {"a": (3, 0, 2), "c": (2 * temporal.RUN + 1, 0, 2 * temporal.RUN)}


@pytest.mark.parametrize("n", [1, 7, 45, 4137])
def test_segments_tile(spark, n):
    for k in (1, 2, 3, 4, 8, 12):
        rows = spark.range(k).select(temporal.segment_range(F.lit(n).cast("long"), F.col("id"), F.lit(k).cast("long")).alias("s")).select("s.*").collect()
        assert rows[0]["begin"] == 0 and rows[-1]["end"] == n
        assert all(a["end"] == b["begin"] for a, b in zip(rows, rows[1:], strict=False))
        widths = [r["end"] - r["begin"] for r in rows]
        assert max(widths) - min(widths) <= 1 and widths == sorted(widths, reverse=True)


def test_rounding_and_grid(spark):
    assert [r[0] for r in spark.createDataFrame([(2.5,), (-2.5,), (0.4,)], "x double").select(temporal.llround(F.col("x"))).collect()] == [3, -3, 0]
    spans = spark.createDataFrame([("a", 0, 1_000_000_000), ("b", 5, 5)], "g string, first_ns long, last_ns long")
    rows = temporal.grid(spans, 45.0, ["g"]).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in rows} == {"a": 46, "b": 1}
