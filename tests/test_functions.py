from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from kinetrack.functions import geom as g
from kinetrack.functions import optics as o
from kinetrack.functions import stats
from kinetrack.functions import variants as v


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def xyz(s):
    return [s["x"], s["y"], s["z"]]


def test_quarter_turn(spark):
    q = g.from_axis_angle(g.vec3(0, 1, 0), F.lit(math.pi / 2))
    r = one(spark, a=g.rotate(q, g.vec3(0, 0, -1)), b=g.rotate(q, g.vec3(1, 0, 0)), n=g.normalize(g.vec3(0, 0, 0)), z=g.qnormalize(g.quat(0, 0, 0, 0)))
    assert xyz(r["a"]) == pytest.approx([-1, 0, 0], abs=1e-12)
    assert xyz(r["b"]) == pytest.approx([0, 0, -1], abs=1e-12)
    assert xyz(r["n"]) == [0, 0, -1] and r["z"]["w"] == 1


def test_log_exp_slerp_twist(spark):
    q = g.from_yaw_pitch_roll(F.lit(0.7), F.lit(-0.4), F.lit(0.2))
    p = g.from_yaw_pitch_roll(F.lit(-2.1), F.lit(0.3), F.lit(1.0))
    r = one(spark, q=q, back=g.qexp(g.qlog(q)), start=g.slerp(q, p, F.lit(0.0)), end=g.slerp(q, p, F.lit(1.0)), p=p, mid=g.slerp(q, q, F.lit(0.5)), tw=g.twist_about(q, g.vec3(0, 0, 1)))
    same = lambda a, b: abs(sum(a[c] * b[c] for c in "xyzw")) == pytest.approx(1, abs=1e-9)
    assert same(r["q"], r["back"]) and same(r["q"], r["start"]) and same(r["p"], r["end"]) and same(r["q"], r["mid"])
    assert r["tw"]["x"] == 0 and r["tw"]["y"] == 0 and r["tw"]["w"] >= 0


def test_matrix_matches_rotate(spark):
    q = g.from_yaw_pitch_roll(F.lit(0.3), F.lit(0.2), F.lit(-0.5))
    r = one(spark, m=g.matrix_column_major(q), x=g.rotate(q, g.vec3(1, 0, 0)), z=g.rotate(q, g.vec3(0, 0, 1)))
    assert r["m"][:3] == pytest.approx(xyz(r["x"])) and r["m"][6:] == pytest.approx(xyz(r["z"]))


def test_pose_compose_inverse_and_head(spark):
    p = g.pose(g.vec3(1, 2, 3), g.from_yaw_pitch_roll(F.lit(0.5), F.lit(0.1), F.lit(0.0)))
    eyes = F.array(*[F.struct(g.pose(g.vec3(x, 0, 0), g.quat(0, 0, 0, 1)).alias("pose")) for x in (-1.0, 3.0)])
    none = F.lit(None).cast("struct<pos:struct<x:double,y:double,z:double>,rot:struct<x:double,y:double,z:double,w:double>>")
    r = one(spark, i=g.compose(p, g.pose_inverse(p)), head=g.head_pose(none, eyes))
    assert xyz(r["i"]["pos"]) == pytest.approx([0, 0, 0], abs=1e-12)
    assert xyz(r["head"]["pos"]) == [1, 0, 0]


def test_raw_extrinsics_round_trip_and_mirror(spark):
    q = g.from_yaw_pitch_roll(F.lit(0.1), F.lit(-0.19), F.lit(0.02))
    r = one(spark, same=g.angle_between_degrees(g.head_to_camera_from_raw(g.raw_from_head_to_camera(q)), q), twice=g.angle_between_degrees(g.repair_mirrored(g.repair_mirrored(q)), q), up=g.optical_axis_pitch_degrees(g.repair_mirrored(q)), down=g.optical_axis_pitch_degrees(q))
    assert r["same"] == pytest.approx(0, abs=1e-5) and r["twice"] == pytest.approx(0, abs=1e-5)
    assert r["up"] == pytest.approx(-r["down"], abs=0.3)


def test_fov_edges_and_round_trip(spark):
    f = o.fov(F.lit(-0.95), F.lit(0.86), F.lit(0.75), F.lit(-0.78))
    at = lambda x, y: o.fov_project(f, g.vec3(math.tan(x), math.tan(y), -1), F.lit(640), F.lit(480))
    r = one(spark, a=at(-0.95, 0.75), b=at(0.86, -0.78), behind=o.fov_project(f, g.vec3(0, 0, 1), F.lit(640), F.lit(480)), p=o.fov_project(f, o.fov_ray(f, F.lit(12.0), F.lit(300.0), F.lit(640), F.lit(480)), F.lit(640), F.lit(480)))
    assert [r["a"]["px"], r["a"]["py"]] == pytest.approx([-0.5, -0.5]) and [r["b"]["px"], r["b"]["py"]] == pytest.approx([639.5, 479.5])
    assert r["behind"] is None and [r["p"]["px"], r["p"]["py"]] == pytest.approx([12, 300], abs=1e-9)


def test_fit_crop_symmetrize(spark):
    f = o.fov(F.lit(-0.95), F.lit(0.86), F.lit(0.75), F.lit(-0.78))
    w, h = F.lit(1920), F.lit(1080)
    fit, crop, skew = o.fit_to_pane(f, w, h), o.crop_to_pane(o.symmetrize(f), w, h), o.crop_to_pane_asymmetric(f, w, h)
    r = one(spark, fa=o.angular_aspect(fit), ca=o.angular_aspect(crop), sa=o.angular_aspect(skew), f=fit, c=crop, bad=o.sane(o.fov(F.lit(0.5), F.lit(0.2), F.lit(0.1), F.lit(-0.1))), ok=o.sane(f))
    assert [r["fa"], r["ca"], r["sa"]] == pytest.approx([1920 / 1080] * 3)
    assert r["f"]["l"] <= -0.95 and r["f"]["u"] >= 0.75 - 1e-12
    assert r["c"]["l"] == -r["c"]["r"] and r["c"]["r"] <= 0.86 + 1e-12
    assert r["ok"] and not r["bad"]


def test_brown_conrady_and_inverse(spark):
    k = F.array(*[F.lit(x) for x in (-0.1, 0.02, 0.003, 0.004, 0.001)])
    lens = F.struct(F.lit(100.0).alias("fx"), F.lit(100.0).alias("fy"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), k.alias("distortion"))
    x, y, r2 = 0.3, -0.4, 0.25
    radial = 1 - 0.1 * r2 + 0.02 * r2**2 + 0.001 * r2**3
    r = one(spark, p=o.project_pinhole(lens, g.vec3(0.3, 0.4, -1)), back=o.project_pinhole(lens, o.unproject_pinhole(lens, F.lit(21.0), F.lit(-13.0))), none=o.project_pinhole(lens, g.vec3(0, 0, 1)))
    assert r["p"]["px"] == pytest.approx(100 * (x * radial + 2 * 0.003 * x * y + 0.004 * (r2 + 2 * x * x)), abs=1e-10)
    assert r["p"]["py"] == pytest.approx(100 * (y * radial + 0.003 * (r2 + 2 * y * y) + 2 * 0.004 * x * y), abs=1e-10)
    assert [r["back"]["px"], r["back"]["py"]] == pytest.approx([21, -13], abs=1e-3) and r["none"] is None


def test_rebase_golden(spark):
    lens = F.struct(F.lit(867.154175).alias("fx"), F.lit(867.154175).alias("fy"), F.lit(641.459106).alias("cx"), F.lit(638.635071).alias("cy"), F.array(F.lit(0.0)).alias("distortion"), F.array(*[F.lit(float(x)) for x in (0, 0, 1280, 1280)]).alias("active_array"))
    r = one(spark, a=o.rebase_to_image(lens, F.lit(1280), F.lit(960)), b=o.rebase_to_image(lens, F.lit(1280), F.lit(1280)))
    assert [r["a"]["cx"], r["a"]["cy"], r["a"]["fx"]] == pytest.approx([641.459106, 478.635071, 867.154175], abs=1e-9)
    assert r["b"]["cy"] == 638.635071


def test_colour(spark):
    rows = spark.range(256).select(F.col("id"), F.round(o.linear_to_srgb(o.srgb_to_linear(F.col("id") / 255)) * 255).alias("back")).collect()
    assert all(r["id"] == r["back"] for r in rows)
    r = one(spark, half=o.srgb_to_linear(F.lit(0.5)), low=o.srgb_to_linear(F.lit(-1.0)), high=o.linear_to_srgb(F.lit(2.0)), cut=o.gaussian_cutoff_hz(F.lit(200_000_000)), none=o.gaussian_cutoff_hz(F.lit(0)))
    assert r["half"] == pytest.approx(0.21404, abs=1e-5) and r["low"] == 0 and r["high"] == 1
    assert r["cut"] == pytest.approx(0.9374, abs=1e-3) and r["none"] == 0


def test_upper_medians_of_any_size(spark):
    groups = {"even": [1.0, 2.0, 3.0, 4.0], "one": [7.5], "ties": [5.0] * 50 + [1.0], "spread": [float((i * 7919) % 5003) for i in range(3000)], "scales": [10.0 ** (i % 300 - 150) for i in range(900)], None: [-1.0, 0.0, 2.0], "none": [None]}
    rows = [(k, x, None if x is None else -x) for k, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    want = {k: (sorted(xs)[len(xs) // 2], -sorted(xs, reverse=True)[len(xs) // 2]) for k, xs in groups.items() if xs != [None]} | {"none": (None, None)}
    for small, bins in ((100_000, 1024), (40, 64)):
        got = {r["k"]: (r["v"], r["w"]) for r in stats.upper_medians(df, ["v", "w"], ["k"], small, bins).collect()}
        assert got == want


def test_typed_json(spark):
    texts = ['{"k": 5}', '{"k": 5.0}', '{"k": 2.5}', '{"k": true}', '{"k": "x"}', '{"k": null}', "{}", '{"k": [1, 2.5]}', "not json", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("d", F.try_parse_json("t"))
    got = rows.select("i", v.kind(F.col("d"), "$.k").alias("kind"), v.integer(F.col("d"), "$.k").alias("n"), v.number(F.col("d"), "$.k").alias("x"), v.doubles(F.col("d"), "$.k").alias("a")).orderBy("i").collect()
    assert [r["kind"] for r in got] == ["integer", "number", "number", "boolean", "string", "null", "missing", "array", "missing", "missing"]
    assert [r["n"] for r in got][:5] == [5, None, None, None, None] and [r["x"] for r in got][:4] == [5.0, 5.0, 2.5, None]
    assert got[7]["a"] == [1.0, 2.5]


def test_names(spark):
    rows = spark.createDataFrame([("XR_EYE_VISIBILITY_Left",), ("BOTH",), ("stereo",)], "t string").select(v.eye_visibility(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["left", "both", None]
    rows = spark.createDataFrame([("camR",), ("0",), ("EYE1",), ("x",)], "t string").select(v.camera_key(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["R", "L", "R", None]
