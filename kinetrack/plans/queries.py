"""One query for each operator family, over the generic tables.

The tables hold no recordings, so tracks are derived from ``events``: time from ``ts``, position and
angles from ``value`` and ``event_id``; ``error`` events are dropped records, ``view`` events a camera.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrack.functions import geom as g
from kinetrack.functions import optics as o
from kinetrack.functions import stats
from kinetrack.functions import variants as v
from kinetrack.operators import audio, diagnostics, raster, smooth, temporal
from kinetrack.plans import frusta
from kinetrack.plans.render_plan import median_interval
from kinetrack.sources.lines import numbered_lines
from kinetrack.sources.tables import shared_folder, spread

DAY = 86_400 * temporal.NS
T0 = 1_704_067_200 * temporal.NS
GRID_HZ = 0.0078125


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without zone; the session's zone plays no part."""
    return F.expr(
        f"unix_date(to_date({ts})) * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + cast(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)"
    )


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return events.select("event_id", "user_id", "event_type", "value", (micros("ts") * 1000).alias("t_ns"))


def instants(rows: DataFrame) -> DataFrame:
    spans = rows.agg(F.min("t_ns").alias("first_ns"), F.max("t_ns").alias("last_ns"))
    return temporal.grid(spans, GRID_HZ)


def r6(x: Column, name: str) -> Column:
    """Rounded to 6 decimals, without a negative zero."""
    return (F.round(x, 6) + F.lit(0.0)).alias(name)


def asof_nearest_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir)
    near = temporal.asof_nearest(instants(rows), rows.select("t_ns", "event_id"), "t_ns", order="event_id", bucket_ns=DAY)
    return near.select("k", "t_ns", F.col("match.event_id").alias("event_id"), (F.col("match.t_ns") - F.col("t_ns")).alias("gap_ns"))


def _type(rows: DataFrame, kind: str, *columns: str) -> DataFrame:
    return rows.where(F.col("event_type") == kind).select("user_id", "t_ns", "event_id", *columns)


def asof_nearest_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir)
    near = temporal.asof_nearest(_type(rows, "purchase"), _type(rows, "view"), "t_ns", ["user_id"], order="event_id", bucket_ns=DAY)
    return near.select("event_id", "user_id", F.col("match.event_id").alias("view_id"), (F.col("match.t_ns") - F.col("t_ns")).alias("gap_ns"))


def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir)
    near = temporal.asof_backward(_type(rows, "purchase"), _type(rows, "click"), "t_ns", ["user_id"], order="event_id", bucket_ns=DAY)
    return near.select("event_id", "user_id", F.col("match.event_id").alias("click_id"))


def ordinal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir)
    kept = temporal.ordinal(rows.where("event_type <> 'error'").select("user_id", "event_id"), "event_id", ["user_id"], block=temporal.RUN)
    frames = temporal.ordinal(_type(rows, "view").select("user_id", F.col("event_id").alias("frame_id")), "frame_id", ["user_id"], block=temporal.RUN)
    return frames.join(kept, ["user_id", "n"]).select("user_id", "n", "frame_id", "event_id")


def overlay_source_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid instant -> frame (among kept records) -> record number (among all)."""
    rows = track(spark, sf_dir)
    # the record number of the whole track is event_id, which is its order
    kept = temporal.ordinal(rows.where("event_type <> 'error'").select("t_ns", "event_id", "user_id"), "event_id", ["user_id"], "frame", temporal.RUN)
    near = temporal.asof_nearest(instants(rows), kept, "t_ns", order="event_id", bucket_ns=DAY)
    return near.select("k", F.col("match.frame").alias("frame"), F.col("match.event_id").alias("record"))


def clock_samples(spark: SparkSession) -> DataFrame:
    d = F.col("id")
    return spark.range(1, 25).select((T0 + d * DAY).alias("t_host_ns"), (200_000_000 + d * d * 1000 + (d % 3) * 17).alias("offset_ns"))


def interp_linear_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).select("event_id", "t_ns")
    found = temporal.offset_at_host(rows, clock_samples(spark), "t_ns", bucket_ns=DAY)
    return found.select("event_id", "offset_ns", (F.col("t_ns") + F.col("offset_ns")).alias("t_device_ns"))


def host_from_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device stamps back to host time."""
    rows = track(spark, sf_dir).select("event_id", "t_ns")
    device = temporal.offset_at_host(rows, clock_samples(spark), "t_ns", bucket_ns=DAY).withColumn("device_ns", F.col("t_ns") + F.col("offset_ns"))
    found = temporal.to_host(device, clock_samples(spark), "device_ns", out="host_ns", bucket_ns=DAY)
    return found.select("event_id", "device_ns", (F.abs(F.col("host_ns") - F.col("t_ns")) <= 1).alias("inverted"))


def _yaw_pose(value: Column) -> Column:
    yaw = value / 100
    return g.pose(g.vec3(value, value / 2, -value), g.quat(0, F.sin(yaw / 2), 0, F.cos(yaw / 2)))


def interp_pose_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir)
    poses = _type(rows, "view", "value").withColumn("pose", _yaw_pose(F.col("value"))).drop("value")
    found = temporal.bracketed(_type(rows, "purchase"), poses, "t_ns", ["user_id"], order="event_id", bucket_ns=DAY).where("below IS NOT NULL")
    found = found.withColumn("pose", g.interpolate(F.col("below.pose"), F.col("above.pose"), F.col("u")))
    return found.select("event_id", r6(F.col("pose.pos.x"), "x"), r6(F.col("pose.pos.z"), "z"), r6(F.col("pose.rot.y"), "qy"), r6(F.col("pose.rot.w"), "qw"))


SIGMA = 600 * temporal.NS


def gaussian_smooth_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = smooth.gaussian_smooth(track(spark, sf_dir).select("event_id", "t_ns", "value"), "t_ns", "value", SIGMA, bucket_ns=DAY // 4)
    return found.select("event_id", r6(F.col("smoothed"), "smoothed"))


def gaussian_smooth_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).select("event_id", "t_ns", _yaw_pose(F.col("value")).alias("pose"))
    found = smooth.gaussian_smooth_pose(rows, "t_ns", "pose", SIGMA, bucket_ns=DAY // 4)
    return found.select("event_id", r6(F.col("smoothed.pos.x"), "x"), r6(F.col("smoothed.rot.y"), "qy"), r6(F.col("smoothed.rot.w"), "qw"))


def upper_median_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).select(F.col("user_id").alias("take_id"), F.col("t_ns").alias("t_host_ns"), F.col("event_id").alias("record"))
    return median_interval(rows).select(F.col("take_id").alias("user_id"), "interval_ns")


def _fov_edges() -> dict[str, Column]:
    e = F.col("event_id")
    return {
        "l": -(0.60 + 0.02 * (e % 17).cast("double")), "r": 0.55 + 0.02 * (e % 13).cast("double"),
        "u": 0.50 + 0.02 * (e % 11).cast("double"), "d": -(0.52 + 0.02 * (e % 7).cast("double")),
    }


def fov_edge_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).select("user_id", *[c.alias(k) for k, c in _fov_edges().items()])
    medians = stats.upper_medians(rows, list("lrud"), ["user_id"])
    cropped = medians.withColumn("s", o.symmetrize(o.fov(*[F.col(k) for k in "lrud"]))).withColumn("f", o.crop_to_pane(F.col("s"), F.lit(640), F.lit(480)))
    return cropped.select("user_id", *[r6(F.col(f"f.{k}"), k) for k in "lrud"])


def frustum_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).select("user_id", F.lit(0).alias("eye"), o.fov(*_fov_edges().values()).alias("fov"))
    union = frusta.recorded_fov(rows, ["user_id"]).select("user_id", F.col("fov").alias("f"))
    pixel = union.agg(F.max(o.angular_pixel(F.col("f"), F.lit(640), F.lit(480))).alias("pixel"))
    fitted = union.crossJoin(F.broadcast(pixel)).withColumn("g", o.fit_to_pane(F.col("f"), F.lit(640), F.lit(480), F.col("pixel")))
    return fitted.select("user_id", *[r6(F.col(f"g.{k}"), k) for k in "lrud"])


def monotonicity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.advances(track(spark, sf_dir), "value", "event_id", ["user_id"], temporal.RUN, "ok")
    return rows.where("NOT ok").select("user_id", "event_id")


def diagnostic_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).withColumn("take_id", F.col("user_id").cast("string")).where("value > 100")
    found = diagnostics.diagnostic(rows, F.lit(True), "error", F.format_string("events:%d", "event_id"), F.format_string("value over 100 in %s", "event_type"), "a large value", F.col("event_id"))
    shown = diagnostics.capped(found, ["take_id"], "line")
    return shown.groupBy("take_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last_line"), F.max("message").alias("message"))


def json_typed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of JSON text, with variants that break each rule."""
    e = F.col("event_id") % 6
    broken = F.when(e == 1, F.concat(F.lit('{"k": '), F.col("k"), F.lit(".5}"))).when(e == 2, F.concat(F.lit('{"k": "'), F.col("k"), F.lit('"}')))
    broken = broken.when(e == 3, F.lit('{"k": true}')).when(e == 4, F.lit('{"other": 1}')).otherwise(F.col("props"))
    rows = load(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1)).select("event_id", broken.alias("text"))
    doc = rows.withColumn("doc", F.try_parse_json("text"))
    return doc.select(
        "event_id", v.kind(F.col("doc"), "$.k").alias("kind"), v.integer(F.col("doc"), "$.k").alias("as_int"), v.number(F.col("doc"), "$.k").alias("as_number"),
        v.string(F.col("doc"), "$.k").alias("as_string"), v.boolean(F.col("doc"), "$.k").alias("as_boolean"),
    )


def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir)
    span = lambda kind, p: _type(rows, kind).groupBy("user_id").agg(F.min("t_ns").alias(f"{p}_first"), F.max("t_ns").alias(f"{p}_last"))
    both = span("view", "a").join(span("error", "b"), "user_id")
    return both.select("user_id", temporal.overlaps(*[F.col(k) for k in ("a_first", "a_last", "b_first", "b_last")]).alias("overlaps"))


def fk_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return load(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def _angles(rows: DataFrame) -> DataFrame:
    e, x = F.col("event_id"), F.col("value")
    return rows.select("event_id", (x / 100).alias("yaw"), ((e % 31).cast("double") / 20).alias("pitch"), ((e % 19).cast("double") / 15).alias("roll"), (x / 7).alias("x"))


def quat_compose_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _angles(track(spark, sf_dir)).withColumn("q", g.from_yaw_pitch_roll(F.col("yaw"), F.col("pitch"), F.col("roll"))).withColumn("p", g.rotate(F.col("q"), g.vec3(F.col("x"), 1, -2)))
    return rows.select("event_id", *[r6(F.col(f"q.{c}"), f"q{c}") for c in "xyzw"], *[r6(F.col(f"p.{c}"), f"p{c}") for c in "xyz"])


def pose_compose_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pose after its inverse, and a point there and back."""
    rows = _angles(track(spark, sf_dir)).withColumn("p", g.pose(g.vec3(F.col("x"), F.col("pitch"), F.col("yaw")), g.from_yaw_pitch_roll(F.col("yaw"), F.col("pitch"), F.col("roll"))))
    rows = rows.withColumn("i", g.pose_inverse(F.col("p"))).withColumn("c", g.compose(F.col("i"), F.col("p")))
    rows = rows.withColumn("back", g.point_to_local(F.col("p"), g.point_to_world(F.col("p"), g.vec3(1, 2, 3))))
    return rows.select("event_id", *[r6(F.col(f"c.pos.{c}"), f"c{c}") for c in "xyz"], r6(F.abs(F.col("c.rot.w")), "cw"), *[r6(F.col(f"back.{c}"), f"back_{c}") for c in "xyz"], *[r6(F.col(f"i.pos.{c}"), f"i{c}") for c in "xyz"])


def swing_twist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _angles(track(spark, sf_dir)).withColumn("q", g.from_yaw_pitch_roll(F.col("yaw"), F.col("pitch"), F.col("roll"))).withColumn("t", g.twist_about(F.col("q"), g.vec3(0, 0, 1)))
    return rows.select("event_id", r6(F.col("t.z"), "tz"), r6(F.col("t.w"), "tw"))


def raw_extrinsic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _angles(track(spark, sf_dir)).withColumn("q", g.from_yaw_pitch_roll(F.col("yaw"), F.col("pitch"), F.col("roll")))
    rows = rows.withColumn("h", g.head_to_camera_from_raw(F.col("q"))).withColumn("m", g.repair_mirrored(F.col("q"))).withColumn("b", g.raw_from_head_to_camera(F.col("h")))
    return rows.select(
        "event_id", *[r6(F.col(f"h.{c}"), f"h{c}") for c in "xyzw"], *[r6(F.col(f"m.{c}"), f"m{c}") for c in "xyzw"],
        r6(F.abs(g.qdot(F.col("b"), F.col("q"))), "same"), r6(g.optical_axis_pitch_degrees(F.col("q")), "pitch"),
    )


def quat_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn about a fixed axis: its matrix, rotation vector, angle, roll about the optical axis, and text."""
    x = F.col("value")
    rows = track(spark, sf_dir).select("event_id", "value", g.from_axis_angle(g.vec3(2, 3, 6), x / 50).alias("q"))
    rows = rows.withColumn("m", g.matrix_column_major(F.col("q"))).withColumn("v", g.qlog(F.col("q"))).withColumn("roll", g.aligned_extrinsic(g.pose(g.vec3(0, 0, 0), F.col("q")), False))
    angle = F.round(g.angle_between_degrees(F.col("q"), g.quat(*g.IDENTITY)), 3) + F.lit(0.0)
    return rows.select(
        "event_id", *[r6(F.col(f"q.{c}"), f"q{c}") for c in "xyzw"], *[r6(F.get("m", k), f"m{k}") for k in range(9)], *[r6(F.col(f"v.{c}"), f"v{c}") for c in "xyz"],
        angle.alias("angle"), r6(F.col("roll.rot.z"), "roll_z"), g.vec3_text(g.vec3(x, 1, -2)).alias("text"),
    )


def frustum_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frusta cut by another and to a pane, intrinsics moved from the sensor to an image, fields of view and cutoffs."""
    e = F.col("event_id")
    rows = track(spark, sf_dir).select("event_id", o.fov(*_fov_edges().values()).alias("f"), (200.0 + (e % 50).cast("double")).alias("fx"))
    rows = rows.withColumn("i", o.intersect(F.col("f"), o.fov(*[F.lit(x) for x in (-0.7, 0.7, 0.6, -0.6)]))).withColumn("c", o.crop_to_pane_asymmetric(F.col("f"), F.lit(640), F.lit(480)))
    lens = F.struct(F.col("fx"), F.lit(310.0).alias("fy"), F.lit(641.5).alias("cx"), (630.0 + (e % 9).cast("double")).alias("cy"), F.array(F.lit(0.1)).alias("distortion"), F.array(*[F.lit(x) for x in (0.0, 0.0, 1280.0, 1280.0)]).alias("active_array"))
    rows = rows.withColumn("m", o.rebase_to_image(lens, F.lit(640), F.lit(480)))
    return rows.select(
        "event_id", *[r6(F.col(f"i.{k}"), f"i{k}") for k in "lrud"], *[r6(F.col(f"c.{k}"), f"c{k}") for k in "lrud"], *[r6(F.col(f"m.{k}"), k) for k in ("fx", "fy", "cx", "cy")],
        r6(o.hfov_degrees(F.col("fx"), F.lit(640)), "hfov"), r6(o.gaussian_cutoff_hz(((1 + e % 300) * 1_000_000).cast("double")), "cutoff"),
    )


def _lens() -> Column:
    e = F.col("event_id")
    return F.struct(
        (180.0 + (e % 20).cast("double") / 3).alias("fx"), (185.0 + (e % 20).cast("double") / 3).alias("fy"), F.lit(323.51234567).alias("cx"), F.lit(237.51234567).alias("cy"),
        F.array(*[F.lit(x) for x in (-0.06, 0.008, 0.0009, -0.0006, 0.0)]).alias("distortion"),
    )


def _directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return track(spark, sf_dir).select("event_id", "value", g.vec3((e % 41).cast("double") / 40 - 0.5, (e % 37).cast("double") / 40 - 0.4, F.when(e % 10 == 0, 1.0).otherwise(-1.0)).alias("dir"), _lens().alias("lens"))


def pinhole_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _directions(spark, sf_dir).withColumn("p", o.project_pinhole(F.col("lens"), F.col("dir")))
    return rows.select("event_id", r6(F.col("p.px"), "px"), r6(F.col("p.py"), "py"))


def pinhole_unproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = _directions(spark, sf_dir).withColumn("v", o.unproject_pinhole(F.col("lens"), (e % 640).cast("double"), (e % 480).cast("double")))
    return rows.select("event_id", *[r6(F.col(f"v.{c}"), c) for c in "xyz"])


def _fov_of(e: Column) -> Column:
    return o.fov(-(0.70 + (e % 5).cast("double") / 20), 0.86 + (e % 3).cast("double") / 20, F.lit(0.75), F.lit(-0.78))


def fov_project_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = track(spark, sf_dir).select("event_id", _fov_of(e).alias("f"))
    rows = rows.withColumn("v", o.fov_ray(F.col("f"), (e % 640).cast("double"), (e % 480).cast("double"), F.lit(640), F.lit(480)))
    rows = rows.withColumn("p", o.fov_project(F.col("f"), F.col("v"), F.lit(640), F.lit(480)))
    return rows.select("event_id", r6(F.col("v.x"), "x"), r6(F.col("v.y"), "y"), r6(F.col("p.px"), "px"), r6(F.col("p.py"), "py"))


def reproject_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ray over the sphere of an assumed depth into a turned and moved source frustum."""
    e = F.col("event_id")
    depth = F.when(e % 4 == 0, F.lit(float("inf"))).otherwise(1.0 + (e % 4).cast("double"))
    rows = _directions(spark, sf_dir).withColumn("f", _fov_of(e)).withColumn("depth", depth)
    rows = rows.withColumn("out", g.pose(g.vec3(0.1, 0.2, 0.3), g.quat(0, 0, 0, 1))).withColumn("src", _yaw_pose(F.lit(5.0) + (e % 7).cast("double")))
    rows = rows.withColumn("src", g.pose(g.scale(F.col("src.pos"), 0.01), F.col("src.rot")))
    ray = (F.col("out"), F.col("dir"), F.col("depth"), F.col("src"))
    rows = rows.withColumn("v", o.local_direction(*ray)).withColumn("p", o.reproject_to_fov(*ray, F.col("f"), F.lit(640), F.lit(480)))
    return rows.select("event_id", r6(F.col("v.x"), "x"), r6(F.col("v.y"), "y"), r6(F.col("v.z"), "z"), r6(F.col("p.px"), "px"), r6(F.col("p.py"), "py"))


def srgb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("event_id") % 256
    linear = o.srgb_to_linear(b.cast("double") / 255)
    return track(spark, sf_dir).select("event_id", r6(linear, "linear"), temporal.llround(o.linear_to_srgb(linear) * 255).alias("back"))


def over_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, x = F.col("event_id"), F.col("value")
    back, front, alpha = o.srgb_to_linear((e % 256).cast("double") / 255), o.srgb_to_linear(x / 500), (e % 101).cast("double") / 100
    both = lambda p: o.linear_to_srgb(o.over(back, front * alpha if p else front, alpha, p))
    return track(spark, sf_dir).select("event_id", r6(both(False), "straight"), r6(both(True), "premultiplied"))


def checker_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checker in the direction of each event's pixel of a pane of 64 x 48."""
    e = F.col("event_id")
    px, py = (e % 64).cast("double"), (F.call_function("div", e, F.lit(64)) % 48).cast("double")
    f = o.fov(F.lit(-0.95), F.lit(0.86), F.lit(0.75), F.lit(-0.78))
    rows = track(spark, sf_dir).select("event_id", raster.checker(o.fov_ray(f, px, py, F.lit(64), F.lit(48))).alias("c"))
    return rows.select("event_id", *[r6(F.get("c", i), k) for i, k in enumerate("rgb")])


def audio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tracks (user_id mod 3), placed at -50, 0 and 30 samples with gains 1, 0.5 and 2."""
    e = F.col("event_id")
    samples = track(spark, sf_dir).select((e % 3).alias("track"), F.call_function("div", e, F.lit(3)).alias("i"), "value")
    samples = samples.withColumnRenamed("value", "v")
    starts = spark.sql("SELECT * FROM VALUES (0L, -50L, 1.0D), (1L, 0L, 0.5D), (2L, 30L, 2.0D) AS t(track, start_sample, gain)")
    mix = audio.mixed(audio.placed(samples, F.broadcast(starts)))
    return mix.select("i", r6(F.col("v"), "v"))


def segment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as frames, cut into 1 to 12 segments."""
    cases = track(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3, 4, 8, 12)])))
    rows = cases.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).withColumn("s", temporal.segment_range(F.col("n"), F.col("i"), F.col("k")))
    return rows.select("user_id", "k", "i", F.col("s.begin").alias("first"), F.col("s.end").alias("last")).where("last > first")


def camera_clock_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured rate of each user's views, and their distance from a constant-rate grid in seconds."""
    found = temporal.phase_error(_type(track(spark, sf_dir), "view"), "t_ns", "event_id", ["user_id"], temporal.RUN)
    return found.select("user_id", "n", r6(F.col("fps") * 1e6, "microhertz"), F.round(F.col("worst_ms") * 1e-3, 3).alias("worst_s"), F.round(F.col("mean_ms") * 1e-3, 3).alias("mean_s"))


def spectral_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).withColumn("s", (F.col("t_ns") - T0).cast("double") * 1e-9)
    found = rows.groupBy("user_id").agg(*stats.spectral_bin(F.col("value"), F.col("s"), 1 / 86400))
    return found.select("user_id", F.round("amplitude", 4).alias("amplitude"), F.round("phase", 4).alias("phase"))


def roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.second_difference(track(spark, sf_dir), "value", "t_ns", ["user_id"], DAY).where("rough IS NOT NULL")
    found = stats.upper_medians(rows.select("user_id", "rough"), ["rough"], ["user_id"])
    return found.select("user_id", r6(F.col("rough") * 1e6, "rough"))


def visibility_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of an eye visibility, what they mean, and in which eye a layer is composed."""
    raw = F.get(F.array(*[F.lit(x) for x in ("both", "XR_EYE_VISIBILITY_LEFT", "Right", "none", "stereo")]), (F.col("event_id") % 5).cast("int"))
    rows = track(spark, sf_dir).select(v.eye_visibility(raw).alias("visibility"))
    seen = lambda eye: F.count_if(v.composed_in_eye(F.col("visibility"), F.lit(1.0), eye))
    return rows.groupBy("visibility").agg(F.count(F.lit(1)).alias("n"), seen(0).alias("left_eye"), seen(1).alias("right_eye"))


def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output instants at which the nearest record differs from the instant before: where a source is read anew."""
    return temporal.changes(asof_nearest_grid(spark, sf_dir).select("k", "event_id"), "event_id", "k")


def seek_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to seek to for a frame: midway between its stamp and the one before; null where stamps do not rise."""
    rows = _type(track(spark, sf_dir), "view", "value")
    rows = temporal.running(rows, ["event_id"], ["user_id"], temporal.RUN, None, {"before": "t_ns"})
    middle = (F.col("before") + F.col("t_ns") - 2 * T0).cast("double") / 2 * 1e-9
    return rows.withColumn("seek", F.when(F.col("before") < F.col("t_ns"), middle)).select("event_id", r6(F.col("seek"), "seek_s"))


def decimation_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a 90 Hz track: the records at which a 37 Hz overlay is captured, after two losses (n/3 and 2n/3)."""
    rows = temporal.ordinal(track(spark, sf_dir).select("user_id", "event_id"), "event_id", ["user_id"], "record", temporal.RUN)
    captured = temporal.ordinal(rows.where(temporal.decimated(F.col("record"), 37, 90)), "record", ["user_id"], "i", temporal.RUN)
    return temporal.without_two(captured, "i", ["user_id"]).select("user_id", "event_id", "record", "i")


def click_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = track(spark, sf_dir).select("user_id", F.col("event_id").alias("i"), F.col("value").alias("v"))
    return audio.clicks(samples, 100.0, ["user_id"]).select("user_id", "i")


def camera_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.get(F.array(*[F.lit(x) for x in ("L", "camR", "cam0", "right", "EYE1", "0", "rear")]), (F.col("event_id") % 7).cast("int"))
    return track(spark, sf_dir).select(raw.alias("raw")).groupBy("raw").agg(F.max(v.camera_key(F.col("raw"))).alias("cam"), F.count(F.lit(1)).alias("n"))


def pixel_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 rasters: centre and number of bright pixels, mean of the middle block."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    rows = rows.select("vec_id", (F.col("i") % 8).alias("px"), F.call_function("div", F.col("i"), F.lit(8)).alias("py"), F.col("x").cast("double").alias("x"))
    middle = F.col("px").between(3, 4) & F.col("py").between(3, 4)
    bright = lambda c: F.avg(F.when(F.col("x") > 0.1, F.col(c)))
    found = rows.groupBy("vec_id").agg(bright("px").alias("x"), bright("py").alias("y"), F.count_if(F.col("x") > 0.1).alias("n"), F.avg(F.when(middle, F.col("x"))).alias("block"))
    return found.select("vec_id", r6(F.col("x"), "x"), r6(F.col("y"), "y"), "n", r6(F.col("block"), "block"))


def covered_fov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest frustum inside a camera's image, seen over an assumed depth from a moved eye; a camera for each supplier."""
    e = F.col("s_suppkey") % 8
    lens = F.struct(F.lit(300.0).alias("fx"), F.lit(310.0).alias("fy"), F.lit(322.0).alias("cx"), F.lit(241.0).alias("cy"))
    cameras = spread(load(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", lens.alias("lens"), g.pose(g.vec3(0.02 + e / 200, 0.0, -0.06), g.from_yaw_pitch_roll(e / 40, F.lit(-0.05), F.lit(0.01))).alias("extrinsic"), F.lit(640).alias("width"), F.lit(480).alias("height"), g.vec3(0.03, 0, 0).alias("eye"))
    found = frusta.camera_covered(cameras, ["s_suppkey"], depth=1.5)
    return found.select("s_suppkey", *[r6(F.col(f"covered.{k}"), k) for k in "lrud"])


def predicted_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a pane shows a point: seen by a camera and held two metres away, and drawn in an overlay."""
    e = F.col("event_id")
    turned = lambda k, x: g.pose(g.vec3(x, 1.6, (e % 5).cast("double") / 20), g.quat(0, F.sin((e % k).cast("double") / 60), 0, F.cos((e % k).cast("double") / 60)))
    rows = track(spark, sf_dir).select("event_id", turned(13, F.lit(0.03)).alias("out"), turned(11, F.col("value") / 1000).alias("src"), g.vec3((e % 41).cast("double") / 10 - 2, (e % 37).cast("double") / 10, -3).alias("p"))
    f, size = o.fov(*[F.lit(x) for x in (-0.7, 0.75, 0.6, -0.65)]), (F.lit(640), F.lit(480))
    rows = rows.withColumn("b", o.predict_background_pixel(F.col("out"), f, *size, F.col("src"), F.col("p"), 2.0)).withColumn("f", o.predict_overlay_pixel(F.col("out"), f, *size, F.col("src"), F.col("p")))
    return rows.select("event_id", r6(F.col("b.px"), "back_x"), r6(F.col("b.py"), "back_y"), r6(F.col("f.px"), "front_x"), r6(F.col("f.py"), "front_y"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tracks of events' values."""
    e = F.col("event_id")
    return track(spark, sf_dir).select((e % 2).alias("track"), F.call_function("div", e, F.lit(2)).alias("i"), (F.col("value") / 100).alias("v"))


def audio_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """44,100 samples a second as 48,000."""
    found = audio.resampled(_samples(spark, sf_dir), 44_100, 48_000, ["track"])
    return found.select("track", "i", r6(F.col("v"), "v"))


def audio_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio.limited(_samples(spark, sf_dir), 0.98, ["track"], look=20, release=25)
    return found.select("track", "i", r6(F.col("v"), "v"))


def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of events' properties, read back as numbered lines: file, line and text."""
    rows = load(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 4096).alias("part"), F.regexp_replace("props", "\n", " ").alias("text"))
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("part", "text").write.partitionBy("part").text(path)
    found = numbered_lines(spark, f"{path}/*/*")
    return found.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "line", "text")


NAMES = (
    "asof_nearest_grid asof_nearest_by_user asof_backward ordinal_alignment overlay_source_record interp_linear_offset host_from_device interp_pose_slerp "
    "gaussian_smooth_value gaussian_smooth_pose upper_median_interval fov_edge_median frustum_union monotonicity_violations diagnostic_caps json_typed_extract "
    "span_overlap fk_anti quat_compose_rotate pose_compose_inverse swing_twist raw_extrinsic pinhole_project pinhole_unproject fov_project_roundtrip reproject_depth "
    "srgb_roundtrip over_linear checker_background audio_mix segment_ranges camera_clock_phase spectral_bin roughness visibility_histogram source_changes seek_points "
    "decimation_ticks click_runs camera_keys pixel_blocks covered_fov quat_functions frustum_functions line_scan predicted_pixels audio_resampled audio_limited"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: globals()[k] for k in NAMES}


def oracle_sql() -> dict[str, str]:
    from kinetrack.plans.oracles import ORACLES

    return dict(ORACLES)
