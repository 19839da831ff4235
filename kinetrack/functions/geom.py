"""Vectors, quaternions and poses as functions over struct columns.

Vectors are structs (x, y, z), quaternions (x, y, z, w), poses (pos, rot): local to world,
``world = rot * local + pos``.  Space is right-handed: +X right, +Y up, -Z forward.

A struct-valued helper mentions its inputs several times; bind intermediate results with
``withColumn`` (one column a stage) or ``bound`` where chains get long.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS_ANGLE = 1e-12
#: Above this dot product slerp turns into a normalised lerp.
NLERP_FROM = 0.9995

Number = Column | float


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plain(c: Column) -> bool:
    """A column, a field of one or a lambda's variable: no computation to repeat."""
    return "(" not in str(c)


def once(f: Callable[..., Column]) -> Callable[..., Column]:
    """Binds computed arguments, so that nesting helpers does not multiply their expressions."""

    @functools.wraps(f)
    def bind(*args: Number, **more: Number) -> Column:
        deep = [i for i, a in enumerate(args) if isinstance(a, Column) and not _plain(a)]
        if not deep:
            return f(*args, **more)
        held = F.struct(*[args[i].alias(f"a{i}") for i in deep])
        return bound(held, lambda s: f(*[s[f"a{i}"] if i in deep else a for i, a in enumerate(args)], **more))

    return bind


# -- vectors ---------------------------------------------------------------------------------


def vec3(x: Number, y: Number, z: Number) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"), _c(z).alias("z"))


@once
def add(a: Column, b: Column) -> Column:
    return vec3(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


@once
def sub(a: Column, b: Column) -> Column:
    return vec3(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


@once
def scale(a: Column, k: Number) -> Column:
    k = _c(k)
    return vec3(a["x"] * k, a["y"] * k, a["z"] * k)


@once
def neg(a: Column) -> Column:
    return vec3(-a["x"], -a["y"], -a["z"])


@once
def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


@once
def cross(a: Column, b: Column) -> Column:
    return vec3(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


@once
def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


@once
def normalize(a: Column) -> Column:
    """Unit vector; forward (0, 0, -1) for the zero vector."""
    return bound(length(a), lambda n: F.when(n > 0, vec3(a["x"] / n, a["y"] / n, a["z"] / n)).otherwise(vec3(0, 0, -1)))


@once
def finite(a: Column) -> Column:
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return ok(a["x"]) & ok(a["y"]) & ok(a["z"])


# -- quaternions -----------------------------------------------------------------------------


def quat(x: Number, y: Number, z: Number, w: Number) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"), _c(z).alias("z"), _c(w).alias("w"))


IDENTITY = (0.0, 0.0, 0.0, 1.0)
#: Half a turn about +X: between a camera that looks along +Z with y down and one that looks along -Z.
HALF_TURN_X = (1.0, 0.0, 0.0, 0.0)


@once
def qdot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"] + a["w"] * b["w"]


@once
def qnorm(q: Column) -> Column:
    return F.sqrt(qdot(q, q))


@once
def qnormalize(q: Column) -> Column:
    return bound(qnorm(q), lambda n: F.when(n > 0, quat(q["x"] / n, q["y"] / n, q["z"] / n, q["w"] / n)).otherwise(quat(*IDENTITY)))


@once
def conjugate(q: Column) -> Column:
    return quat(-q["x"], -q["y"], -q["z"], q["w"])


inverse = conjugate


@once
def qmul(a: Column, b: Column) -> Column:
    """Hamilton product: first ``b``, then ``a``."""
    return quat(
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] + a["y"] * b["w"] + a["z"] * b["x"] - a["x"] * b["z"],
        a["w"] * b["z"] + a["z"] * b["w"] + a["x"] * b["y"] - a["y"] * b["x"],
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
    )


@once
def rotate(q: Column, v: Column) -> Column:
    """The vector turned by the (unit) quaternion, through its rotation matrix."""
    m = matrix_rows(q)
    return vec3(*[r[0] * v["x"] + r[1] * v["y"] + r[2] * v["z"] for r in m])


def matrix_rows(q: Column) -> list[list[Column]]:
    x, y, z, w = q["x"], q["y"], q["z"], q["w"]
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


@once
def matrix_column_major(q: Column) -> Column:
    m = matrix_rows(q)
    return F.array(*[m[r][c] for c in range(3) for r in range(3)])


@once
def from_axis_angle(axis: Column, angle: Column) -> Column:
    return bound(normalize(axis), lambda u: quat(u["x"] * F.sin(angle / 2), u["y"] * F.sin(angle / 2), u["z"] * F.sin(angle / 2), F.cos(angle / 2)))


@once
def from_yaw_pitch_roll(yaw: Column, pitch: Column, roll: Column) -> Column:
    """Yaw about +Y, then pitch about the turned +X, then roll about the turned -Z."""
    half = lambda a: a / 2
    y = quat(0, F.sin(half(yaw)), 0, F.cos(half(yaw)))
    p = quat(F.sin(half(pitch)), 0, 0, F.cos(half(pitch)))
    r = quat(0, 0, -F.sin(half(roll)), F.cos(half(roll)))
    return bound(qmul(qmul(y, p), r), qnormalize)


@once
def qlog(q: Column) -> Column:
    """Rotation vector of the shorter way round."""

    def of(u: Column) -> Column:
        sign = F.when(u["w"] < 0, -1.0).otherwise(1.0)
        axis = vec3(u["x"] * sign, u["y"] * sign, u["z"] * sign)

        def scaled(a: Column) -> Column:
            s = length(a)
            return F.when(s < EPS_ANGLE, scale(a, 2.0)).otherwise(scale(a, 2.0 * F.atan2(s, F.abs(u["w"])) / s))

        return bound(axis, scaled)

    return bound(qnormalize(q), of)


@once
def qexp(v: Column) -> Column:
    def of(n: Column) -> Column:
        k = F.sin(n / 2) / n
        return F.when(n < EPS_ANGLE, quat(v["x"] / 2, v["y"] / 2, v["z"] / 2, 1.0)).otherwise(quat(v["x"] * k, v["y"] * k, v["z"] * k, F.cos(n / 2)))

    return bound(length(v), of)


@once
def slerp(a: Column, b: Column, t: Column) -> Column:
    """Shortest-arc interpolation of rotations."""

    def both(p: Column) -> Column:
        d = qdot(p["a"], p["b"])
        flip = F.when(d < 0, -1.0).otherwise(1.0)
        near = F.abs(d) > NLERP_FROM
        theta = F.acos(F.least(F.abs(d), F.lit(1.0)))
        wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * theta) / F.sin(theta))
        wb = F.when(near, t).otherwise(F.sin(t * theta) / F.sin(theta)) * flip
        return bound(F.struct(wa.alias("a"), wb.alias("b")), lambda k: bound(quat(*[p["a"][c] * k["a"] + p["b"][c] * k["b"] for c in "xyzw"]), qnormalize))

    return bound(F.struct(qnormalize(a).alias("a"), qnormalize(b).alias("b")), both)


@once
def twist_about(q: Column, axis: Column) -> Column:
    """The part of ``q`` that turns about ``axis`` (swing and twist), with w >= 0."""

    def of(u: Column) -> Column:
        along = dot(q, u)

        def unit(k: Column) -> Column:
            n = qnorm(k)
            sign = F.when(k["w"] < 0, -1.0).otherwise(1.0) / n
            return F.when(n < 1e-9, quat(*IDENTITY)).otherwise(quat(*[k[c] * sign for c in "xyzw"]))

        return bound(quat(u["x"] * along, u["y"] * along, u["z"] * along, q["w"]), unit)

    return bound(normalize(axis), of)


@once
def angle_between_degrees(a: Column, b: Column) -> Column:
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(qdot(a, b)))))


@once
def optical_axis_pitch_degrees(q: Column) -> Column:
    y = rotate(q, vec3(0, 0, -1))["y"]
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y))))


@once
def head_to_camera_from_raw(raw: Column) -> Column:
    """Sensor-to-camera rotation as phones store it -> head-to-camera."""
    return bound(qmul(conjugate(raw), quat(*HALF_TURN_X)), qnormalize)


@once
def raw_from_head_to_camera(q: Column) -> Column:
    return bound(conjugate(qmul(q, quat(*HALF_TURN_X))), qnormalize)


@once
def repair_mirrored(stored: Column) -> Column:
    """A head-to-camera rotation that was stored mirrored."""
    turn = quat(*HALF_TURN_X)
    return bound(qmul(qmul(turn, inverse(stored)), turn), qnormalize)


# -- poses -----------------------------------------------------------------------------------


def pose(pos: Column, rot: Column) -> Column:
    return F.struct(pos.alias("pos"), rot.alias("rot"))


@once
def point_to_world(p: Column, v: Column) -> Column:
    return add(rotate(p["rot"], v), p["pos"])


@once
def point_to_local(p: Column, v: Column) -> Column:
    return rotate(conjugate(p["rot"]), sub(v, p["pos"]))


@once
def dir_to_world(p: Column, v: Column) -> Column:
    return rotate(p["rot"], v)


@once
def dir_to_local(p: Column, v: Column) -> Column:
    return rotate(conjugate(p["rot"]), v)


@once
def compose(a: Column, b: Column) -> Column:
    """The pose of ``b``, which is given in the space of ``a``."""
    return pose(point_to_world(a, b["pos"]), qmul(a["rot"], b["rot"]))


@once
def pose_inverse(p: Column) -> Column:
    return pose(neg(rotate(conjugate(p["rot"]), p["pos"])), conjugate(p["rot"]))


@once
def interpolate(a: Column, b: Column, t: Column) -> Column:
    """Linear in position, slerp in rotation."""
    return pose(add(a["pos"], scale(sub(b["pos"], a["pos"]), t)), slerp(a["rot"], b["rot"], t))


@once
def head_pose(head: Column, eyes: Column) -> Column:
    """The head where it is recorded; else the middle of the first two eyes, one eye, or the identity."""
    first, second = F.get(eyes, 0)["pose"], F.get(eyes, 1)["pose"]
    middle = pose(scale(add(first["pos"], second["pos"]), 0.5), slerp(first["rot"], second["rot"], F.lit(0.5)))
    return F.when(head.isNotNull(), head).when(F.size(eyes) >= 2, middle).when(F.size(eyes) == 1, first).otherwise(pose(vec3(0, 0, 0), quat(*IDENTITY)))


def aligned_extrinsic(extrinsic: Column, recorded: bool) -> Column:
    """The extrinsic as recorded, or with only the roll about the optical axis kept."""
    return extrinsic if recorded else pose(extrinsic["pos"], twist_about(extrinsic["rot"], vec3(0, 0, 1)))


@once
def vec3_text(v: Column) -> Column:
    return F.format_string("(%.6f, %.6f, %.6f)", v["x"], v["y"], v["z"])


@once
def quat_text(q: Column) -> Column:
    return F.format_string("(%.6f, %.6f, %.6f, %.6f)", q["x"], q["y"], q["z"], q["w"])
