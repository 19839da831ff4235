"""Frusta, lenses, reprojection and colour as functions over columns.

A frustum is a struct (l, r, u, d) of signed half-angles in radians; images have y down and row 0 on
the edge ``u``.  Intrinsics are a struct (fx, fy, cx, cy, distortion array, active_array).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetrack.functions.geom import _c, add, bound, dir_to_local, dot, normalize, once, point_to_local, scale, sub, vec3

#: A half-angle from here on counts as degenerate.
ANGLE_LIMIT = 1.55
Z_EPS = 1e-9


def fov(l: Column, r: Column, u: Column, d: Column) -> Column:  # noqa: E741
    return F.struct(_c(l).alias("l"), _c(r).alias("r"), _c(u).alias("u"), _c(d).alias("d"))


@once
def from_tangents(l: Column, r: Column, u: Column, d: Column) -> Column:  # noqa: E741
    return fov(F.atan(l), F.atan(r), F.atan(u), F.atan(d))


@once
def sane(f: Column) -> Column:
    ok = F.lit(True)
    for k in "lrud":
        ok = ok & f[k].isNotNull() & ~F.isnan(f[k]) & (F.abs(f[k]) < ANGLE_LIMIT)
    return F.coalesce(ok & (f["r"] > f["l"]) & (f["u"] > f["d"]), F.lit(False))


@once
def tangents(f: Column) -> Column:
    return F.struct(*[F.tan(f[k]).alias(k) for k in "lrud"])


@once
def tan_width(f: Column) -> Column:
    return F.tan(f["r"]) - F.tan(f["l"])


@once
def tan_height(f: Column) -> Column:
    return F.tan(f["u"]) - F.tan(f["d"])


@once
def angular_aspect(f: Column) -> Column:
    return tan_width(f) / tan_height(f)


@once
def optical_centre_u(f: Column) -> Column:
    return -F.tan(f["l"]) / tan_width(f)


@once
def optical_centre_v(f: Column) -> Column:
    return F.tan(f["u"]) / tan_height(f)


@once
def angular_pixel(f: Column, width: Column, height: Column) -> Column:
    """Tangent units of a pixel when the whole frustum has to fit the pane."""
    return F.when((width > 0) & (height > 0), F.greatest(tan_width(f) / width, tan_height(f) / height)).otherwise(0.0)


@once
def fit_to_pane(f: Column, width: Column, height: Column, pixel: Column | None = None) -> Column:
    """Pads the frustum, the same on both sides, to the pane's aspect; crops nothing."""
    pixel = angular_pixel(f, width, height) if pixel is None else F.when(pixel > 0, pixel).otherwise(angular_pixel(f, width, height))

    def padded(s: Column) -> Column:
        px = F.greatest(F.lit(0.0), s["p"] * width - tan_width(f)) / 2
        py = F.greatest(F.lit(0.0), s["p"] * height - tan_height(f)) / 2
        t = tangents(f)
        out = from_tangents(t["l"] - px, t["r"] + px, t["u"] + py, t["d"] - py)
        return F.when((width <= 0) | (height <= 0) | ~(s["p"] > 0), f).otherwise(out)

    return bound(F.struct(pixel.alias("p")), padded)


@once
def symmetrize(f: Column) -> Column:
    """The largest frustum inside, symmetric about forward."""
    x = F.least(F.abs(F.tan(f["l"])), F.abs(F.tan(f["r"])))
    y = F.least(F.abs(F.tan(f["u"])), F.abs(F.tan(f["d"])))
    return from_tangents(-x, x, y, -y)


@once
def intersect(a: Column, b: Column) -> Column:
    return fov(F.greatest(a["l"], b["l"]), F.least(a["r"], b["r"]), F.least(a["u"], b["u"]), F.greatest(a["d"], b["d"]))


def _crop_pixel(f: Column, width: Column, height: Column) -> Column:
    return F.least(tan_width(f) / width, tan_height(f) / height)


@once
def crop_to_pane(f: Column, width: Column, height: Column) -> Column:
    """Crops to the pane's aspect, symmetric about forward."""
    p = _crop_pixel(f, width, height)
    x, y = p * width / 2, p * height / 2
    return F.when((width <= 0) | (height <= 0) | ~(p > 0), f).otherwise(from_tangents(-x, x, y, -y))


@once
def crop_to_pane_asymmetric(f: Column, width: Column, height: Column) -> Column:
    """Crops to the pane's aspect, the same on both sides."""
    p = _crop_pixel(f, width, height)
    x, y, t = (tan_width(f) - p * width) / 2, (tan_height(f) - p * height) / 2, tangents(f)
    return F.when((width <= 0) | (height <= 0) | ~(p > 0), f).otherwise(from_tangents(t["l"] + x, t["r"] - x, t["u"] - y, t["d"] + y))


@once
def fov_ray(f: Column, px: Column, py: Column, width: Column, height: Column) -> Column:
    """Direction of the centre of a pixel (px, py count from the first pixel's centre)."""
    t = tangents(f)
    return vec3(t["l"] + (px + 0.5) / width * (t["r"] - t["l"]), t["u"] + (py + 0.5) / height * (t["d"] - t["u"]), -1.0)


@once
def fov_project(f: Column, direction: Column, width: Column, height: Column) -> Column:
    """struct (px, py) of a direction, null behind the eye."""
    t = tangents(f)
    tx, ty = direction["x"] / -direction["z"], direction["y"] / -direction["z"]
    at = F.struct(((tx - t["l"]) / (t["r"] - t["l"]) * width - 0.5).alias("px"), ((ty - t["u"]) / (t["d"] - t["u"]) * height - 0.5).alias("py"))
    return F.when(direction["z"] < 0, at)


# -- lenses ----------------------------------------------------------------------------------


def distortion5(k: Column) -> Column:
    """The first five coefficients, zeros where there are fewer."""
    return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.coalesce(F.get(k, i), F.lit(0.0)))


@once
def distort(k: Column, xn: Column, yn: Column) -> Column:
    """Brown-Conrady: k1, k2, p1, p2, k3 on normalised image coordinates."""
    k1, k2, p1, p2, k3 = (F.get(k, i) for i in range(5))
    r2 = xn * xn + yn * yn
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return F.struct((xn * radial + 2 * p1 * xn * yn + p2 * (r2 + 2 * xn * xn)).alias("x"), (yn * radial + p1 * (r2 + 2 * yn * yn) + 2 * p2 * xn * yn).alias("y"))


@once
def project_pinhole(intrinsics: Column, direction: Column) -> Column:
    """struct (px, py), null at or behind the lens plane."""
    z = -direction["z"]

    def at(d: Column) -> Column:
        return F.struct((intrinsics["fx"] * d["x"] + intrinsics["cx"]).alias("px"), (intrinsics["fy"] * d["y"] + intrinsics["cy"]).alias("py"))

    return F.when(z > Z_EPS, bound(distort(distortion5(intrinsics["distortion"]), direction["x"] / z, -direction["y"] / z), at))


@once
def unproject_pinhole(intrinsics: Column, px: Column, py: Column, rounds: int = 20) -> Column:
    """Ray of a pixel: fixed-point inverse of the distortion, in a fold."""
    start = F.struct(((px - intrinsics["cx"]) / intrinsics["fx"]).alias("x"), ((py - intrinsics["cy"]) / intrinsics["fy"]).alias("y"))

    def solve(s: Column) -> Column:
        def step(n: Column, _: Column) -> Column:
            return bound(distort(s["k"], n["x"], n["y"]), lambda d: F.struct((n["x"] - (d["x"] - s["s"]["x"])).alias("x"), (n["y"] - (d["y"] - s["s"]["y"])).alias("y")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), s["s"], step, lambda n: vec3(n["x"], -n["y"], -1.0))

    return bound(F.struct(start.alias("s"), distortion5(intrinsics["distortion"]).alias("k")), solve)


@once
def rebase_to_image(intrinsics: Column, width: Column, height: Column) -> Column:
    """Intrinsics of the sensor's active array -> of its centre crop scaled to the image; unchanged where these agree."""
    a = intrinsics["active_array"]
    left, top, aw, ah = (F.get(a, i) for i in range(4))
    same = (F.abs(aw - width) < 0.5) & (F.abs(ah - height) < 0.5) & (F.abs(left) < 0.5) & (F.abs(top) < 0.5)
    usable = (aw > 0) & (ah > 0) & (width > 0) & (height > 0) & ~same
    wide = aw / ah > width / height
    cw, ch = F.when(wide, ah * width / height).otherwise(aw), F.when(wide, ah).otherwise(aw * height / width)
    k = width / cw
    moved = F.struct(
        (intrinsics["fx"] * k).alias("fx"), (intrinsics["fy"] * k).alias("fy"),
        ((intrinsics["cx"] - left - (aw - cw) / 2) * k).alias("cx"), ((intrinsics["cy"] - top - (ah - ch) / 2) * k).alias("cy"),
        intrinsics["distortion"].alias("distortion"), a.alias("active_array"),
    )
    kept = F.struct(*[intrinsics[n].alias(n) for n in ("fx", "fy", "cx", "cy", "distortion", "active_array")])
    return F.when(F.coalesce(usable, F.lit(False)), moved).otherwise(kept)


@once
def hfov_degrees(fx: Column, width: Column) -> Column:
    return F.when(fx > 0, F.degrees(2 * F.atan(0.5 * width / fx))).otherwise(0.0)


# -- reprojection ----------------------------------------------------------------------------


def depth_is_infinite(depth: Column) -> Column:
    return ~(depth > 0) | (depth == float("inf")) | F.isnan(depth)


@once
def local_direction(output: Column, direction: Column, depth: Column, source: Column) -> Column:
    """What an output ray looks at, on the sphere of the assumed depth about the output camera, in the source's space."""
    point = point_to_local(source, add(output["pos"], scale(normalize(direction), depth)))
    return F.when(depth_is_infinite(depth), dir_to_local(source, direction)).otherwise(point)


@once
def reproject_to_camera(output: Column, direction: Column, depth: Column, source: Column, intrinsics: Column) -> Column:
    return bound(local_direction(output, direction, depth, source), lambda v: project_pinhole(intrinsics, v))


@once
def reproject_to_fov(output: Column, direction: Column, depth: Column, source: Column, f: Column, width: Column, height: Column) -> Column:
    return bound(local_direction(output, direction, depth, source), lambda v: fov_project(f, v, width, height))


# -- colour ----------------------------------------------------------------------------------


@once
def predict_background_pixel(output: Column, fov: Column, width: Column, height: Column, camera: Column, world: Column, depth: Column | float) -> Column:
    """struct (px, py): where an output pane shows a point that a camera sees, the picture being held at ``depth`` about the output's eye; null where it does not.

    This goes the other way than compositing does: from the camera along its ray to the sphere, and from there into the pane.
    """
    ray = normalize(sub(world, camera["pos"]))
    offset = sub(camera["pos"], output["pos"])

    def meet(s: Column) -> Column:
        along = dot(s["offset"], s["ray"])
        root = along * along - dot(s["offset"], s["offset"]) + depth * depth
        travel = F.when(root >= 0, -along + F.sqrt(root))
        return F.when(travel > 0, add(camera["pos"], scale(s["ray"], travel)))

    return bound(bound(F.struct(offset.alias("offset"), ray.alias("ray")), meet), lambda p: F.when(p.isNotNull(), fov_project(fov, point_to_local(output, p), width, height)))


def predict_overlay_pixel(output: Column, fov: Column, width: Column, height: Column, eye: Column, world: Column) -> Column:
    """struct (px, py): where an output pane shows a point drawn in an overlay that was recorded from ``eye``, by direction alone."""
    return fov_project(fov, dir_to_local(output, sub(world, eye["pos"])), width, height)


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0, 0.0).when(v >= 1, 1.0).when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


@once
def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0, 0.0).when(v >= 1, 1.0).when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def over(background: Column, colour: Column, alpha: Column, premultiplied: bool) -> Column:
    """Linear-light over; alpha is never encoded."""
    return background * (1 - alpha) + (colour if premultiplied else colour * alpha)


def gaussian_cutoff_hz(sigma_ns: Column) -> Column:
    """Frequency at which the smoother's gain is 1/sqrt(2); 0 without smoothing."""
    return F.when(sigma_ns > 0, F.sqrt(F.log(F.lit(2.0)) / 2) / (F.pi() * sigma_ns * 1e-9)).otherwise(0.0)
