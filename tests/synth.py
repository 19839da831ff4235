"""Synthetic takes from closed forms: what a recording would hold if nothing were uncertain.

Tables are DataFrame expressions over ``spark.range``; ``write`` stores them as a take directory
(JSON and JSON lines; media are empty placeholders, described by ``media_info``).
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrack.functions import geom as g
from kinetrack.operators import temporal
from kinetrack.sources.take import MEDIA

NS = temporal.NS
#: The head's motion as (amplitude, Hz, phase) terms.
MOTION = {
    "x": ((0.060, 0.31, 0.0), (0.010, 4.70, 1.1)),
    "y": ((0.030, 0.47, 0.7), (0.008, 6.10, 0.0)),
    "z": ((0.040, 0.23, 2.0), (0.006, 5.30, 0.4)),
    "yaw": ((0.120, 0.29, 0.0), (0.020, 5.30, 0.9)),
    "pitch": ((0.060, 0.19, 1.3), (0.015, 6.70, 0.0)),
    "roll": ((0.012, 0.37, 0.2), (0.004, 7.30, 0.0)),
}
#: Where layers stand, and the seed of the clock's jitter.
MONITOR = ((0.30, 0.02, -1.10), -0.14)
HUD = (-0.52, 0.26, -0.55)
JITTER_SEED = 0x9E3779B97F4A7C15
PHASE_NS = 7_000_000
LENS_OFFSET = (3.5, -2.5)
DISTORTION = (-0.06, 0.008, 0.0009, -0.0006, 0.0)


@dataclass(frozen=True)
class SynthOptions:
    take_id: str = "synth"
    frames: int = 60
    hz: float = 90.0
    overlay_hz: float = 45.0
    overlay_width: int = 640
    overlay_height: int = 480
    cameras: bool = True
    camera_width: int = 640
    camera_height: int = 480
    camera_hz: float = 30.0
    exposure_ns: int = 8_000_000
    audio: bool = True
    mic: bool = True
    clock_offset_ms: float = 250.0
    clock_drift_ppm: float = 20.0
    clock_interval_ns: int = 100_000_000
    ipd: float = 0.063
    eye_fov: tuple[float, float, float, float] = (-0.95, 0.86, 0.75, -0.78)
    no_distortion: bool = False
    active_array_pad: int = 0
    head_speed: float = 1.0
    legacy_mirrored: bool = False
    focal_scale: float = 1.0
    camera_drop_every: int = 0
    baseline: float = 0.084
    forward: float = 0.045
    drop: float = 0.012
    splay_degrees: float = 2.0
    alpha: str = "premultiplied"
    t0_host_ns: int = 14_400 * NS

    def __post_init__(self) -> None:
        if self.frames <= 0 or self.hz <= 0:
            raise ValueError("a take needs frames and a rate above zero")
        if self.alpha not in ("premultiplied", "straight"):
            raise ValueError("alpha is premultiplied or straight")


def _sum(name: str, t: Column) -> Column:
    return sum((a * F.sin(2 * math.pi * hz * t + phase) for a, hz, phase in MOTION[name]), F.lit(0.0))


def head_at(t_ns: Column, options: SynthOptions) -> Column:
    """The head's pose at a host time."""
    t = (t_ns - options.t0_host_ns).cast("double") * 1e-9 * options.head_speed
    return g.pose(g.vec3(*[_sum(k, t) for k in "xyz"]), g.from_yaw_pitch_roll(*[_sum(k, t) for k in ("yaw", "pitch", "roll")]))


def _tick(k: Column, o: SynthOptions) -> Column:
    return F.floor(k.cast("double") * (o.overlay_hz or o.hz) / o.hz)


def records(spark: SparkSession, o: SynthOptions) -> DataFrame:
    """record, t_host_ns, dropped: decimated to the overlay's rate, with two captured frames lost."""
    k = F.col("id")
    rows = spark.range(o.frames).withColumn("captured", (k == 0) | (_tick(k, o) > _tick(k - 1, o)))
    total = rows.agg(F.count_if("captured")).first()[0]
    lost = rows.where("captured").orderBy("id").select("id").collect() if total >= 12 else []
    gone = [lost[total // 3][0], lost[2 * total // 3][0]] if lost else []
    return rows.select(
        k.alias("record"), temporal.output_instant(F.lit(o.t0_host_ns).cast("long"), k, F.lit(o.hz)).alias("t_host_ns"), (~F.col("captured") | k.isin(*gone) if gone else ~F.col("captured")).alias("dropped")
    )


def _pose_json(p: Column) -> Column:
    return F.struct(F.array(*[p["pos"][c] for c in "xyz"]).alias("pos"), F.array(*[p["rot"][c] for c in "xyzw"]).alias("quat"))


def _fov_json(f: tuple[float, ...]) -> Column:
    return F.struct(*[F.lit(x).alias(k) for k, x in zip("lrud", f, strict=True)])


def telemetry_lines(spark: SparkSession, o: SynthOptions) -> DataFrame:
    """record, text: the lines of telemetry.jsonl."""
    l, r, u, d = o.eye_fov  # noqa: E741
    rows = records(spark, o).withColumn("head", head_at(F.col("t_host_ns"), o))
    monitor = g.pose(g.vec3(*MONITOR[0]), g.from_axis_angle(g.vec3(0, 1, 0), F.lit(MONITOR[1])))
    rows = rows.withColumn("monitor", g.compose(g.pose_inverse(F.col("head")), monitor))
    hud = g.pose(g.vec3(*HUD), g.quat(*g.IDENTITY))
    eye = lambda x, f: F.struct(_pose_json(g.compose(F.col("head"), g.pose(g.vec3(x * o.ipd, 0, 0), g.quat(*g.IDENTITY)))).alias("pose"), _fov_json(f).alias("fov"))

    def quad(i: int, p: Column, size: tuple[float, float], view: bool, chain: int, seen: str, x: int) -> Column:
        return F.struct(
            F.lit(i).alias("index"), F.lit(None).cast("string").alias("name"), _pose_json(p).alias("pose"), F.array(F.lit(size[0]), F.lit(size[1])).alias("size"), F.lit(seen).alias("visibility"),
            F.lit(view).alias("view_space"), F.lit(chain).alias("swapchain"), (F.col("record") % 3).alias("image"), F.lit(0).alias("array_layer"), F.array(F.lit(x), F.lit(0), F.lit(o.overlay_width), F.lit(o.overlay_height)).alias("rect"),
        )

    turn = g.pose(g.vec3(0, 0, 0), g.from_axis_angle(g.vec3(0, 1, 0), F.lit(0.004)))
    line = F.struct(
        "t_host_ns", F.col("record").alias("frame"), F.array(eye(-0.5, (l, r, u, d)), eye(0.5, (-r, -l, u, d))).alias("eyes"), _pose_json(F.col("head")).alias("head"),
        F.array(quad(0, F.col("monitor"), (0.72, 0.42), False, 7, "left", 0), quad(1, F.col("monitor"), (0.72, 0.42), False, 7, "right", o.overlay_width), quad(2, hud, (0.2, 0.1), True, 9, "both", 0)).alias("quads"),
        _pose_json(turn).alias("stage_correction"), F.lit("alpha").alias("blend_mode"), "dropped",
    )
    return rows.select("record", F.to_json(line).alias("text"))


def clock_samples(o: SynthOptions) -> list[tuple[int, int, float]]:
    """(t_host_ns, offset_ns, rtt_us); the jitter comes from a 64-bit xorshift, which is sequential."""
    state, mask, out = JITTER_SEED, (1 << 64) - 1, []

    def draw() -> int:
        nonlocal state
        state ^= (state << 13) & mask
        state ^= state >> 7
        state ^= (state << 17) & mask
        return state

    end = o.t0_host_ns + round((o.frames - 1) * 1e9 / o.hz)
    for t in range(o.t0_host_ns - o.clock_interval_ns, end + 2 * o.clock_interval_ns + 1, o.clock_interval_ns):
        drift = round(o.clock_drift_ppm * (t - o.t0_host_ns) * 1e-9 * 1000)
        jitter = draw() % 40001 - 20000
        out.append((t, round(o.clock_offset_ms * 1e6) + drift + jitter, 1800.0 + draw() % 400))
    return out


def device_from_host(t: int, samples: list[tuple[int, int, float]]) -> int:
    """The piecewise-linear map, for the few stamps that the generator needs on the driver."""
    times = np.array([s[0] for s in samples], np.float64) - samples[0][0]
    return t + round(float(np.interp(t - samples[0][0], times, [s[1] for s in samples])))


def camera_of(eye: int, o: SynthOptions) -> dict:
    """Key, intrinsics and extrinsic (head to camera) of a camera."""
    sign = -1.0 if eye == 0 else 1.0
    f = 190.0 * o.focal_scale
    yaw, pitch = -sign * math.radians(o.splay_degrees), -0.0175
    qy, qp = (0.0, math.sin(yaw / 2), 0.0, math.cos(yaw / 2)), (math.sin(pitch / 2), 0.0, 0.0, math.cos(pitch / 2))
    quat = (qy[3] * qp[0], qy[1] * qp[3], -qy[1] * qp[0], qy[3] * qp[3])
    return {
        "cam": "LR"[eye], "fx": f, "fy": f, "cx": o.camera_width / 2 + LENS_OFFSET[0], "cy": o.camera_height / 2 + LENS_OFFSET[1] + o.active_array_pad,
        "distortion": None if o.no_distortion else list(DISTORTION), "pos": [sign * o.baseline / 2, -o.drop, -o.forward], "quat": list(quat),
    }


def camera_header(o: SynthOptions) -> dict:
    """The header of the camera sidecar: two parallel maps and the raw poses."""
    cams = [camera_of(e, o) for e in (0, 1)]
    intrinsics, extrinsics, raw = {}, {}, {}
    for c in cams:
        entry = {k: c[k] for k in ("fx", "fy", "cx", "cy", "distortion")}
        if o.active_array_pad:
            entry["pre_correction_active_array"] = [0, 0, o.camera_width, o.camera_height + 2 * o.active_array_pad]
        intrinsics[c["cam"]] = entry
        x, y, z, w = c["quat"]
        # the mirrored form is what a conversion without its conjugate gives
        extrinsics[c["cam"]] = {"pos": c["pos"], "quat": [-x, y, z, w] if o.legacy_mirrored else c["quat"]}
        raw[c["cam"]] = {"lens_pose_translation": c["pos"], "lens_pose_rotation": [-w, -z, y, -x]}
    return {
        "intrinsics": intrinsics, "extrinsics_head_to_camera": extrinsics, "extrinsics_android_raw": raw, "axes": "openxr", "timestamp_source": "REALTIME", "t_device_ns_domain": "device",
    }


def camera_stamps(spark: SparkSession, o: SynthOptions, samples: list) -> DataFrame:
    """cam, j, t_device_ns; only the left camera loses frames, which leaves gaps."""
    first = device_from_host(o.t0_host_ns + PHASE_NS, samples)
    count = math.floor((o.frames - 1) / o.hz * o.camera_hz) + 1
    rows = spark.range(count).select(F.col("id").alias("j"), F.explode(F.array(F.lit("L"), F.lit("R"))).alias("cam"))
    if o.camera_drop_every:
        rows = rows.where(~((F.col("cam") == "L") & (F.col("j") > 0) & (F.col("j") % o.camera_drop_every == 0)))
    return rows.select("cam", "j", temporal.output_instant(F.lit(first).cast("long"), F.col("j"), F.lit(o.camera_hz)).alias("t_device_ns"))


def write(spark: SparkSession, root: str, options: SynthOptions | None = None) -> DataFrame:
    """Writes a take below a local folder and returns its media_info table."""
    o = options or SynthOptions()
    at = Path(root)
    for d in ("overlay", "audio", "synth", *(["cameras"] if o.cameras else [])):
        (at / d).mkdir(parents=True, exist_ok=True)
    samples = clock_samples(o)
    manifest = {
        "take_id": o.take_id, "host": {"tool": "synth", "synthetic": True}, "sources": {"overlay": True, "app_audio": o.audio, "cameras": o.cameras, "mic": o.audio and o.mic},
        "overlay": {"width": o.overlay_width, "height": o.overlay_height, "format": "rgba", "encoder": "ffv1", "target_hz": o.overlay_hz or o.hz, "eye_count": 2, "alpha": o.alpha},
        "notes": ["synthetic take; media are placeholders"],
    }
    (at / "manifest.json").write_text(json.dumps(manifest, indent=2))
    lines = telemetry_lines(spark, o).orderBy("record")
    with (at / "telemetry.jsonl").open("w") as out:
        for row in lines.toLocalIterator():
            out.write(row["text"] + "\n")
    (at / "clock.jsonl").write_text("".join(json.dumps({"t_host_ns": t, "offset_ns": x, "rtt_us": r}) + "\n" for t, x, r in samples))
    kept = records(spark, o).where("NOT dropped").count()
    name, media = at.name, []
    row = lambda path, w=None, h=None, fps=None, codec="", pix="", n=0, rate=None, ch=None, dur=None: media.append((name, str(at / path), w, h, fps, codec, pix, [round(i * 1e9 / fps) for i in range(n)] if fps else [], True, rate, ch, dur, None))
    for e in (0, 1):
        (at / f"overlay/eye{e}.mkv").touch()
        row(f"overlay/eye{e}.mkv", o.overlay_width, o.overlay_height, o.overlay_hz or o.hz, "ffv1", "bgra", kept)
    if o.cameras:
        stamps = camera_stamps(spark, o, samples).orderBy("j", "cam").collect()
        with (at / f"cameras/{o.take_id}-cameras.jsonl").open("w") as out:
            out.write(json.dumps(camera_header(o)) + "\n")
            for r in stamps:
                out.write(json.dumps({"cam": r["cam"], "t_device_ns": r["t_device_ns"], "exposure_ns": o.exposure_ns, "frame": r["j"], "t_xr_ns": r["t_device_ns"]}) + "\n")
        for c in "LR":
            (at / f"cameras/{o.take_id}-cam{c}.mp4").touch()
            row(f"cameras/{o.take_id}-cam{c}.mp4", o.camera_width, o.camera_height, o.camera_hz, "h264", "yuv420p", sum(r["cam"] == c for r in stamps))
    if o.audio:
        duration = round((o.frames - 1) * 1e9 / o.hz)
        (at / "audio/app.flac").touch()
        (at / "audio/app.json").write_text(json.dumps({"start_t_host_ns": o.t0_host_ns + 120_000_000, "sample_rate_hz": 48000, "channels": 2}))
        row("audio/app.flac", rate=48000, ch=2, dur=duration)
        if o.mic:
            (at / f"{o.take_id}-mic.wav").touch()
            (at / f"{o.take_id}-mic.json").write_text(json.dumps({"start_t_device_ns": device_from_host(o.t0_host_ns + 60_000_000, samples), "sample_rate_hz": 48000, "channels": 1}))
            row(f"{o.take_id}-mic.wav", rate=48000, ch=1, dur=duration)
    (at / "synth/ground-truth.json").write_text(json.dumps(asdict(o)))
    return spark.createDataFrame(media, MEDIA)
