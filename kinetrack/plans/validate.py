"""``validate``: what is in takes, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrack.operators import diagnostics
from kinetrack.plans.render_plan import median_interval
from kinetrack.sources.take import Take


def described(take: Take) -> DataFrame:
    """take_id, summary: a few lines of text for each take."""
    t = take.telemetry.groupBy("take_id").agg(
        F.count(F.lit(1)).alias("records"), F.min("t_host_ns").alias("t0"), F.max("t_host_ns").alias("t1"), F.count_if("dropped").alias("dropped"), F.count_if("has_quads").alias("with_quads"),
        F.sum(F.size("quads")).alias("quads"),
    )
    seen = take.telemetry.select("take_id", F.explode("quads").alias("q")).groupBy("take_id", F.col("q.visibility").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    seen = seen.groupBy("take_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("v", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit("x"), x["v"])), ", ").alias("visibility"))
    clock = take.clock.groupBy("take_id").agg(F.count(F.lit(1)).alias("samples"), F.min_by("offset_ns", "t_host_ns").alias("o0"), F.max_by("offset_ns", "t_host_ns").alias("o1"))
    frames = take.camera_frames.groupBy("take_id", "cam").agg(F.count(F.lit(1)).alias("n"))
    cams = take.cameras.join(frames, ["take_id", "cam"], "left").groupBy("take_id").agg(F.sort_array(F.collect_list(F.format_string("[camera %s] focal length %.1f by %.1f px, %d frames", F.col("cam"), F.col("lens.fx"), F.col("lens.fy"), F.coalesce("n", F.lit(0))))).alias("cams"))
    audio = take.audio.groupBy("take_id").agg(F.sort_array(F.collect_list(F.format_string("[audio %s] starts in %s time; channels: %d, samples a second: %d", F.col("role"), F.when(F.col("device_clock"), "device").otherwise("host"), F.col("channels"), F.col("sample_rate")))).alias("tracks"))
    rows = take.manifest
    for x in (t, median_interval(take.telemetry), seen, clock, cams, audio):
        rows = rows.join(x, "take_id", "left")
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(
            F.format_string("[take] %s", F.coalesce("name", F.lit("without a name"))),
            F.format_string("[time] %.3f s in %d records, upper median step %.3f ms", (F.col("t1") - F.col("t0")) * 1e-9, F.coalesce("records", F.lit(0)), F.col("interval_ns") * 1e-6),
            F.when(F.col("samples") > 0, F.format_string("[clock] device - host goes from %.3f to %.3f ms in %d samples", F.col("o0") * 1e-6, F.col("o1") * 1e-6, F.col("samples"))).otherwise("[clock] device = host"),
            F.when(F.col("has_overlay"), F.format_string("[overlay] %d record(s) carry pixels, %d dropped; %s alpha, %s by %s, %d by %d px, %.1f a second wanted", F.col("records") - F.col("dropped"), F.col("dropped"), F.col("alpha"), F.col("format"), F.col("encoder"), F.col("width"), F.col("height"), F.col("target_hz"))).otherwise("[overlay] none"),
        ),
        F.when(F.col("with_quads") > 0, F.array(F.format_string("[layers] %s: %d in %d records", "visibility", "quads", "with_quads"))).otherwise(none),
        F.coalesce("cams", F.array(F.lit("[cameras] none"))), F.coalesce("tracks", none), F.transform(F.coalesce("notes", none), lambda n: F.concat(F.lit("[note] "), n)),
    )
    return rows.select("take_id", F.array_join(lines, "\n").alias("summary"))


def validate(take: Take, strict: bool = False) -> DataFrame:
    """take_id, errors, warnings, notes, exit_code, report (JSON, the summary in it), summary."""
    found, summaries = take.diagnostics, take.settle(described(take))
    takes = take.manifest.select("take_id").unionByName(found.select("take_id")).distinct()
    rows = takes.join(diagnostics.counts(found, ["take_id"]), "take_id", "left").fillna(0, ["errors", "warnings", "notes"])
    rows = rows.join(diagnostics.report(found, takes, summaries), "take_id").join(summaries, "take_id", "left")
    opened = F.col("summary").isNotNull()
    return rows.select("take_id", "errors", "warnings", "notes", diagnostics.exit_code(F.col("errors"), F.col("warnings"), strict, opened).alias("exit_code"), "report", "summary")
