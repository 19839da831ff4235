"""Command line: ``python -m kinetrack.cli validate|plan|report|render``."""

from __future__ import annotations

import argparse
import logging
import re
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrack.operators import raster
from kinetrack.operators.diagnostics import printable
from kinetrack.plans import compose
from kinetrack.plans.render_plan import RenderOptions, make_plan, report_frames, report_json
from kinetrack.plans.validate import validate
from kinetrack.sources.media import write_frames
from kinetrack.sources.take import Take


def size(text: str) -> tuple[int, int]:
    """Width and height in pixels, such as 1280x720; both positive."""
    found = re.fullmatch(r"(\d+)x(\d+)", text, re.ASCII)
    if not found or not int(found[1]) or not int(found[2]):
        raise argparse.ArgumentTypeError(f"{text!r} is not a size such as 1280x720")
    return int(found[1]), int(found[2])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinetrack")
    top.add_argument("-v", "--verbose", action="store_true")
    top.add_argument("-q", "--quiet", action="store_true")
    top.add_argument("--explain", action="store_true", help="print the plans that run")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("validate", help="check one take or a glob of takes")
    p.add_argument("take")
    p.add_argument("--media", help="Parquet table of media facts")
    p.add_argument("--strict", action="store_true", help="warnings count as errors")
    p.add_argument("--json", action="store_true")
    for name, more in (("plan", "one row for each take"), ("report", "one row for each output frame"), ("render", "output frames as PNG files, their report and a summary")):
        p = sub.add_parser(name, help=more)
        p.add_argument("take")
        p.add_argument("--out", required=True, help="folder for the result")
        p.add_argument("--media")
        p.add_argument("--eye", default="left", choices=("left", "right", "sbs"))
        p.add_argument("--size", type=size, default=(0, 0))
        p.add_argument("--fps", type=float, default=0.0)
        p.add_argument("--clock", default="overlay", choices=("overlay", "camera"))
        p.add_argument("--framing", default="asis", choices=("asis", "stabilized"))
        p.add_argument("--sigma-ms", type=float, default=200.0)
        p.add_argument("--frustum", default="presentation", choices=("presentation", "camera", "recorded"))
        p.add_argument("--background", default="auto", choices=("auto", "camera", "checker", "solid"))
        p.add_argument("--bg-depth", type=float, default=1.0)
        p.add_argument("--bg-align", default="recorded", choices=("recorded", "auto"))
        p.add_argument("--fg-depth", type=float, default=float("inf"))
        p.add_argument("--limit", type=int, default=0)
        if name == "render":
            p.add_argument("--rasters", required=True, help="Parquet table of the sources' frames")
            p.add_argument("--jobs", type=int, default=1, help="segments that a take is cut into")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.DEBUG if a.verbose else logging.ERROR if a.quiet else logging.INFO)
    spark = SparkSession.builder.appName("kinetrack").getOrCreate()
    media = spark.read.parquet(a.media) if a.media else None
    if a.command == "validate":
        take = Take.load(spark, a.take, media)
        try:
            return _validate(take, a.strict, a.json)
        finally:
            take.release()
    options = RenderOptions(
        eye=a.eye, width=a.size[0], height=a.size[1], fps=a.fps, clock=a.clock, framing=a.framing, sigma_ms=a.sigma_ms, frustum=a.frustum, background=a.background,
        background_depth=a.bg_depth, align=a.bg_align, overlay_depth=a.fg_depth, limit=a.limit, jobs=getattr(a, "jobs", 1),
    )
    take = Take.load(spark, a.take, media)
    try:
        if a.command == "render":
            _render(take, spark.read.parquet(a.rasters), options, a.out)
            return 0
        plan = make_plan(take, options).where(F.col("renderable"))
        result = plan if a.command == "plan" else report_json(report_frames(take, plan, options))
        if a.explain:
            result.explain("formatted")
        result.write.mode("overwrite").json(a.out)
    finally:
        take.release()
    return 0


def _validate(take: Take, strict: bool, as_json: bool) -> int:
    rows = validate(take, strict).orderBy("take_id").toLocalIterator()
    code = None
    for r in rows:
        code = max(code or 0, r["exit_code"])
        print(r["report"] if as_json else r["summary"] or f"take `{r['take_id']}` could not be opened")
    if not as_json:
        for r in printable(take.diagnostics, ["take_id"], "line").toLocalIterator():
            print(f"{r['severity']}: {r['location']}: {r['text']}" if r["location"] else f"  {r['text']}")
    return 2 if code is None else code


def _render(take: Take, rasters: DataFrame, options: RenderOptions, out: str) -> None:
    """Frames below ``out``/frames, the report and a summary for each take; logs how fast it went."""
    began = time.perf_counter()
    done = compose.render(take, rasters, options)
    panes = take.settle(done.panes)
    write_frames(raster.side_by_side(panes), f"{out.rstrip('/')}/frames").write.mode("overwrite").parquet(f"{out}/files")
    report_json(done.report).write.mode("overwrite").json(f"{out}/report")
    summary = compose.throughput(compose.joined(compose.folded(panes)), time.perf_counter() - began)
    summary.write.mode("overwrite").json(f"{out}/summary")
    logging.getLogger("kinetrack").info("took %.2f s", time.perf_counter() - began)


if __name__ == "__main__":
    sys.exit(main())
