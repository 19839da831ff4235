"""Time-series alignment: nearest, backward and bracketing as-of joins, interpolation, clock maps.

All times are LONG nanoseconds.  Every operator takes partition keys (``by``: takes, users, cameras).
A group with a lot of rows can be cut into time buckets (``bucket_ns``): rows are windowed within a
bucket, and the last row before and the first row after each bucket - one small row for each
bucket - are carried in, so that no window holds a whole track.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NS = 1_000_000_000


def _div(a: Column, b: int | Column) -> Column:
    """Integer division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def neighbours(
    left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, right_on: str | None = None, order: str | None = None,
    below_equal: bool = False, above_equal: bool = True, bucket_ns: int | None = None,
) -> DataFrame:
    """``left`` with structs ``below`` and ``above``: the right rows next to each left time (null where there is none).

    ``below_equal`` / ``above_equal`` tell whether a right row at exactly that time counts as below or
    above.  ``order`` (a column of ``right``) decides between right rows of equal time: the last of them
    is below, the first of them above.
    """
    by, right_on = by or [], right_on or on
    keys = [F.col(k) for k in by]
    r = F.struct(*[F.col(c) for c in right.columns])
    rank = F.col(order) if order else F.lit(0).cast("long")
    rows_r = right.where(F.col(right_on).isNotNull()).select(*keys, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), rank.cast("long").alias("_i"), r.alias("_r"), F.lit(None).cast(left.schema).alias("_l"))
    rows_l = left.select(*keys, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_i"), F.lit(None).cast(right.schema).alias("_r"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    part = list(by)
    if bucket_ns:
        part = [*by, "_b"]
        bucket = F.when(F.col("_t").isNull(), F.lit(0).cast("long")).otherwise(_div(F.col("_t") - F.pmod("_t", F.lit(bucket_ns)), bucket_ns))
        rows_r, rows_l = rows_r.withColumn("_b", bucket), rows_l.withColumn("_b", bucket)
        edge = rows_r.groupBy(*part).agg(F.min_by(F.struct("_t", "_i", "_r"), F.struct("_t", "_i")).alias("first"), F.max_by(F.struct("_t", "_i", "_r"), F.struct("_t", "_i")).alias("last"))
        asked = rows_l.select(*part).distinct().withColumn("asked", F.lit(True))
        both = edge.join(asked, part, "full") if part else edge
        ahead = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        behind = Window.partitionBy(*by).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = both.select(*part, "asked", F.last("last", True).over(ahead).alias("p"), F.last("first", True).over(behind).alias("n")).where("asked")
        for c in ("p", "n"):
            rows_r = rows_r.unionByName(carried.where(F.col(c).isNotNull()).select(*part, F.col(f"{c}._t").alias("_t"), F.lit(0).alias("_side"), F.col(f"{c}._i").alias("_i"), F.col(f"{c}._r").alias("_r"), F.lit(None).cast(left.schema).alias("_l")))
    rows = rows_r.unionByName(rows_l)
    side = F.col("_side")
    up = Window.partitionBy(*part).orderBy("_t", side.asc() if below_equal else side.desc(), "_i").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*part).orderBy(F.col("_t").desc(), side.asc() if above_equal else side.desc(), F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("below", F.last("_r", True).over(up)).withColumn("above", F.last("_r", True).over(down))
    return found.where("_side = 1").select("_l.*", "below", "above")


def asof_nearest(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, right_on: str | None = None, order: str | None = None, bucket_ns: int | None = None) -> DataFrame:
    """``left`` with a struct ``match``: the right row nearest in time; the earlier of two at equal distance."""
    t = right_on or on
    near = neighbours(left, right, on, by, right_on, order, False, True, bucket_ns)
    below, above = F.col("below"), F.col("above")
    take = below.isNull() | (above.isNotNull() & (above[t] - F.col(on) < F.col(on) - below[t]))
    return near.withColumn("match", F.when(take, above).otherwise(below)).drop("below", "above")


def asof_backward(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, right_on: str | None = None, order: str | None = None, bucket_ns: int | None = None) -> DataFrame:
    """``left`` with a struct ``match``: the last right row at or before each time; null before the first."""
    return neighbours(left, right, on, by, right_on, order, True, True, bucket_ns).withColumn("match", F.col("below")).drop("below", "above")


def bracketed(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, right_on: str | None = None, order: str | None = None, bucket_ns: int | None = None) -> DataFrame:
    """``left`` with ``below`` (last right row at or before), ``above`` (first after) and the fraction ``u`` between.

    At and beyond the ends both are the end row and ``u`` is 0.
    """
    t = right_on or on
    near = neighbours(left, right, on, by, right_on, order, True, False, bucket_ns)
    lo, hi = F.coalesce("below", "above"), F.coalesce("above", "below")
    span = hi[t] - lo[t]
    u = F.when((span > 0) & F.col("below").isNotNull(), (F.col(on) - lo[t]).cast("double") / span).otherwise(0.0)
    return near.select(*left.columns, lo.alias("below"), hi.alias("above"), u.alias("u"))


def llround(x: Column) -> Column:
    """Half away from zero, to long."""
    return F.round(x).cast("long")


def interpolated_offset(below: Column, above: Column, u: Column, offset: str = "offset_ns") -> Column:
    """Clock offset between two samples, rounded to nanoseconds."""
    return below[offset] + llround(u * (above[offset] - below[offset]).cast("double"))


def offset_at_host(left: DataFrame, clock: DataFrame, on: str, by: list[str] | None = None, out: str = "offset_ns", bucket_ns: int | None = None) -> DataFrame:
    """Adds the clock offset at host times (held outside the sampled span, 0 without samples).

    clock: t_host_ns, offset_ns (and keys).  Of samples with equal time the last is the left end of the
    interval that follows; before the first time it is the first sample's.
    """
    own = clock.select(*(by or []), F.col("t_host_ns").alias("_ct"), F.col("offset_ns").alias("_off"))
    rows = bracketed(left, own, on, by, "_ct", None, bucket_ns)
    value = F.coalesce(interpolated_offset(F.col("below"), F.col("above"), F.col("u"), "_off"), F.lit(0).cast("long"))
    return rows.withColumn(out, value).drop("below", "above", "u")


def device_from_host(left: DataFrame, clock: DataFrame, on: str, by: list[str] | None = None, out: str = "t_device_ns") -> DataFrame:
    return offset_at_host(left, clock, on, by, "_offset").withColumn(out, F.col(on) + F.col("_offset")).drop("_offset")


def to_host(left: DataFrame, clock: DataFrame, on: str, by: list[str] | None = None, out: str = "t_host_ns", rounds: int = 4, bucket_ns: int | None = None) -> DataFrame:
    """Adds the host time of device times: the inverse of t + offset(t), by bracketing.

    ``clock`` (t_host_ns, offset_ns and keys) maps onto device time in order where offsets change by less than
    the time between samples, so the samples that enclose a device time are found like any neighbours: one
    shuffle, and no series goes along with a row.  Between them the inverse of the line is the seed of a
    few fixed-point rounds, which settle the rounding to nanoseconds.  Outside of the span the offset is held;
    without samples both clocks are one.
    """
    own = clock.select(*(by or []), (F.col("t_host_ns") + F.col("offset_ns")).alias("_cd"), F.col("t_host_ns").alias("t"), F.col("offset_ns").alias("o"))
    rows = bracketed(left, own, on, by, "_cd", "t", bucket_ns)
    device, a, b = F.col(on), F.col("below"), F.col("above")
    line = lambda h: a["o"] + llround((h - a["t"]).cast("double") / (b["t"] - a["t"]) * (b["o"] - a["o"]).cast("double"))
    seed = F.when(b["t"] > a["t"], a["t"] + llround((device - a["_cd"]).cast("double") * ((b["t"] - a["t"]).cast("double") / (b["_cd"] - a["_cd"])))).otherwise(device - a["o"])
    rows = rows.withColumn("_h", seed)
    inside = (b["t"] > a["t"]) & (device >= a["_cd"])
    for _ in range(rounds):
        rows = rows.withColumn("_h", F.when(inside, device - line(F.col("_h"))).otherwise(F.col("_h")))
    return rows.withColumn(out, F.coalesce("_h", device)).drop("_h", "below", "above", "u")


def capture_ns(t_xr: Column, t_device: Column, exposure: Column) -> Column:
    """Middle of the exposure: the stamp is its start."""
    return F.coalesce(t_xr, t_device) + F.call_function("div", exposure, F.lit(2))


def output_instant(t0: Column, k: Column, fps: Column) -> Column:
    """Host time of output frame k of a constant-rate timeline."""
    return t0 + llround(k.cast("double") * 1e9 / fps)


def frame_count(span_ns: Column, fps: Column) -> Column:
    return F.when(span_ns > 0, F.floor(span_ns.cast("double") * 1e-9 * fps + 1e-6).cast("long") + 1).otherwise(F.lit(1).cast("long"))


#: Numbers that one row unfolds into.
RUN = 1 << 16


def counted(rows: DataFrame, count: str, out: str = "k") -> DataFrame:
    """Each row once for each number from 0 to ``count`` - 1 (a LONG column) as ``out``.

    A row first gives its runs of RUN numbers; these are dealt out among tasks and unfolded there, so a count of any size
    is no array and no work of one task.
    """
    last = F.col(count) - 1
    runs = rows.where(F.col(count) > 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(RUN).cast("long"))))
    dealt = runs.repartition(F.xxhash64(*[F.col(c) for c, kind in rows.dtypes if "map" not in kind and "variant" not in kind], "_from"))
    return dealt.withColumn(out, F.explode(F.sequence(F.col("_from"), F.least(last, F.col("_from") + RUN - 1)))).drop("_from")


def grid(spans: DataFrame, fps: float | Column, by: list[str] | None = None) -> DataFrame:
    """Instants k, t_ns of a constant-rate grid over each row's [first_ns, last_ns]."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    frames = frame_count(F.col("last_ns") - F.col("first_ns"), rate)
    rows = counted(spans.select(*(by or []), "first_ns", rate.alias("_fps"), frames.alias("_n")), "_n")
    return rows.select(*(by or []), "k", output_instant(F.col("first_ns"), F.col("k"), F.col("_fps")).alias("t_ns"))


def segment_begin(n: Column, index: Column, count: Column) -> Column:
    base, rest = F.call_function("div", n, count), n % count
    return F.when(index >= count, n).otherwise(index * base + F.least(index, rest))


def segment_range(n: Column, index: Column, count: Column) -> Column:
    """struct (begin, end) of one of ``count`` runs that tile n frames, sizes differing by one at most."""
    whole = F.struct(F.lit(0).cast("long").alias("begin"), n.cast("long").alias("end"))
    some = F.struct(segment_begin(n, index, count).cast("long").alias("begin"), segment_begin(n, index + 1, count).cast("long").alias("end"))
    return F.when((count <= 1) | (index < 0), whole).otherwise(some)


def segment_of(index: Column, n: Column, count: Column) -> Column:
    """The run (see ``segment_range``) that frame ``index`` lies in: the first n % count runs have one frame more."""
    base, rest = F.call_function("div", n, count), n % count
    wide = rest * (base + 1)
    late = rest + F.call_function("div", index - wide, F.greatest(base, F.lit(1).cast("long")))
    return F.when(index < wide, F.call_function("div", index, base + 1)).otherwise(late).cast("long")


def renamed(keyed: DataFrame, by: list[str]) -> tuple[DataFrame, Column]:
    """``keyed`` with its keys renamed, and the condition that a row with the keys ``by`` meets it (null keys too)."""
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by], F.lit(True))
    return keyed.select(*[F.col(k).alias(f"_of_{k}") for k in by], *[c for c in keyed.columns if c not in by]), on


def running(df: DataFrame, order: list[str], by: list[str], block: int, number: str | None = "n", before: dict[str, str] | None = None) -> DataFrame:
    """Adds the row's place (from 0) in its group as ``number``, and values of the row before it: ``before`` maps new names to columns.

    A parallel prefix: the first of ``order`` (a LONG) is cut into blocks of the width ``block``; each block gives its count
    and its last row, these few rows are scanned, and rows are windowed within a block.  No window holds a group, so a
    group may be of any size.  Rows whose first ``order`` is null come first, as a block of their own.
    """
    before = before or {}
    first, keys = F.col(order[0]).cast("long"), [F.col(k) for k in by]
    rows = df.withColumn("_block", F.when(first.isNotNull(), _div(first - F.pmod(first, F.lit(block)), block)))
    last = F.struct(*[F.col(c).alias(k) for k, c in before.items()], F.lit(0).alias("_"))
    ends = rows.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_rows"), F.max_by(last, F.struct(*order)).alias("_last"))
    scan = Window.partitionBy(*by).orderBy("_block")
    ends = ends.select(*keys, "_block", (F.sum("_rows").over(scan) - F.col("_rows")).alias("_begin"), F.lag("_last").over(scan).alias("_carried"))
    ends, on = renamed(ends, [*by, "_block"])
    within = Window.partitionBy(*by, "_block").orderBy(*order)
    place = F.row_number().over(within)
    found = rows.join(ends, on)
    if before:
        own = F.lag(F.struct(*[F.col(c).alias(k) for k, c in before.items()])).over(within)
        found = found.withColumn("_place", place).withColumn("_own", own)
        found = found.withColumns({k: F.when(F.col("_place") > 1, F.col(f"_own.{k}")).otherwise(F.col(f"_carried.{k}")) for k in before})
    else:
        found = found.withColumn("_place", place)
    added = [*([(F.col("_begin") + F.col("_place") - 1).cast("long").alias(number)] if number else []), *before]
    return found.select(*df.columns, *added)


def ordinal(df: DataFrame, order: str, by: list[str] | None = None, out: str = "n", block: int | None = None) -> DataFrame:
    """Adds the row's place (from 0) in its group.  ``block``, a width of ``order`` (a LONG), is for groups of any size (see ``running``)."""
    if block:
        return running(df, [order], by or [], block, out)
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*(by or [])).orderBy(order)) - 1).cast("long"))


def changes(rows: DataFrame, value: str, order: str, by: list[str] | None = None, block: int = 1024) -> DataFrame:
    """The rows whose value is not that of the row before (numbered from 0 without gaps by ``order``): where a source is read anew.

    Rows are windowed in blocks of ``order``; the last row of each block goes to the next one.
    """
    keys, at = by or [], _div(F.col(order), block)
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    last = rows.where(F.col(order) % block == block - 1).select(*keys, (at + 1).alias("_block"), F.struct(F.col(value).alias("v")).alias("_carried"))
    found = rows.withColumn("_block", at).withColumn("_before", F.lag(F.struct(F.col(value).alias("v"))).over(w)).join(last, [*keys, "_block"], "left")
    before = F.when(F.col(order) % block == 0, F.col("_carried")).otherwise(F.col("_before"))
    return found.where(before.isNull() | ~before["v"].eqNullSafe(F.col(value))).select(*rows.columns)


def phase_error(stamps: DataFrame, on: str, order: str, by: list[str], block: int | None = None) -> DataFrame:
    """For each group of two stamps or more: n, the measured rate fps, and how far (``worst_ms``, ``mean_ms``) its stamps are from a grid of that rate."""
    rate = stamps.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(on).alias("_t0"), F.max(on).alias("_t1")).where((F.col("n") > 1) & (F.col("_t1") > F.col("_t0")))
    rate = rate.withColumn("fps", (F.col("n") - 1).cast("double") * 1e9 / (F.col("_t1") - F.col("_t0")))
    placed = ordinal(stamps.select(*by, on, order), order, by, "_i", block).join(rate, by)
    error = F.abs((F.col(on) - F.col("_t0")).cast("double") - F.col("_i").cast("double") * 1e9 / F.col("fps")) * 1e-6
    return placed.groupBy(*by).agg(F.max("n").alias("n"), F.max("fps").alias("fps"), F.max(error).alias("worst_ms"), F.avg(error).alias("mean_ms"))


def overlaps(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """Whether two closed spans of time have an instant in common."""
    return ~((a_last < b_first) | (a_first > b_last))


def decimated(k: Column, rate: float | Column, of: float | Column) -> Column:
    """Whether record k of a track at rate ``of`` is one at which a slower source ticks: the first, and each where its count goes up."""
    rate, of = (x if isinstance(x, Column) else F.lit(x) for x in (rate, of))
    tick = lambda i: F.floor(i.cast("double") * rate / of)
    return (k == 0) | (tick(k) > tick(k - 1))


def without_two(df: DataFrame, place: str, by: list[str], least: int = 12) -> DataFrame:
    """A group's rows (``place`` counts them from 0) but for those a third and two thirds through; groups under ``least`` rows keep all."""
    n, same = renamed(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    third = _div(F.col("_n"), 3)
    twice = _div(2 * F.col("_n"), 3)
    return df.join(n, same).where((F.col("_n") < least) | ((F.col(place) != third) & (F.col(place) != twice))).select(*df.columns)


def advances(df: DataFrame, value: str, order: str, by: list[str], block: int, out: str = "advances") -> DataFrame:
    """Adds whether a value is greater than the row's before, which is so where there is none (``block``: see ``running``)."""
    rows = running(df, [order], by, block, None, {"_before": value})
    return rows.withColumn(out, F.coalesce(F.col(value) > F.col("_before"), F.lit(True))).drop("_before")
