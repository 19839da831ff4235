"""Telemetry as a stream (an extension: recordings are complete files elsewhere).

Lines that arrive in a folder are parsed as in ``kinetrack.sources.take`` and summed over event-time
windows with a watermark; ``aligned`` runs the batch as-of join on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinetrack.functions import variants as v
from kinetrack.operators.temporal import asof_nearest


def telemetry_stream(spark: SparkSession, folder: str) -> DataFrame:
    """t_host_ns, frame, dropped, event_time of JSON lines; bad lines come with a null t_host_ns."""
    doc = F.try_parse_json("value")
    rows = spark.readStream.text(folder).select(doc.alias("doc"))
    t = v.integer(F.col("doc"), "$.t_host_ns")
    return rows.select(t.alias("t_host_ns"), v.integer(F.col("doc"), "$.frame").alias("frame"), F.coalesce(v.boolean(F.col("doc"), "$.dropped"), F.lit(False)).alias("dropped"), F.timestamp_micros((t / 1000).cast("long")).alias("event_time"))


def rates(rows: DataFrame, window: str = "1 second", late: str = "2 seconds") -> DataFrame:
    """Records and dropped records of each window; rows later than the watermark are left out."""
    kept = rows.where("t_host_ns IS NOT NULL").withWatermark("event_time", late)
    return kept.groupBy(F.window("event_time", window)).agg(F.count(F.lit(1)).alias("records"), F.count_if("dropped").alias("dropped")).select(F.col("window.start").alias("start"), "records", "dropped")


def aligned(rows: DataFrame, right: DataFrame, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each micro-batch with the nearest row of a static table (t_host_ns, ...), given to ``write``."""

    def one(batch: DataFrame, epoch: int) -> None:
        write(asof_nearest(batch.where("t_host_ns IS NOT NULL"), right, "t_host_ns"), epoch)

    return rows.writeStream.foreachBatch(one).trigger(availableNow=True).start()
