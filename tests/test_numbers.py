import argparse

import pytest
from pyspark.sql import functions as F

from kinetrack.cli import size
from kinetrack.sources.media import rational, seconds_to_ns


def test_rational_and_seconds(spark):
    texts = [("30000/1001", 30000 / 1001), ("30", 30.0), ("2.5e1 fps", 25.0), ("1/0", 0.0), ("a/2", 0.0), ("", 0.0), ("N/A", 0.0), (None, None)]
    rows = spark.createDataFrame(texts, "text string, want double").select("text", "want", rational(F.col("text")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    rows = spark.createDataFrame([(0.1, 100_000_000), (-1.5e-9, -2), (None, None)], "s double, want long").select("want", seconds_to_ns(F.col("s")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_size():
    assert size("1280x720") == (1280, 720)
    for bad in ("1280", "0x5", "5x00", "-1x2", "1x2x3", "1 x2", "axb", "1X2"):
        with pytest.raises(argparse.ArgumentTypeError):
            size(bad)
