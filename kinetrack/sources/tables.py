"""Tables written to the folder that driver and executors share: plans start anew from them.

``spark.checkpoint.dir`` names the folder; where it is unset (tests, a laptop) a temporary one is made, in local
mode only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinetrack-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` for work that is heavier than its rows: into a number of tasks that is stated, since adaptive execution joins
    partitions by their bytes, and a small file would be worked on in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Tables:
    """What one owner has written; ``drop`` removes it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back: it is computed once, and later plans do not hold its lineage."""
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        for x in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.paths.clear()
