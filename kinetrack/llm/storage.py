"""Tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  Where it is unset (tests, a
laptop) a temporary folder is set for the session, in local mode only: a cluster without a
shared folder is refused.  ``scratch`` removes what a block has written but for one table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder; also makes sure that ``DataFrame.checkpoint`` works."""
    bounded_batches(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="kinetrack-"))
            folder = context.getCheckpointDir()
        return folder
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


#: Bytes of an Arrow batch that a task holds; texts are long, so Spark's default is lowered to this.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES from here on, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key).rstrip("bB"))
    except ValueError:
        return  # set by the user with a unit of its own
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


#: Paths given out since the innermost ``scratch`` began.
_given: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _given:
        _given[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A path to write the block's result to; every other table that the block has written goes at its end."""
    path = fresh_path(spark, name)
    _given.append([])
    try:
        yield path
    finally:
        jvm = spark.sparkContext._jvm
        for x in _given.pop():
            place = jvm.org.apache.hadoop.fs.Path(x)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (for small tables that change in every round of an iteration)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
