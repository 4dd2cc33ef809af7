"""Session settings the operators rely on."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Switch on what the plans count on: adaptive execution with coalescing and skew splitting."""
    for key, value in (
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
        ("spark.sql.adaptive.coalescePartitions.enabled", "true"),
        ("spark.sql.execution.arrow.pyspark.enabled", "true"),
    ):
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in `spark.checkpoint.dir`, or has set the context's own. A
    temporary folder is made on a single machine only; elsewhere a missing setting
    is an error, since executors could not read each other's files.
    """
    context = spark.sparkContext
    # files of frames nobody refers to any more are removed
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    current = context.getCheckpointDir()
    if current is not None:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spindrel-checkpoint-")
    context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut(df: DataFrame, rounds: bool = False) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; survives the loss of executors.

    A checkpointed frame remembers its size as estimated, the product of what was
    joined. With `rounds`, for frames that go through a loop, that is forgotten,
    since it would grow to numbers of millions of digits.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    if not rounds:
        return done
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """A table of the frame's rows in the shared folder for the time of a `with` block: columns are packed, and what is read of it is pruned; it is removed at the end, so whatever uses it must be settled by then."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints that no frame refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
