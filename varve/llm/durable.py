"""Cutting lineage so that a lost executor costs a reread, not a recomputation."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.session import shared_folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder (``shared_folder`` if none is set) and reread.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes what
    it wrote once nothing refers to it.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints that nothing refers to any more; else they wait for the driver to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def bounded(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """A narrow ``df`` of fixed-size rows, made durable, and whether it is known to have at most ``most`` rows; if so it is broadcast."""
    kept = durable(df)
    few = kept.limit(most + 1).count() <= most
    return (F.broadcast(kept) if few else kept), few


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that is no longer needed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
