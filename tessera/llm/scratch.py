"""Shared scratch space and lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tessera-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into reliable storage, so that its parts are stable and survive lost executors.

    The stored parts go when nothing refers to the frame any more.
    """
    shared_dir(df.sparkSession)
    df.sparkSession.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``fresh_path`` named."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files, and the stored parts, of frames that nothing refers to any more.

    It does so only when the driver collects its garbage, which may be long after a ``cut`` has replaced them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int, bound: int):
    """A broadcast hint for ``df`` only where its counted ``rows`` keep within ``bound``."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= bound else df
