"""Folders that the driver and all executors share, for lineage cuts and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _forget(spark: SparkSession, path: str) -> None:
    """Marks a folder for deletion at the end of the application."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(own)
    files.deleteOnExit(own)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(own, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the checkpoint folder that the application has set.

    The application's own checkpoints in it, which have a folder to themselves, go when it ends.

    Where neither is set, a new local folder stands in if the master is local (tests); on a cluster,
    whose executors would not see it, that is an error.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        _forget(spark, held.get())
    if where:
        return where
    if not held.isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docassay-"))
        held = context._jsc.sc().getCheckpointDir()
        _forget(spark, held.get())
    return held.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. Results are read from it later, so it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _forget(spark, path)
    return path
