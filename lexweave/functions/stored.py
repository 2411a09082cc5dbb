"""Results that are written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as the session's spark.checkpoint.dir or its context names it.

    Where neither does, a session on one machine (master local) takes a folder of that machine; on a cluster that would lose rows, so it is an error.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    sc = spark.sparkContext
    if (current := sc._jsc.sc().getCheckpointDir()).isDefined():
        return current.get()
    if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/lexweave-{sc.applicationId}"


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, computed now and read from the shared folder from here on: what follows evaluates nothing of it again, and lost executors lose nothing of it."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
