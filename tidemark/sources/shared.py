"""The folder that driver and executors share, for tables between jobs and for the state of streams."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the context's checkpoint folder. Where
    both are unset, a session whose master is local (tests) gets a temporary one; on a cluster that is an error, since
    executors couldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        if checkpoint.isEmpty():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
            checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = checkpoint.get()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: its rows are fixed for all jobs that follow, and an executor that
    is lost costs its own tasks only."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
