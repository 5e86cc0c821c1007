"""Cutting lineage in the folder that a cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where none is set and all runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = folder or f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept where other executors can read it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in a new folder: for rounds of joins, as a checkpoint hands on its plan's constraints and sizes, which each round multiplies."""
    folder = new_folder(df.sparkSession, "rows")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
