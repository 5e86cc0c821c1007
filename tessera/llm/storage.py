"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import NULL_ID


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is unset and all runs on it, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = known or f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        if not known:
            spark.sparkContext.setCheckpointDir(folder)
    return folder


def removed(spark: SparkSession, folder: str) -> None:
    """Takes away a folder that these modules wrote and that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, where it outlives executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def apart(df: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """df with an id of its own in each row that has none, and the least of these.

    The rows without an id are written once, so that each keeps its own in every
    scan.  Their ids are the last ones before NULL_ID, and df's own are to be smaller.
    """
    own = df.withColumn(id_col, F.col(id_col).cast("bigint"))
    nulls = own.where(F.col(id_col).isNull())
    if nulls.isEmpty():
        return df, NULL_ID
    nulls = saved(nulls.withColumn(id_col, F.monotonically_increasing_id()))
    parts = nulls.agg(F.max(F.shiftright(id_col, 33))).first()[0] + 1
    row, part = F.col(id_col).bitwiseAND((1 << 33) - 1), F.shiftright(id_col, 33)
    nulls = nulls.withColumn(id_col, F.lit(NULL_ID - 1) - row * parts - part)
    least = nulls.agg(F.min(id_col)).first()[0]
    return own.where(F.col(id_col).isNotNull()).union(nulls), least


def given_id(least: int, id_col: str = "doc_id") -> Column:
    """The id as it was before apart()."""
    return F.when(F.col(id_col) < least, F.col(id_col)).alias(id_col)
