"""Version folders: named versions of a table, the pointer to the current one, and comparisons."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "number long, name string, at timestamp, tag string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, on any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def list_versions(spark: SparkSession, folder: str) -> DataFrame:
    """number, name, at, tag of each commit, oldest first; none where nothing has been written."""
    if not exists(spark, f"{folder}/pointer"):
        return spark.createDataFrame([], POINTER)
    return spark.read.schema(POINTER).parquet(f"{folder}/pointer").orderBy("number", "at")


def current(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """Number and name of the current version."""
    last = list_versions(spark, folder).orderBy(F.desc("number"), F.desc("at")).first()
    return None if last is None else (last.number, last.name)


def _point(spark: SparkSession, folder: str, number: int, name: str, tag: str | None = None) -> None:
    row = spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(name).alias("name"), F.current_timestamp().alias("at"), F.lit(tag).cast("string").alias("tag"))
    row.coalesce(1).write.mode("append").parquet(f"{folder}/pointer")


def tagged(spark: SparkSession, folder: str, tag: str) -> bool:
    """Whether a commit with a tag is there."""
    return not list_versions(spark, folder).where(F.col("tag") == tag).isEmpty()


def write_version(df: DataFrame, folder: str, tag: str | None = None) -> str:
    """Writes a version folder and then the pointer row, with its tag, that makes it the current one.

    Commits are in order of their number, one more than the last one's.  One writer at a time.
    """
    spark = df.sparkSession
    last = current(spark, folder)
    name = uuid.uuid4().hex
    df.write.parquet(f"{folder}/versions/{name}")
    _point(spark, folder, last[0] + 1 if last else 0, name, tag)
    return name


def read_version(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    if name is None:
        last = current(spark, folder)
        if last is None:
            raise FileNotFoundError(f"no version in {folder}")
        name = last[1]
    return spark.read.parquet(f"{folder}/versions/{name}")


def restore_version(spark: SparkSession, folder: str, name: str) -> None:
    """Makes an older version the current one again; later ones stay readable by name."""
    known = list_versions(spark, folder)
    if known.where(F.col("name") == name).isEmpty():
        raise ValueError(f"no version {name}")
    _point(spark, folder, known.agg(F.max("number")).first()[0] + 1, name)


def compare_versions(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: rows before and after, keys added, removed, changed (any other column, nulls as values) and unchanged, and the growth in per cent."""
    columns = [c for c in before.columns if c != key]
    pack = lambda df, name: df.select(key, F.struct(F.lit(1), *columns).alias(name))
    both = pack(before, "_a").join(pack(after, "_b"), key, "full_outer")
    had, has = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    same = had & has & F.col("_a").eqNullSafe(F.col("_b"))
    out = both.agg(
        F.count_if(had).alias("before"), F.count_if(has).alias("after"), F.count_if(~had).alias("added"), F.count_if(~has).alias("removed"),
        F.count_if(had & has & ~same).alias("changed"), F.count_if(same).alias("unchanged"))
    return out.withColumn("pct", F.when(F.col("before") > 0, F.round(100.0 * (F.col("after") - F.col("before")) / F.col("before"), 2)))


def seed_version(df: DataFrame, folder: str) -> bool:
    """Writes df as the first version; nothing where there is one already."""
    if current(df.sparkSession, folder) is not None:
        return False
    write_version(df, folder)
    return True


def compared_commits(spark: SparkSession, folder: str, first: str, second: str) -> DataFrame:
    """One row: the hours between two commits of a folder, and which of them is the later one."""
    at = {r.name: r.at for r in list_versions(spark, folder).where(F.col("name").isin(first, second)).collect()}
    hours = abs((at[second] - at[first]).total_seconds()) / 3600
    return spark.createDataFrame([(round(hours, 2), first if at[first] > at[second] else second)], "hours double, later string")
