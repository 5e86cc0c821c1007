"""Profiles of payload fields and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import dot


def unpivoted(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return rows.select(key, F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))))


def profile(fields: DataFrame) -> DataFrame:
    """total, coverage, null_pct, empty_pct and distinct_values of each field."""
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 2)
    empty = F.coalesce(F.col("value") == "", F.lit(False))
    return fields.groupBy("field").agg(F.count("*").alias("total"), pct(F.col("value").isNotNull()).alias("coverage"), pct(F.col("value").isNull()).alias("null_pct"), pct(empty).alias("empty_pct"), F.count_distinct("value").alias("distinct_values"))


def top_values(fields: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each field, with their share; a task passes on k rows of a field."""
    counts = fields.where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    most = counts.withColumn("_rn", rank).where(F.col("_rn") <= k).drop("_rn")
    total = fields.where(F.col("value").isNotNull()).groupBy("field").agg(F.count("*").alias("_all"))
    return most.join(total, "field").select("field", "value", "n", F.round(100.0 * F.col("n") / F.col("_all"), 2).alias("pct"))


def vector_profile(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    norms = vectors.select(F.sqrt(dot(F.col(column), F.col(column))).alias("norm"), F.size(column).alias("dim"))
    quantiles = [F.round(F.percentile("norm", F.lit(p)), 6).alias(f"p{round(p * 100):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)]
    return norms.agg(F.count("*").alias("total"), F.count_if(F.col("norm").isNull()).alias("missing"), F.count_if(F.col("dim") != dim).alias("wrong_dim"), F.count_if(F.col("norm") == 0).alias("zero"), *quantiles)


def precision(rows: DataFrame, exact: str, found: str, k: int) -> DataFrame:
    """mean and deviation of the share of the k exact results that were found."""
    share = F.size(F.array_intersect(exact, F.coalesce(found, F.array().cast(rows.schema[exact].dataType)))) / F.least(F.lit(k), F.size(exact))
    return rows.agg(F.count("*").alias("queries"), F.round(F.avg(share), 4).alias("mean"), F.round(F.stddev_pop(share), 4).alias("deviation"))
