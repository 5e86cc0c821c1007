"""Seeded rows for fixtures: weighted categories by hash, and deltas of a table. Equal seeds give equal rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(key: Column, name: str, seed: int) -> Column:
    """A number from 0 up to 1 (of 2**32) that depends on the key, a name and the seed."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(name), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def weighted(u: Column, weights: dict[str, float]) -> Column:
    """The category in whose share a number from 0 to 1 falls, in the given order."""
    total, until, out = sum(weights.values()), 0.0, None
    for name, weight in weights.items():
        until += weight / total
        out = F.when(u < until, name) if out is None else out.when(u < until, name)
    return out.otherwise(list(weights)[-1])


def labelled(rows: DataFrame, key: str, profile: dict[str, dict[str, float]], seed: int = 0) -> DataFrame:
    """rows with a column for each category of a profile, which depends on the key alone."""
    return rows.withColumns({name: weighted(draw(F.col(key), name, seed), weights) for name, weights in profile.items()})


def generated(spark: SparkSession, n: int, profile: dict[str, dict[str, float]], seed: int = 0) -> DataFrame:
    """id from 0 and a column for each category of a profile."""
    return labelled(spark.range(n), "id", profile, seed)


def delta(rows: DataFrame, key: str, column: str, changed: float, gone: float, new: float, seed: int = 0, shift: int = 1 << 40) -> DataFrame:
    """rows as a later dump would have them: shares of them gone, changed in a column (a mark is added), and copied under new ids."""
    u, v = draw(F.col(key), "fate", seed), draw(F.col(key), "copy", seed)
    stay = rows.where(u >= gone)
    out = stay.withColumn(column, F.when(u < gone + changed, F.concat(F.col(column).cast("string"), F.lit("*"))).otherwise(F.col(column)))
    copies = rows.where(v < new).withColumn(key, (F.col(key) + shift).cast(rows.schema[key].dataType))
    return out.unionByName(copies)
