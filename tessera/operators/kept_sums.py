"""Dashboards kept by deltas: counts, sums and histograms that a merge changes by what it opened and closed.

The state is a row for each combination of the dimensions: how many current versions
have it, and the sums of their measures.  A change adds a segment of signed rows (plus
for opened versions, minus for closed ones), aggregated before the shuffle, so what is
read follows the delta and not the table; a value that is a dimension is a histogram,
from which ``median_of`` takes an exact median.  Segments and the names of batches are
kept in numbered commits: a batch that comes again changes nothing, and of two writers
the later one puts its segment on top of the other's, as sums don't depend on order.

Measures are whole numbers or decimals, as floats don't subtract to what they were; a
missing measure counts as zero.  A missing dimension is a value of its own.  Empty
changes and an empty table are allowed; combinations that nothing has any more are
left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import commits


def version_changes(versions: DataFrame, since: Column, until: Column) -> tuple[DataFrame, DataFrame]:
    """The versions that hold at ``until`` and didn't at ``since``, and those that held at since and don't any more; both bounds reach the scan."""
    holds = lambda at: (F.col("tx_from") <= at) & (F.col("tx_to").isNull() | (F.col("tx_to") > at))
    opened = versions.where((F.col("tx_from") > since) & holds(until))
    return opened, versions.where((F.col("tx_to") <= until) & holds(since))


class KeptSums:
    def __init__(self, spark: SparkSession, folder: str, dims: Sequence[str], sums: Sequence[str] = ()):
        self.spark, self.folder, self.dims, self.measures = spark, folder, list(dims), list(sums)

    @classmethod
    def build(cls, rows: DataFrame, folder: str, dims: Sequence[str], sums: Sequence[str] = ()) -> KeptSums:
        """Of the current rows, in a new folder."""
        out = cls(rows.sparkSession, folder, dims, sums)
        if not commits.put(out.spark, folder, 0, {"segments": [out._segment(out._signed(rows, 1))], "batches": []}):
            raise ValueError(f"{folder} is in use")
        return out

    def change(self, opened: DataFrame, closed: DataFrame, batch: str | None = None) -> bool:
        """Adds opened rows and takes closed ones away; False, and no change, where a batch of that name is in."""
        number, said = commits.latest(self.spark, self.folder)
        if batch is not None and batch in said["batches"]:
            return False
        made = self._segment(self._signed(opened, 1).unionByName(self._signed(closed, -1)))
        while True:
            batches = said["batches"] + ([] if batch is None else [batch])
            if commits.put(self.spark, self.folder, number + 1, {"segments": [*said["segments"], made], "batches": batches}):
                return True
            number, said = commits.latest(self.spark, self.folder)
            if batch is not None and batch in said["batches"]:
                return False

    def compact(self) -> None:
        """One segment in place of those there are; what others add meanwhile stays beside it."""
        number, said = commits.latest(self.spark, self.folder)
        old = said["segments"]
        made = self._segment(self._read(old))
        while not commits.put(self.spark, self.folder, number + 1, said | {"segments": [made, *(s for s in said["segments"] if s not in old)]}):
            number, said = commits.latest(self.spark, self.folder)
            if not set(old) <= set(said["segments"]):
                return  # another writer has compacted them

    def rows(self) -> DataFrame:
        """The dimensions with n and the measures' sums, as they are now."""
        return self._added(self._read(commits.latest(self.spark, self.folder)[1]["segments"])).where(F.col("n") > 0)

    def _signed(self, rows: DataFrame, sign: int) -> DataFrame:
        for name in self.measures:
            if not isinstance(rows.schema[name].dataType, (T.IntegralType, T.DecimalType)):
                raise ValueError(f"{name} is neither whole nor decimal")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast(rows.schema[c].dataType)) * sign
        return rows.select(*self.dims, F.lit(sign).cast("bigint").alias("n"), *(zero(c).cast(T.DecimalType(38, self._scale(rows, c))).alias(c) for c in self.measures))

    @staticmethod
    def _scale(rows: DataFrame, name: str) -> int:
        kind = rows.schema[name].dataType
        return kind.scale if isinstance(kind, T.DecimalType) else 0

    def _added(self, rows: DataFrame) -> DataFrame:
        total = lambda c: F.sum(c).cast(rows.schema[c].dataType).alias(c)
        return rows.groupBy(*self.dims).agg(F.sum("n").alias("n"), *map(total, self.measures))

    def _segment(self, signed: DataFrame) -> str:
        name = uuid.uuid4().hex
        self._added(signed).where(" OR ".join(f"`{c}` <> 0" for c in ["n", *self.measures])).write.parquet(f"{self.folder}/{name}")
        return name

    def _read(self, segments: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.folder}/{s}" for s in segments))


def median_of(value: str, n: str = "n") -> Column:
    """The exact median of a dimension's values by their counts."""
    return F.percentile(value, F.lit(0.5), F.col(n))
