"""Facets kept as bitmaps of ids: and, or and counts by built-in functions on words of 32,768 ids.

A row is (facet, value, bucket, bitmap): the ids of one bucket that have the value,
4 KB at most, so a value that a third of all rows has is many rows and never one
group; a partial bitmap is made before the shuffle.  Rows of one value and bucket may
come several times (each ``add`` appends its own) and are united as they are read.
It suits facets of few values; a value of a handful of ids in each bucket takes a
bitmap there nonetheless, and a semi-join serves such facets better.

Rows without an id or a value are left out; repeated rows count once; an empty table
gives an empty index, in which nothing is found.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the ids of a bucket of Spark's bitmap functions.
IDS = 32_768


class BitmapFacets:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, edges: DataFrame, folder: str) -> BitmapFacets:
        """Of edges (facet, value, id), in a new folder, apart by facet."""
        out = cls(edges.sparkSession, folder)
        out._write(edges, "errorifexists")
        return out

    def add(self, edges: DataFrame) -> None:
        """Further ids of facets; what is there isn't read."""
        self._write(edges, "append")

    def _write(self, edges: DataFrame, mode: str) -> None:
        own = edges.select("facet", F.col("value").cast("string").alias("value"), F.col("id").cast("bigint").alias("id")).dropna()
        buckets = own.groupBy("facet", "value", F.bitmap_bucket_number("id").alias("bucket"))
        made = buckets.agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap"))
        made.write.mode(mode).partitionBy("facet").parquet(self.folder)

    def rows(self) -> DataFrame:
        schema = "value string, bucket bigint, bitmap binary, facet string"
        return self.spark.read.schema(schema).parquet(self.folder)

    def selected(self, asked: Mapping[str, Sequence[str]], every: bool = True) -> DataFrame:
        """bucket, bitmap of the ids that have one of the values of every asked facet (of any, if not ``every``); only those facets' folders are read."""
        if not asked:
            raise ValueError("name a facet at least")
        wanted = reduce(Column.__or__, ((F.col("facet") == f) & F.col("value").isin(*values) for f, values in asked.items()))
        rows = self.rows().where(wanted)
        if not every:
            return rows.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        each = rows.groupBy("bucket", "facet").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        both = each.groupBy("bucket").agg(F.count("*").alias("_n"), F.bitmap_and_agg("bitmap").alias("bitmap"))
        return both.where(F.col("_n") == len(asked)).select("bucket", "bitmap")

    def counts(self, among: DataFrame | None = None, facets: Sequence[str] | None = None) -> DataFrame:
        """facet, value, n: how many ids (of ``among``, bitmaps by bucket) have each value; values of none are left out."""
        rows = self.rows() if facets is None else self.rows().where(F.col("facet").isin(*facets))
        keys = ["facet", "value", "bucket"]
        rows = rows.groupBy(*keys).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        if among is not None:
            met = rows.join(among.select("bucket", F.col("bitmap").alias("_among")), "bucket")
            pairs = met.select(*keys, F.explode(F.array("bitmap", "_among")).alias("bitmap"))
            rows = pairs.groupBy(*keys).agg(F.bitmap_and_agg("bitmap").alias("bitmap"))
        return rows.groupBy("facet", "value").agg(F.sum(F.bitmap_count("bitmap")).alias("n")).where("n > 0")


def ids_of(selected: DataFrame) -> DataFrame:
    """id of each bit that is set in bitmaps by bucket."""
    byte = lambda i: F.conv(F.hex(F.substr("bitmap", i + 1, F.lit(1))), 16, 10).cast("int")
    places = F.sequence(F.lit(0), F.length("bitmap") - 1)
    some = F.filter(F.transform(places, lambda i: F.struct(i.alias("at"), byte(i).alias("bits"))), lambda x: x["bits"] != 0)
    bits = selected.select("bucket", F.inline(some)).select("bucket", "at", "bits", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    place = (F.col("at") * 8 + F.col("bit")).cast("bigint")
    after, before = (F.col("bucket") - 1) * IDS + 1 + place, F.col("bucket") * IDS - place
    return bits.where(F.expr("shiftright(bits, bit) & 1") == 1).select(F.when(F.col("bucket") > 0, after).otherwise(before).alias("id"))


def edges_of(rows: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """facet, value, id of some columns; blank values are none."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.inline(pairs), F.col(key).alias("id")).where(F.trim("value") != "")
