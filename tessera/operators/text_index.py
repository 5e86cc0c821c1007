"""An inverted index that is kept: postings by term with block maxima, kept up to date by segments.

A posting row is of a term, a field and a block of ``1 << BLOCK_BITS`` neighbouring keys:
the keys that have the term, how often, and the greatest weight among them.  Rows are in
a folder for each bucket of terms, ordered by term, so that a search opens its terms'
buckets and skips other terms' row groups.  A search first reads the maxima alone: they
bound each block's best score.  The blocks with the best bounds give a k-th score, and
of the others only those whose bound reaches it are read.

Changed rows are written as a segment of their own with the keys that it replaces or
takes away; postings of older segments don't count for these keys.  ``compact`` writes all
that counts as one segment.  Commits are numbered (see commits), so two writers can't
both be next.

A null key isn't indexed; null fields have no terms; a search without terms finds
nothing; keys are longs.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources import commits
from ..sources.shared import saved
from .search import STOP_WORDS, among, ranked

BLOCK_BITS, BUCKETS = 10, 64
POSTINGS = "term string, field string, block long, keys array<struct<key: bigint, tf: bigint>>, most double, bucket int"
#: Scores are rounded to six decimals.
SLACK = 2e-6


class TextIndex:
    """A kept index; ``build`` writes one, the constructor opens it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        last = commits.latest(spark, folder)
        if last is None:
            raise FileNotFoundError(f"no index in {folder}")
        self.number, said = last
        self.segments, self.fields, self.buckets = said["segments"], said["fields"], said["buckets"]

    @classmethod
    def build(cls, rows: DataFrame, key: str, fields: Sequence[str], folder: str, buckets: int = BUCKETS) -> TextIndex:
        made = cls.__new__(cls)
        made.spark, made.folder, made.number, made.segments, made.fields, made.buckets = rows.sparkSession, folder, -1, [], list(fields), buckets
        made._commit([made._written(made._inverted(rows, key), None)])
        return made

    def _inverted(self, rows: DataFrame, key: str) -> DataFrame:
        """key, field, term, tf; texts are dealt out by block of keys before they are split, so that words are counted, and blocks made, where they are."""
        block = F.shiftright(F.col("key").cast("long"), BLOCK_BITS)
        dealt = rows.select(F.col(key).alias("key"), *self.fields).withColumn("block", block).repartition("block")
        each = dealt.select("block", "key", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f), STOP_WORDS).alias("terms")) for f in self.fields))))
        return each.select("block", "key", "field", F.explode("terms").alias("term")).groupBy("block", "key", "field", "term").agg(F.count("*").alias("tf"))

    def _commit(self, segments: list[str]) -> None:
        said = {"segments": segments, "fields": self.fields, "buckets": self.buckets}
        if not commits.put(self.spark, self.folder, self.number + 1, said):
            raise RuntimeError("another writer was first; open the index again")
        self.number, self.segments = self.number + 1, segments

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def _written(self, index: DataFrame, keys: DataFrame | None) -> str:
        """Writes (block, key, field, term, tf) as a segment, and the keys whose older postings don't count."""
        name = uuid.uuid4().hex
        entry = F.struct(F.col("key").cast("long").alias("key"), "tf")
        rows = index.where("key IS NOT NULL").groupBy("block", "term", "field").agg(F.sort_array(F.collect_list(entry)).alias("keys"), F.max(1 + F.log("tf")).alias("most"))
        rows = rows.withColumn("bucket", self._bucket()).repartition("bucket", F.pmod("block", F.lit(8)))  # a common term's blocks are several tasks'
        rows.sortWithinPartitions("bucket", "term", "field", "block").write.partitionBy("bucket").parquet(f"{self.folder}/postings/{name}")
        if keys is not None:
            keys.select(F.col("key").cast("long").alias("key")).where("key IS NOT NULL").distinct().write.parquet(f"{self.folder}/keys/{name}")
        return name

    def _each(self, kind: str, schema: str, names: list[str], first: int) -> DataFrame:
        out = None
        for i, name in enumerate(names, first):
            part = self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}/{name}").withColumn("segment", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out

    def _postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        rows = self._each("postings", POSTINGS, self.segments, 0)
        if terms is None:
            return rows
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        mine = [r[0] for r in asked.select(self._bucket()).distinct().collect()]
        return rows.where(F.col("bucket").isin(*mine) & F.col("term").isin(*terms))

    def _counting(self, rows: DataFrame) -> DataFrame:
        """rows (key, segment, ...) but for those that a later segment replaces."""
        if len(self.segments) == 1:
            return rows
        last = self._each("keys", "key long", self.segments[1:], 1).groupBy("key").agg(F.max("segment").alias("_last"))
        return rows.join(last, "key", "left").where("_last IS NULL OR _last <= segment").drop("_last")

    def postings(self) -> DataFrame:
        """key, field, term, tf of all rows that count."""
        each = self._postings().select("segment", "field", "term", F.inline("keys"))
        return self._counting(each).select("key", "field", "term", "tf")

    def update(self, changed: DataFrame, key: str, gone: DataFrame | None = None) -> None:
        """Rows of changed replace the postings of their keys; keys of ``gone`` (key) have none any more."""
        changed = saved(changed.select(key, *self.fields))
        keys = changed.select(F.col(key).alias("key"))
        keys = keys if gone is None else keys.union(gone.select(F.col(key).alias("key")))
        self._commit([*self.segments, self._written(self._inverted(changed, key), keys)])

    def compact(self) -> None:
        """All that counts as one segment; the older ones stay for whoever reads an older commit."""
        self._commit([self._written(self.postings().withColumn("block", F.shiftright("key", BLOCK_BITS)), None)])

    def search(self, query: str, limit: int = 2000, weights: dict[str, float] | None = None, candidates: DataFrame | None = None, key: str = "key") -> tuple[DataFrame, DataFrame]:
        """key, score, rank of the best rows with all terms of the query in one field; and a row with the blocks that hold such rows and those read.

        score: over these fields, weight times the sum of 1 + ln(tf).  Only candidates (with ``key``) are ranked.
        """
        terms = sorted(set(query.lower().split()) - set(STOP_WORDS))
        if not terms:
            return self.spark.createDataFrame([], f"{key} long, score double, rank int"), self.spark.createDataFrame([(0, 0)], "blocks long, read long")
        weight = F.lit(0.0)
        for f in self.fields:
            weight = F.when(F.col("field") == f, F.lit(float((weights or {}).get(f, 1.0)))).otherwise(weight)
        mine = self._postings(terms)
        whole = mine.groupBy("segment", "block", "field").agg(F.count("*").alias("n"), F.sum("most").alias("s")).where(F.col("n") == len(terms))
        bounds = saved(whole.groupBy("segment", "block").agg(F.sum(F.col("s") * weight).alias("bound")))

        def scores(blocks: DataFrame) -> DataFrame:
            each = mine.join(blocks.select("segment", "block"), ["segment", "block"], "left_semi").select("segment", "field", F.inline("keys"))
            hits = self._counting(each).groupBy("key", "field").agg(F.count("*").alias("n"), F.sum(1 + F.log("tf")).alias("s")).where(F.col("n") == len(terms))
            found = hits.groupBy("key").agg(F.round(F.sum(F.col("s") * weight), 6).alias("score")).withColumnRenamed("key", key)
            return among(found, key, candidates)

        begin = saved(bounds.orderBy(F.desc("bound"), "segment", "block").limit(8 + (2 * limit >> BLOCK_BITS)))
        first = saved(scores(F.broadcast(begin)))  # as many blocks as hold twice the limit
        least = first.orderBy(F.desc("score"), key).limit(limit).agg(F.when(F.count("*") == limit, F.min("score"))).first()[0]
        rest = bounds.join(F.broadcast(begin.select("segment", "block")), ["segment", "block"], "left_anti")
        rest = rest if least is None else rest.where(F.col("bound") >= least - SLACK)
        out = ranked(first.unionByName(scores(rest)), key, limit)
        read = begin.select("block").unionAll(rest.select("block")).agg(F.count("*").alias("read"))
        return out, bounds.agg(F.count("*").alias("blocks")).crossJoin(F.broadcast(read))  # one row each
