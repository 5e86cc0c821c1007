"""Search for parts of texts in any case, by trigram postings and verification.

Posting rows are of a trigram of a lower-cased field and a block of rows: the keys that
have it.  They are in a folder for each bucket of trigrams, ordered, so a search opens
those of its pattern alone.  A pattern's pieces between wild cards (% any text, _ any character)
have to be in a field with all of their trigrams; the rows that pass are read from
the kept rows, blocks without one being skipped, and the pattern itself is tried on them.  A pattern
without a piece of three characters has every row as a candidate.

Fields are strings; a null field holds nothing; keys are any type and needn't be unique
(rows of equal keys are candidates together); rows with a null key aren't indexed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import saved

#: Keys are dealt to blocks of about this many rows, and trigrams to buckets.
BLOCK_ROWS, BUCKETS = 512, 64
#: Blocks that a filter on kept rows names; with more of them rows are joined.
NAMED = 256
GRAM = 3


def trigrams(text: Column) -> Column:
    """The different trigrams of a lower-cased text."""
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")

    def grams(cs: Column) -> Column:
        last = F.size(cs) - GRAM
        return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat(*(F.get(cs, i + k) for k in range(GRAM))))))

    return F.get(F.transform(F.array(chars), grams), F.lit(0))  # characters are a variable, made once for a text


def pattern_grams(pattern: str) -> list[str]:
    """Trigrams that a text has which a pattern with % and _ fits (a backslash before a character takes it as it is)."""
    pieces, own = [], ""
    for escaped, c in re.findall(r"(\\?)(.)", pattern.lower(), re.S):
        if not escaped and c in "%_":
            pieces, own = [*pieces, own], ""
        else:
            own += c
    return sorted({p[i : i + GRAM] for p in [*pieces, own] for i in range(len(p) - GRAM + 1)})


class SubstringIndex:
    """A kept index: ``build`` writes one, the constructor opens it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        said = spark.read.parquet(f"{folder}/about").first()
        self.key, self.fields, self.blocks, self.buckets, self.kind = said.key, list(said.fields), said.blocks, said.buckets, said.kind

    @classmethod
    def build(cls, rows: DataFrame, key: str, fields: Sequence[str], folder: str, buckets: int = BUCKETS) -> SubstringIndex:
        """Writes rows with all their columns, and the postings of fields."""
        spark = rows.sparkSession
        blocks = max(1, -(-rows.count() // BLOCK_ROWS))
        spark.createDataFrame([(key, list(fields), blocks, buckets, rows.schema[key].dataType.simpleString())], "key string, fields array<string>, blocks int, buckets int, kind string").coalesce(1).write.parquet(f"{folder}/about")
        held = rows.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"), F.struct(*rows.columns).alias("row"))
        held.repartitionByRange("_block").sortWithinPartitions("_block").write.parquet(f"{folder}/rows")
        # read again by whole blocks: a trigram's keys in a block are met in one task, so only whole postings are sent on
        back = spark.read.parquet(f"{folder}/rows").select("_block", F.col(f"row.{key}").alias("key"), *(F.col(f"row.{f}").alias(f"f{i}") for i, f in enumerate(fields))).repartition("_block")
        each = back.select("_block", "key", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), trigrams(F.col(f"f{i}")).alias("grams")) for i, f in enumerate(fields)))))
        posts = each.select("_block", "key", "field", F.explode("grams").alias("gram")).groupBy("gram", "field", "_block").agg(F.collect_set("key").alias("keys"))
        posts = posts.withColumn("bucket", cls._bucket(buckets)).repartition("bucket", F.pmod("_block", F.lit(8))).sortWithinPartitions("bucket", "gram", "field", "_block")
        posts.write.partitionBy("bucket").parquet(f"{folder}/postings")
        return cls(spark, folder)

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")

    def postings(self, grams: Sequence[str]) -> DataFrame:
        """Postings of some trigrams: their buckets alone are opened."""
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        mine = [r[0] for r in asked.select(self._bucket(self.buckets)).distinct().collect()]
        schema = f"gram string, field string, _block int, keys array<{self.kind}>, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/postings").where(F.col("bucket").isin(*mine) & F.col("gram").isin(*grams))

    def candidates(self, pattern: str, fields: Sequence[str] | None = None) -> DataFrame | None:
        """_block, key of rows with all trigrams of a pattern in one field; None where the pattern has none."""
        grams = pattern_grams(pattern)
        if not grams:
            return None
        hits = self.postings(grams).where(F.col("field").isin(*(fields or self.fields))).select("_block", "field", F.explode("keys").alias("key"))
        return hits.groupBy("_block", "field", "key").count().where(F.col("count") == len(grams)).select("_block", "key").distinct()

    def rows(self, found: DataFrame | None = None) -> DataFrame:
        """The kept rows, of candidates (_block, key) where given."""
        kept = self.spark.read.parquet(f"{self.folder}/rows")
        if found is not None:
            found = saved(found)
            blocks = [r[0] for r in found.select("_block").distinct().limit(NAMED + 1).collect()]
            kept = kept.where(F.col("_block").isin(*blocks)) if len(blocks) <= NAMED else kept
            kept = kept.withColumn("key", F.col(f"row.{self.key}")).join(found, ["_block", "key"], "left_semi")
        return kept.select("row.*")

    def like(self, patterns: dict[str, Sequence[str]]) -> DataFrame:
        """Rows where a pattern (with % and _, in any case) fits one of its fields: {pattern: fields}."""
        each = [self.candidates(p, fields) for p, fields in patterns.items()]
        found = None if any(x is None for x in each) else reduce(lambda a, b: a.union(b), each).distinct()
        fits = reduce(lambda a, b: a | b, (F.col(f).ilike(p) for p, fields in patterns.items() for f in fields))
        return self.rows(found).where(F.coalesce(fits, F.lit(False)))

    def all_words(self, words: Sequence[str]) -> DataFrame:
        """Rows that may hold each word as a part of some field: to be ranked by what weighs them (see weighted_contains)."""
        found = None
        for w in words:
            own = self.candidates(re.sub(r"([\\%_])", r"\\\1", w))
            if own is not None:
                found = own if found is None else found.join(own, ["_block", "key"], "left_semi")
        return self.rows(found)
