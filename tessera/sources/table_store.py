"""A table in hashed buckets of which a merge rewrites only those that it touches.

Rows are in the bucket of their key's hash.  A commit (see commits) names the folder of
each bucket, with its rows and the least and greatest key, so a version is read from its
commit alone, and an older one can be made the current one again.  A merge reads the
buckets of the changed keys, writes these anew, and asks for the next number.  Where
another writer was first, buckets that it left alone are kept as written; if it
touched one of them the merge is done again on its result.

Rows with a null key are in a bucket of theirs and equal no other row.  What a merge writes and then
doesn't commit stays behind unnamed; ``vacuum`` takes it away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import commits
from .shared import saved

BUCKETS = 64
Apply = Callable[[DataFrame, DataFrame], DataFrame]


class ConflictError(RuntimeError):
    """Other writers were first each time."""


class TableStore:
    """A store in a folder: ``create`` writes the first version, the constructor opens one that is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        last = commits.latest(spark, folder)
        if last is None:
            raise FileNotFoundError(f"no version in {folder}")
        self.keys, self.buckets = last[1]["keys"], last[1]["buckets"]
        self.schema = T.StructType.fromJson(last[1]["schema"])

    @classmethod
    def create(cls, df: DataFrame, folder: str, key: str | Sequence[str], buckets: int = BUCKETS) -> TableStore:
        """df as version 0; ConflictError where there is one already."""
        spark = df.sparkSession
        made = cls.__new__(cls)
        made.spark, made.folder, made.buckets = spark, folder, buckets
        made.keys, made.schema = [key] if isinstance(key, str) else list(key), df.schema
        said = {"keys": made.keys, "buckets": buckets, "schema": json.loads(df.schema.json()), "files": made._written(df), "streams": {}, "tag": None}
        if not commits.put(spark, folder, 0, said):
            raise ConflictError(f"{folder} has a version")
        return made

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")

    def _written(self, df: DataFrame) -> dict[str, dict]:
        """Writes rows to a folder for each of their buckets: what a commit says of them."""
        name = uuid.uuid4().hex
        place = f"{self.folder}/data/{name}"
        df.select(*self.schema.names).withColumn("_bucket", self._bucket()).repartition("_bucket").sortWithinPartitions("_bucket", *self.keys).write.partitionBy("_bucket").parquet(place)
        back = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(place)
        key = F.col(self.keys[0])
        each = back.groupBy("_bucket").agg(F.count("*").alias("n"), F.to_json(F.struct(F.min(key).alias("low"), F.max(key).alias("high"))).alias("s"))
        return {str(r._bucket): {"path": f"{name}/_bucket={r._bucket}", "rows": r.n, **json.loads(r.s)} for r in each.collect()}  # a row for each bucket

    def _said(self, number: int | None) -> dict:
        return commits.latest(self.spark, self.folder)[1] if number is None else commits.load(self.spark, self.folder, number)

    def _rows(self, files: list[dict]) -> DataFrame:
        places = [f"{self.folder}/data/{f['path']}" for f in files]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of a version, the current one by default."""
        return self._rows(list(self._said(number)["files"].values()))

    def between(self, low, high, number: int | None = None) -> DataFrame:
        """Rows whose first key (a number or string) is in a closed range; files that can't have one aren't opened."""
        files = [f for f in self._said(number)["files"].values() if "low" in f and f["low"] <= high and f["high"] >= low]
        return self._rows(files).where(F.col(self.keys[0]).between(low, high))

    def lookup(self, keys: Sequence, number: int | None = None) -> DataFrame:
        """Rows of some values of the first key: only their buckets are opened."""
        kind = self.schema[self.keys[0]].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(self.keys[0], kind)]))
        mine = {str(r[0]) for r in asked.select(self._bucket()).distinct().collect()}
        return self._rows([f for b, f in self._said(number)["files"].items() if b in mine]).where(F.col(self.keys[0]).isin(*keys))

    def log(self) -> DataFrame:
        """number, rows, written (rows of buckets written by the commit) and tag of each commit."""
        rows, before = [], {}
        for n in commits.numbers(self.spark, self.folder):
            said = commits.load(self.spark, self.folder, n)
            rows.append((n, sum(f["rows"] for f in said["files"].values()), sum(f["rows"] for f in said["files"].values() if f["path"] not in before), said["tag"]))
            before = {f["path"] for f in said["files"].values()}
        return self.spark.createDataFrame(rows, "number long, rows long, written long, tag string")

    def merge(self, changes: DataFrame, apply: Apply, tag: str | None = None, stream: str | None = None, batch: int = 0, tries: int = 5) -> int:
        """Rows of the changed keys' buckets become ``apply(rows, changes)``; the number of the commit.

        changes has the first key; what apply gives must stay in these buckets (rows of
        other keys are an error).  A batch of a stream that is committed already is left out.
        """
        changes = saved(changes)
        touched = {str(r[0]) for r in changes.select(self._bucket()).distinct().collect()}  # BUCKETS at most
        wrote = base = None
        for _ in range(tries):
            number, said = commits.latest(self.spark, self.folder)
            if stream is not None and said["streams"].get(stream, -1) >= batch:
                return number
            mine = {b: said["files"][b]["path"] for b in touched if b in said["files"]}
            if wrote is None or mine != base:  # another writer touched them
                base = mine
                wrote = self._written(apply(self._rows([said["files"][b] for b in sorted(mine)]), changes))
                if not set(wrote) <= touched:
                    raise ValueError("a merge gave rows of keys that weren't among the changes")
            files = {b: f for b, f in said["files"].items() if b not in touched} | wrote
            streams = said["streams"] | ({stream: batch} if stream is not None else {})
            if commits.put(self.spark, self.folder, number + 1, said | {"files": files, "streams": streams, "tag": tag}):
                return number + 1
        raise ConflictError(f"{tries} other writers were first")

    def upsert(self, changes: DataFrame, **how) -> int:
        """Rows of changes take the place of those with their keys."""
        return self.merge(changes, lambda rows, new: rows.join(new.select(*self.keys), self.keys, "left_anti").select(*self.schema.names).unionByName(new.select(*self.schema.names)), **how)

    def insert_ignore(self, rows: DataFrame, **how) -> int:
        """Rows whose keys aren't there yet come in."""
        return self.merge(rows, lambda old, new: old.unionByName(new.join(old.select(*self.keys), self.keys, "left_anti").select(*self.schema.names)), **how)

    def delete(self, keys: DataFrame, **how) -> int:
        return self.merge(keys, lambda rows, gone: rows.join(gone.select(*self.keys), self.keys, "left_anti").select(*self.schema.names), **how)

    def restore(self, number: int) -> int:
        """Makes an older version the current one; streams keep what they have committed, so that no batch comes again."""
        said = commits.load(self.spark, self.folder, number)
        while True:
            last, now = commits.latest(self.spark, self.folder)
            if commits.put(self.spark, self.folder, last + 1, said | {"streams": now["streams"], "tag": f"restored {number}"}):
                return last + 1

    def vacuum(self) -> int:
        """Takes away data folders that no commit names; how many. Not while a merge is under way."""
        named = {f["path"].split("/")[0] for n in commits.numbers(self.spark, self.folder) for f in commits.load(self.spark, self.folder, n)["files"].values()}
        _, where, fs = commits._places(self.spark, f"{self.folder}/data")
        gone = [f.getPath() for f in (fs.listStatus(where) if fs.exists(where) else []) if f.getPath().getName() not in named]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
