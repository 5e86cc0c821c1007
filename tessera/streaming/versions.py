"""Dumps as a file stream: each micro-batch is merged into the current version folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import temporal
from ..sources import readers, stores
from ..sources.table_store import TableStore


def merge_batch(folder: str, key: str, columns: Sequence[str], at: str, stream: str = ""):
    """A foreachBatch function: merges the last row of each key; the time of the version is the batch's latest ``at``.

    Stream and batch number are the commit's tag, so a batch that comes again after a failure is merged once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tag = f"{stream}#{number}"
        if batch.isEmpty() or stores.tagged(spark, folder, tag):
            return
        last_commit = stores.current(spark, folder)
        now = F.lit(batch.agg(F.max(at).alias("m")).first().m).cast(batch.schema[at].dataType)
        last = readers.last_by_id(batch.select(key, *columns, at), key, F.col(at)).select(key, *columns)
        if last_commit is None:
            versions = last.limit(0).withColumns({"tx_from": now, "tx_to": F.lit(None).cast(batch.schema[at].dataType)})
        else:
            versions = stores.read_version(spark, folder, last_commit[1])
        stores.write_version(temporal.merge(versions, last, key, list(columns), now), folder, tag)

    return merge


def merge_into(store: TableStore, columns: Sequence[str], at: str, stream: str = ""):
    """A foreachBatch function like merge_batch's, for a store in buckets: a batch rewrites only those of its keys, and comes in once."""

    def merge(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        key = store.keys[0]
        kind = batch.schema[at].dataType
        now = F.lit(batch.agg(F.max(at).alias("m")).first().m).cast(kind)
        last = readers.last_by_id(batch.select(key, *columns, at), key, F.col(at)).select(key, *columns)
        store.merge(last, lambda rows, new: temporal.merge(rows, new, key, list(columns), now), stream=stream, batch=number)

    return merge


def ingest(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, key: str, columns: Sequence[str], at: str) -> StreamingQuery:
    """Takes in what is new in a folder of JSON lines, in order of arrival, and ends."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    return stream.writeStream.foreachBatch(merge_batch(folder, key, columns, at, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
