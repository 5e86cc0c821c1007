"""Shards and vector files: Arrow files in shard order, vectors with a row index, pools as entities and fields."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import saved


def read_arrow_shards(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """shard, row and the columns of ``schema`` of Arrow files (file or stream format), one task a file.

    The shard number is the last run of digits in a file's name.  A file is read by
    record batch, so a task holds its bytes and one batch of rows.
    """
    files = spark.read.format("binaryFile").load(pattern)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    numbered = files.select(F.regexp_extract(name, r"(\d+)(?!.*\d)", 1).cast("long").alias("shard"), "content")
    columns = [c.name for c in spark.createDataFrame([], schema).schema]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist()):
                opened = pa.ipc.open_file(io.BytesIO(raw)) if raw[:6] == b"ARROW1" else pa.ipc.open_stream(io.BytesIO(raw))
                parts = (opened.get_batch(i) for i in range(opened.num_record_batches)) if raw[:6] == b"ARROW1" else opened
                at = 0
                for part in parts:
                    head = {"shard": pa.array([shard] * part.num_rows, pa.int64()), "row": pa.array(range(at, at + part.num_rows), pa.int64())}
                    yield pa.RecordBatch.from_pydict(head | {c: part.column(c) for c in columns})
                    at += part.num_rows

    return numbered.mapInArrow(rows, f"shard long, row long, {schema}")


def text_pool(shards: DataFrame, column: str) -> DataFrame:
    """position and text of shards (shard, row), in shard order, blank texts left out; positions run over all shards."""
    kept = shards.where(F.trim(F.coalesce(column, F.lit(""))) != "").select("shard", "row", F.col(column).alias("text"))
    own = kept.withColumn("_in", F.row_number().over(Window.partitionBy("shard").orderBy("row")) - 1)
    own = saved(own)
    sizes = own.groupBy("shard").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(before.drop("_n"), "shard").select((F.col("_before") + F.col("_in")).alias("position"), "text")


def scattered(pool: DataFrame, fields: Sequence[str], column: str = "text") -> DataFrame:
    """entity and a column for each field: entry n of a pool (position) is field n % k of entity n div k; missing ones are null."""
    k = len(fields)
    name = F.element_at(F.array(*map(F.lit, fields)), (F.col("position") % k + 1).cast("int"))
    entity = F.floor(F.col("position") / k).alias("entity")
    return pool.select(entity, name.alias("_f"), column).groupBy("entity").agg(*(F.max(F.when(F.col("_f") == f, F.col(column))).alias(f) for f in fields))


def indexed_vectors(vectors: DataFrame, index: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key and vectors of a file (row, vectors) by its side index (key, row); several entries of a key: the last row; rows outside the file have null vectors."""
    last = index.groupBy(key).agg(F.max("row").alias("row"))
    return last.join(vectors.select("row", *columns), "row", "left").select(key, *columns)
