"""Scans and sinks of an inventory's files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .shared import saved
from .stores import list_versions, read_version, write_version  # noqa: F401  version folders are read and written here too


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; a line that doesn't parse ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and the lines that don't."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("_row", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where(F.col("_row").isNotNull() & F.col("_row._bad").isNull()).select("_row.*").drop("_bad")
    return good, parsed.where(F.col("_row").isNull() | F.col("_row._bad").isNotNull()).select("value")


def last_by_id(df: DataFrame, key: str, position: Column) -> DataFrame:
    """Of rows with one key, the last by position."""
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), position).alias("_r")).select(key, "_r.*")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def read_jsonl_unique(spark: SparkSession, path: str, schema: StructType | str, key: str, limit: int | None = None) -> DataFrame:
    """read_jsonl, but a key that occurs twice is an error; with a limit the first rows by key."""
    rows = read_jsonl(spark, path, schema)
    twice = [r[key] for r in duplicates(rows, key).orderBy(key).limit(5).collect()]
    if twice:
        raise ValueError(f"{key} occurs more than once: {twice}")
    return rows if limit is None else rows.orderBy(key).limit(limit)


def read_wide_csv(spark: SparkSession, path: str, schema: str, preamble: int = 10) -> DataFrame:
    """A CSV with preamble lines before its header and an empty first column.

    Files split: only the part of a file that begins at its first byte leaves lines
    out, its first preamble + 1 (they are to be in that part).
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("head"))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            keep = []
            for file, head in zip(batch.column("file").to_pylist(), batch.column("head").to_pylist()):
                n = seen[file] = seen.get(file, 0) + 1 if head else preamble + 2
                keep.append(n > preamble + 1)
            yield pa.RecordBatch.from_pydict({"line": batch.column("value").filter(pa.array(keep, pa.bool_()))})

    rows = lines.mapInArrow(body, "line string").where(F.trim("line") != "")
    return rows.select(F.from_csv("line", F.lit(f"_blank string, {schema}")).alias("r")).select("r.*").drop("_blank")


def latest_partition(df: DataFrame, column: str = "date") -> DataFrame:
    """The rows of the newest yyyy-MM-dd partition."""
    valid = df.where(F.col(column).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return valid.join(F.broadcast(valid.agg(F.max(column).alias(column))), column, "left_semi")


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def insert_ignore(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """target with the rows whose key it lacks."""
    return target.unionByName(rows.dropDuplicates([key]).join(target.select(key), key, "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """target overwritten by rows of the same key, where they have values."""
    t, r = target.alias("t"), rows.alias("r")
    joined = t.join(r, F.col(f"t.{key}") == F.col(f"r.{key}"), "full_outer")
    return joined.select(F.coalesce(f"r.{key}", f"t.{key}").alias(key), *(F.coalesce(f"r.{c}", f"t.{c}").alias(c) for c in target.columns if c != key))


def vector_or_zero(column: str, dim: int) -> Column:
    return F.when(F.size(column) == dim, F.col(column)).otherwise(F.array_repeat(F.lit(0.0).cast("float"), dim))


def delete_by_key(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key), key, "left_anti").select(*target.columns)


def update_fields(target: DataFrame, rows: DataFrame, key: str, fields: str = "changed") -> DataFrame:
    """target with the values of rows in the columns that each row names (an array of names), and nothing else; unknown keys add nothing."""
    columns = [c for c in target.columns if c != key and c in rows.columns]
    new = rows.select(key, F.col(fields).alias("_f"), *(F.col(c).alias(f"_n_{c}") for c in columns))
    joined = target.join(new, key, "left")
    value = lambda c: F.when(F.array_contains("_f", c), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*(value(c) if c in columns else F.col(c) for c in target.columns))


#: The most that a request gets.
MOST_ROWS, MOST_VALUES = 500, 100


def clamped(n: int, most: int = MOST_ROWS) -> int:
    return max(1, min(n, most))


def retrieve(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of some ids, MOST_ROWS of them at most, by key."""
    return df.where(F.col(key).isin(*ids[:MOST_ROWS])).orderBy(key)


def scroll(df: DataFrame, key: str, after: object | None = None, limit: int = MOST_ROWS, where: Column | None = None) -> DataFrame:
    """The next rows by key after one, so that each page reads on where the last ended."""
    out = df if where is None else df.where(where)
    return (out if after is None else out.where(F.col(key) > F.lit(after))).orderBy(key).limit(clamped(limit))


def facet_values(df: DataFrame, value: Column, limit: int = MOST_VALUES) -> DataFrame:
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(clamped(limit, MOST_VALUES))


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def next_ids(ids: DataFrame, column: str, prefix: str, width: int = 4) -> DataFrame:
    """year, next: prefix-year-number after the last one of each year; ids of another form are left out."""
    form = rf"^{prefix}-(\d{{4}})-(\d+)$"
    known = ids.where(F.col(column).rlike(form))
    last = known.groupBy(F.regexp_extract(column, form, 1).alias("year")).agg((F.max(F.regexp_extract(column, form, 2).cast("long")) + 1).cast("string").alias("n"))
    padded = F.when(F.length("n") < width, F.lpad("n", width, "0")).otherwise(F.col("n"))
    return last.select("year", F.concat_ws("-", F.lit(prefix), "year", padded).alias("next"))


def next_id(ids: DataFrame, column: str, prefix: str, year: int, width: int = 4) -> str:
    """The next id of a year, number 1 where it has none."""
    found = next_ids(ids, column, prefix, width).where(F.col("year") == str(year)).first()
    return found.next if found else f"{prefix}-{year}-{1:0{width}d}"


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """position from 0 in the order of columns: ranges are sorted and written once, then each adds the rows of those before it."""
    parts = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    marked = saved(parts.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return marked.join(F.broadcast(before), "_part").withColumn("position", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def write_csv_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
