"""A log of numbered commits: a number goes to the first writer that asks for it.

A commit is a JSON file written beside the log and moved to its number; the move fails
where the number is taken, as the file system's move without overwriting is one step.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _places(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    where = jvm.Path(path)
    return jvm, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of all commits, in order."""
    _, where, fs = _places(spark, f"{folder}/log")
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def load(spark: SparkSession, folder: str, number: int) -> dict:
    _, where, fs = _places(spark, f"{folder}/log/{number:020d}.json")
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def latest(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The last commit's number and what it says."""
    known = numbers(spark, folder)
    return (known[-1], load(spark, folder, known[-1])) if known else None


def put(spark: SparkSession, folder: str, number: int, said: dict) -> bool:
    """Makes a commit; False where another writer has that number already."""
    jvm, part, fs = _places(spark, f"{folder}/log/.{uuid.uuid4().hex}")
    stream = fs.create(part, False)
    stream.write(bytearray(json.dumps(said).encode()))
    stream.close()
    _, place, _ = _places(spark, f"{folder}/log/{number:020d}.json")
    rename = getattr(jvm, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        jvm.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(part, place, options)
        return True
    except Exception as failed:
        if not fs.exists(place):
            raise failed
        fs.delete(part, False)
        return False
