"""Whole texts of a batch as flat numpy arrays: words, hashes and packed spans.

Everything here works on one Arrow batch, in pieces of bounded bytes, so that a
task's memory doesn't follow the size of its partition.  Words are maximal runs
of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 equals
``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are held as arrays at a time; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20
#: Bytes of an Arrow batch that goes to Python; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: The id that stands for a null one inside the operators: after all others.
NULL_ID = (1 << 63) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) without nulls: a null text is empty, a null id is NULL_ID. Batches for Python are bounded (bound_batches)."""
    bound_batches(df.sparkSession)
    return df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bound_batches(spark: SparkSession) -> None:
    """Bounds batches for Python by bytes, as long texts would make one of thousands of rows too large.

    The plan reads the setting when it runs, so the session keeps it; a smaller bound of the caller's stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", str(spark.conf.get(name, None) or "")) or BATCH_BYTES + 1) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def outer_id(name: str = "doc_id") -> Column:
    """The id as it was given."""
    return F.nullif(F.col(name), F.lit(NULL_ID)).alias(name)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES, rows: int = 1 << 31) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, and of ``rows`` at most."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = min(row + rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1))
        yield row, end
        row = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            x = np.full(max(n + (n >> 2), 1 << 18), base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums from which range_hash takes the hash of any range of ``values`` (uint64)."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of each word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[0] = after[-1] = False
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mixed(range_hash(prefix_hash(_BYTE[data]), starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    full = lengths > 0
    starts, lengths = starts[full].astype(np.int64), lengths[full]
    if not total:
        return out[:0]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    out[first] = starts
    out[first[1:]] -= starts[:-1] + lengths[:-1] - 1
    return np.cumsum(out)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The bytes of all ranges, one after the other."""
    return data[ranges(starts, ends - starts)].tobytes()


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word followed by one space, and where each word begins there."""
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    lengths = ends - starts + 1
    at = np.concatenate(([0], np.cumsum(lengths)))
    out = np.full(at[-1], 32, np.uint8)
    keep = np.ones(at[-1], bool)
    keep[at[1:] - 1] = False
    out[keep] = data[~SPACE[data]]
    return out, at[:-1]
