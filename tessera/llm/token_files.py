"""Token-ID files: concatenated ids with Elias-Fano coded document boundaries.

A file set is a folder of records in ascending document id.  A record holds the
ids of some whole documents, end to end, in 2 or 4 bytes each, and two Elias-Fano
sequences: where each document ends, and the document ids.  A sequence of n
values up to u takes about 2 + log2(u / n) bits a value: the low bits side by
side, the high bits in unary.  Every SAMPLE-th one of the unary part has its
32-bit position stored; select(i) starts there and counts on.  Starts and ends of a
record's documents are read by select_each, which does the same for many places at
once: set bits before each byte of the unary part, and a table of places in a byte.

The records of a folder are written by range of document id, so (shard, record)
is their order; the start of a document is the ids of the shards before, of the
records before in its shard, and its offset in the record.

Results for odd input: a null or empty text has the end id alone; a null id comes
last and back as null; repeated rows each have an entry, those of one id in any
order (which their results show only in start); a very long text is a record of its
own; no rows, no records; other columns are left out, whatever their names.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays as A
from .bpe import encode_rows
from .pretokens import Encoder
from .storage import shared_folder

SAMPLE = 256
#: Ids that a record holds, unless one document alone has more.
RECORD_IDS = 1 << 20
_HEAD = struct.Struct("<qqqqq")


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Set bits of each byte, and where its first, second, ... set bit is.
ONES = _BITS.sum(1).astype(np.uint8)
PLACES = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space."""

    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        base = int(values[0]) if n else 0
        rest = values.astype(np.uint64) - np.uint64(base % (1 << 64))
        top = int(rest[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(((rest[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (rest >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, base, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def dumps(self) -> bytes:
        return _HEAD.pack(self.n, self.base, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def loads(cls, raw: bytes) -> EliasFano:
        n, base, bits, low, high = _HEAD.unpack_from(raw)
        at = _HEAD.size
        return cls(n, base, bits, np.frombuffer(raw, np.uint8, low, at), np.frombuffer(raw, np.uint8, high, at + low), np.frombuffer(raw, np.uint32, -1, at + low + high) if n else np.zeros(0, np.uint32))

    def select(self, i: int) -> int:
        """The i-th value, by the sampled position before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, width = at // 8, 64
        ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + width], bitorder="little"))
        ones = ones[ones + byte * 8 >= at]
        while len(ones) <= left:  # a longer stretch of the unary part
            width *= 2
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + width], bitorder="little"))
            ones = ones[ones + byte * 8 >= at]
        high = int(ones[left]) + byte * 8 - i
        first = i * self.low_bits
        window = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        low = (window >> first % 8) & ((1 << self.low_bits) - 1)
        return (high << self.low_bits | low) + self.base

    def select_each(self, i: np.ndarray) -> np.ndarray:
        """The values at several places."""
        if not len(i):
            return np.zeros(0, np.int64)
        if i.min() < 0 or i.max() >= self.n:
            raise IndexError(i)
        until = np.cumsum(ONES[self.high], dtype=np.int64)
        byte = np.searchsorted(until, i, "right")
        inside = i - (until[byte] - ONES[self.high[byte]])
        high = (byte * 8 + PLACES[self.high[byte], inside] - i).astype(np.uint64)
        first = i * self.low_bits
        padded = np.concatenate((self.low, np.zeros(17, np.uint8))).tobytes()
        words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        shift = (first % 8).astype(np.uint64)
        low = words[first // 8] >> shift
        low |= (words[first // 8 + 1] >> np.uint64(56)) << (np.uint64(64) - np.maximum(shift, 1)) if self.low_bits > 56 else np.uint64(0)
        low &= np.uint64((1 << self.low_bits) - 1)
        return ((high << np.uint64(self.low_bits) | low) + np.uint64(self.base % (1 << 64))).astype(np.int64)

    def values(self) -> np.ndarray:
        """All values in order."""
        return self.select_each(np.arange(self.n))


@lru_cache(2)
def library_encoder(path: str) -> Encoder:
    """Each word is encoded by the tokenizers library; the rules that split texts are pretokens'."""
    from tokenizers import Tokenizer

    spec = json.load(open(path, encoding="utf-8"))
    spec["normalizer"], spec["pre_tokenizer"] = None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    spec["added_tokens"] = []
    tokenizer = Tokenizer.from_str(json.dumps(spec))

    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        done = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(done.ids, np.int32), np.bincount(np.array(done.word_ids, np.int64), minlength=len(words))

    return Encoder(encode_words, added)


def _writer(path: str, end_id: int, record_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        shard, record = TaskContext.get().partitionId(), 0
        docs, ids, ends, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            kind = np.dtype("<u2" if flat.max() < 1 << 16 else "<u4")
            columns = {"shard": pa.array([shard], pa.int32()), "record": pa.array([record], pa.int32()), "n_ids": pa.array([len(flat)], pa.int64()), "width": pa.array([kind.itemsize], pa.int32())}
            columns |= {"ids": pa.array([flat.astype(kind).tobytes()], pa.binary()), "ends": pa.array([EliasFano.of(np.concatenate(ends)).dumps()], pa.binary()), "docs": pa.array([EliasFano.of(np.concatenate(docs)).dumps()], pa.binary())}
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for rows, flat, counts in encode_rows(encoder, batch, 2 << 20):
                flat = np.insert(flat, np.cumsum(counts), end_id)
                stops = np.cumsum(counts + 1)
                docs.append(rows.column("doc_id").to_numpy(zero_copy_only=False))
                ids.append(flat)
                ends.append(stops + total)
                total += len(flat)
                if total >= record_ids:
                    yield flush()
                    record, docs, ids, ends, total = record + 1, [], [], [], 0
        if total:
            yield flush()

    return write


RECORDS = "shard int, record int, n_ids long, width int, ids binary, ends binary, docs binary"


def write_token_files(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, record_ids: int = RECORD_IDS) -> None:
    """Writes the ids of all texts, each followed by end_id, to a new folder, in ascending document id."""
    docs = A.documents(df, id_col, text_col)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_writer(path or public_tokenizers.path("word_bpe_49k.json"), end_id, record_ids), RECORDS).write.parquet(folder)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            first, width, raw, ends, docs = (batch.column(c)[row].as_py() for c in ("first", "width", "ids", "ends", "docs"))
            boundary = EliasFano.loads(ends)
            at = np.arange(boundary.n)
            stops, starts = boundary.select_each(at), np.append(0, boundary.select_each(at[:-1]))
            wide = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
            own = [wide[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist())]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(EliasFano.loads(docs).values(), pa.int64()), "start": pa.array(first + starts, pa.int64()), "n_tokens": pa.array(stops - starts, pa.int64()), "ids": pa.array(own, pa.binary())})


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit integers)."""
    records = spark.read.schema(RECORDS).parquet(folder)
    shards = records.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = records.select("shard", "record", "n_ids").withColumn("within", F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_ids")
    first = inside.join(shards, "shard").select("shard", "record", (F.col("before") + F.col("within")).alias("first"))
    return records.drop("n_ids").join(first, ["shard", "record"]).select("first", "width", "ids", "ends", "docs").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary").withColumn("doc_id", A.outer_id())


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
