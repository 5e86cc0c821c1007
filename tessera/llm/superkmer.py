"""Super-k-mers: consecutive windows that share a minimiser, packed into one string.

A window is k consecutive tokens (words or bytes) of one text.  Its minimiser is
the m-gram in it that comes first in an order which depends on the m-gram alone,
so equal windows have equal minimisers wherever they stand.  A run of windows
with one minimiser travels as one packed string of k - 1 + n tokens instead of n
strings of k, to the bucket of the minimiser's hash, where equal windows meet.

The order puts m-grams of crowded hash classes last: one job counts the
m-grams of all texts in 2**CLASS_BITS classes, and windows around a boilerplate
phrase then take another m-gram as their key, which spreads them over the buckets.
The bitmap of crowded classes has a fixed size (2**CLASS_BITS bits).  Repeats of a
packed string inside a piece are resolved before the shuffle, so that a passage
in many texts reaches its bucket once per piece; there, whenever FOLD_BYTES have
come together, equal strings are one again, so that a hot bucket holds as much as it
has different strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import arrays as A

CLASS_BITS = 20
SEGMENT_BITS = 14
#: A class is crowded above this many times the middle class and this many m-grams.
CROWDED_TIMES, CROWDED_LEAST = 8, 64
#: Partitions whose class counts one task sums, segment by segment.
PARTITIONS_SUMMED = 256
#: Raw bytes of packed strings that a bucket should have.
BUCKET_BYTES = 6 << 20
#: Raw bytes of packed strings that a task holds before it compresses them by bucket.
HELD_BYTES = 32 << 20
#: Bytes of text of the documents whose runs or spans come back to one place (their home).
HOME_TEXT = 16 << 20
#: Raw bytes of packed strings that a bucket holds before equal ones are folded.
FOLD_BYTES = 48 << 20


@dataclass(frozen=True)
class Spec:
    """k tokens a window, m a minimiser; tokens are words or bytes.

    within: an earlier start in the same text counts as a repeat.
    """

    k: int
    m: int
    words: bool
    within: bool


@dataclass
class Runs:
    """The super-k-mers of a piece: row, first token, windows, minimiser; and its tokens."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    content: np.ndarray


def runs_of(data: np.ndarray, offsets: np.ndarray, spec: Spec, crowded: np.ndarray | None) -> Runs | None:
    """crowded: a flag for each hash class, or None."""
    if spec.words:
        starts, ends, row = A.words(data, offsets)
        tokens = A.word_hashes(data, starts, ends)
        first = np.searchsorted(row, np.arange(len(offsets)))
        data, at = A.joined(data, starts, ends)
        ends = at + (ends - starts)
        starts = at
    else:
        tokens, first = A._BYTE[data], offsets
        starts = ends = row = None
    n, k, m = len(tokens), spec.k, spec.m
    if n < k:
        return None
    prefix = A.prefix_hash(tokens)
    at = np.arange(n - m + 1)
    grams = A.mixed(A.range_hash(prefix, at, at + m))
    order = grams >> np.uint64(1)
    if crowded is not None and crowded.any():
        order |= crowded[(grams >> np.uint64(64 - CLASS_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
    width, done = k - m + 1, 1
    low = order
    while done < width:  # minimum over ``done`` m-grams, doubled each time
        step = min(done, width - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    lengths = np.diff(first)
    fits = np.maximum(lengths - k + 1, 0)
    windows = A.ranges(first[:-1], fits)
    if not len(windows):
        return None
    key = low[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (key[1:] != key[:-1]) | (windows[1:] != windows[:-1] + 1)
    opening = np.concatenate(([0], np.cumsum(fits)[:-1]))[fits > 0]
    new[opening] = True
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(windows)))
    if sizes.max() > width:  # a long repeat of one gram: in parts, with the same key
        parts = -(-sizes // width)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        heads, total = np.repeat(heads, parts) + inner * width, np.repeat(sizes, parts)
        sizes = np.minimum(width, total - inner * width)
    token = windows[heads]
    last = token + sizes - 1 + k
    line = np.searchsorted(first, token, "right") - 1
    content = A.mixed(A.range_hash(prefix, token, last)) + sizes.astype(np.uint64)
    return Runs(line, token - first[line], sizes, key[heads], data, starts[token] if spec.words else token, ends[last - 1] if spec.words else last, content)


def text_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, bytes and offsets of pieces of (doc_id, text) batches."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        data, offsets = A.flat(batch.column("text"))
        for lo, hi in A.pieces(data, offsets):
            yield ids[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def class_counts(hashes_of: Callable[[np.ndarray, np.ndarray], np.ndarray | None]) -> Callable:
    """A mapInArrow function: how many hashes of the partition are in each class, in segments."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CLASS_BITS, np.int64)
        size = 0
        for _, data, offsets in text_pieces(batches):
            size += len(data)
            hashes = hashes_of(data, offsets)
            if hashes is not None:
                counts += np.bincount((hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int64), minlength=1 << CLASS_BITS)
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = counts.reshape(-1, 1 << SEGMENT_BITS)
        if size:
            group = TaskContext.get().partitionId() // PARTITIONS_SUMMED
            rows = {"segment": pa.array(range(len(parts)), pa.int32()), "part": pa.array([group] * len(parts), pa.int32())}
            yield pa.RecordBatch.from_pydict(rows | {"size": pa.array([size] + [0] * (len(parts) - 1), pa.int64()), "counts": [pack(x.tobytes()) for x in parts]})

    return count


def _sums(batches: Iterator[pa.RecordBatch]) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    sums: dict[int, np.ndarray] = {}
    size: dict[int, int] = {}
    for batch in batches:
        for segment, n, packed in zip(*(batch.column(c).to_pylist() for c in ("segment", "size", "counts"))):
            x = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int64)
            sums[segment] = sums.get(segment, 0) + x
            size[segment] = size.get(segment, 0) + n
    return sums, size


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, size = _sums(batches)
    pack = zstandard.ZstdCompressor(level=1).compress
    for segment, x in sums.items():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "size": pa.array([size[segment]], pa.int64()), "counts": [pack(x.tobytes())]})


def _crowded_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, size = _sums(batches)
    for segment, x in sums.items():
        crowded = x > max(CROWDED_LEAST, CROWDED_TIMES * float(np.median(x)))
        yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "size": pa.array([size[segment]], pa.int64()), "crowded": [np.packbits(crowded).tobytes()]})


def crowded_classes(docs: DataFrame, hashes_of: Callable) -> tuple[bytes, int]:
    """The bitmap of crowded hash classes (of fixed size) and the bytes of all texts. Counts of PARTITIONS_SUMMED partitions are summed before all are."""
    counted = docs.mapInArrow(class_counts(hashes_of), "segment int, part int, size long, counts binary")
    summed = counted.repartition("segment", "part").mapInArrow(_partial_sums, "segment int, size long, counts binary")
    rows = summed.repartition("segment").mapInArrow(_crowded_segments, "segment int, size long, crowded binary").collect()  # 2**(CLASS_BITS - SEGMENT_BITS) rows
    bits = {r.segment: bytes(r.crowded) for r in rows}
    empty = bytes(1 << SEGMENT_BITS - 3)
    return b"".join(bits.get(i, empty) for i in range(1 << CLASS_BITS - SEGMENT_BITS)), sum(r.size for r in rows)


def flags(bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool)


def all_grams(spec: Spec) -> Callable:
    """A hash for each m-gram of the texts; the few that cross two texts do no harm to the counts."""

    def of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray | None:
        tokens = A.word_hashes(data, *A.words(data, offsets)[:2]) if spec.words else A._BYTE[data]
        at = np.arange(len(tokens) - spec.m + 1)
        return A.mixed(A.range_hash(A.prefix_hash(tokens), at, at + spec.m)) if len(at) else None

    return of


def pack(arrays: list[np.ndarray], text: bytes) -> bytes:
    head = np.array([len(x) for x in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(x.tobytes() for x in arrays) + text)


def unpack(packed: bytes, kinds: list[type]) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out, raw[at:]


#: Of each packed string: doc_id as steps, first token, windows, bytes beyond those of one a token, 32 bits of the minimiser.
KINDS = [np.int64, np.int32, np.int32, np.int32, np.uint32]
#: Of each span: doc_id as steps, first window, windows.
SPANS = [np.int64, np.int32, np.int32]
DEALT = "bucket int, packed binary"


def spans_by_home(ids: np.ndarray, start: np.ndarray, count: np.ndarray, homes: int) -> tuple[np.ndarray, list[bytes]]:
    """Homes, and for each the packed spans of its documents."""
    home = (A.mixed(ids.view(np.uint64)) % np.uint64(homes)).astype(np.int64)
    by = np.lexsort((start, ids, home))
    ids, start, count, home = ids[by], start[by].astype(np.int32), count[by].astype(np.int32), home[by]
    edge = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else np.zeros(0, np.int64)
    return home[edge], [pack([np.diff(ids[a:b], prepend=0), start[a:b], count[a:b]], b"") for a, b in zip(edge, np.append(edge[1:], len(home)))]


def dealer(spec: Spec, bitmap: bytes, buckets: int, homes: int) -> Callable:
    """A mapInArrow function: packed strings by bucket; at buckets and above, by home, spans already known to repeat."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Runs]]:
        crowded = flags(bitmap)
        for ids, data, offsets in text_pieces(batches):
            runs = runs_of(data, offsets, spec, crowded)
            if runs is not None:
                yield ids, runs

    return lambda batches: deal_runs(found(batches), spec, buckets, homes)


def deal_runs(found: Iterator[tuple[np.ndarray, Runs]], spec: Spec, buckets: int, homes: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    size = 0
    for ids, runs in found:
        doc = ids[runs.row]
        order = np.lexsort((runs.start, doc, runs.content))
        content, raw = runs.content[order], runs.data.tobytes()
        head = np.append(True, content[1:] != content[:-1])
        lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]  # of each, the first with that content
        later = (doc[order] > doc[lead]) | ((doc[order] == doc[lead]) & (runs.start[order] > runs.start[lead]) & spec.within)
        same = later.copy()
        b, e = runs.begin, runs.end
        same[later] = [raw[b[x] : e[x]] == raw[b[y] : e[y]] for x, y in zip(order[later], lead[later])]
        repeat, stay = order[same], order[~same]
        if len(repeat):
            home, out = spans_by_home(doc[repeat], runs.start[repeat], runs.count[repeat], homes)
            yield _dealt(buckets + home, out)
        home = (A.mixed(runs.key[stay]) % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((runs.start[stay], doc[stay], home))
        stay, home = stay[by], home[by]
        edge = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else np.zeros(0, np.int64)
        for lo, hi in zip(edge, np.append(edge[1:], len(home))):
            own = stay[lo:hi]
            text = b"".join([raw[x:y] for x, y in zip(b[own].tolist(), e[own].tolist())])
            size += len(text) + 28 * len(own)
            count = runs.count[own]
            held.setdefault(int(home[lo]), []).append(([doc[own], runs.start[own].astype(np.int32), count.astype(np.int32), (e[own] - b[own] - count - (spec.k - 1)).astype(np.int32), runs.key[own].astype(np.uint32)], text))
        del runs, doc, order, content, raw, head, lead, later, same, stay, home
        if size > HELD_BYTES:
            yield _flushed(held)
            held, size = {}, 0
    if held:
        yield _flushed(held)


def _dealt(bucket: list[int] | np.ndarray, out: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "packed": pa.array(out, pa.binary())})


def _flushed(held: dict[int, list]) -> pa.RecordBatch:
    out = []
    for parts in held.values():
        doc, *others = (np.concatenate(x) for x in zip(*(p[0] for p in parts)))
        out.append(pack([np.diff(doc, prepend=0), *others], b"".join(p[1] for p in parts)))
    return _dealt(list(held), out)


#: Of each run: doc_id as steps, 32 bits of the minimiser (two minimisers of a bucket that share them only add candidates), first window, windows.
SEEN = [np.int64, np.uint32, np.int32, np.uint16]


def _seen(spec: Spec, bitmap: bytes, buckets: int) -> Callable:
    """A mapInArrow function: the runs of all texts, without their bytes, by bucket."""

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = flags(bitmap)
        held: dict[int, list] = {}
        size = 0
        for ids, data, offsets in text_pieces(batches):
            runs = runs_of(data, offsets, spec, crowded)
            if runs is None:
                continue
            doc = ids[runs.row]
            home = (A.mixed(runs.key) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(home, kind="stable")
            home = home[by]
            edge = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
            for lo, hi in zip(edge, np.append(edge[1:], len(home))):
                own = by[lo:hi]
                held.setdefault(int(home[lo]), []).append((doc[own], runs.key[own], runs.start[own], runs.count[own]))
            size += len(doc)
            if size > HELD_BYTES // 16:
                yield out(held)
                held, size = {}, 0
        if held:
            yield out(held)

    def out(held: dict[int, list]) -> pa.RecordBatch:
        packed = []
        for parts in held.values():
            doc, key, start, count = (np.concatenate(x) for x in zip(*parts))
            packed.append(pack([np.diff(doc, prepend=0), key.astype(np.uint32), start.astype(np.int32), count.astype(np.uint16)], b""))
        return pa.RecordBatch.from_pydict({"bucket": pa.array(list(held), pa.int32()), "packed": pa.array(packed, pa.binary())})

    return see


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    bucket, held = -1, []
    for batch in batches:
        for b, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
            if b != bucket and held:
                yield bucket, held
                held = []
            bucket = b
            held.append(packed)
    if held:
        yield bucket, held


def _shared(homes: int) -> Callable:
    """A mapInArrow function: the runs whose minimiser several documents have, by their document's bucket."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, packed in _by_bucket(batches):
            parts = [unpack(x, SEEN)[0] for x in packed]
            doc = np.concatenate([np.cumsum(p[0]) for p in parts])
            key, start, count = (np.concatenate([p[i] for p in parts]) for i in range(1, 4))
            by = np.argsort(key, kind="stable")
            key, doc, start, count = key[by], doc[by], start[by], count[by]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            several = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
            keep = np.repeat(several, np.diff(np.append(heads, len(key))))
            key, doc, start, count = key[keep], doc[keep], start[keep], count[keep]
            home = (A.mixed(doc.view(np.uint64)) % np.uint64(homes)).astype(np.int64)
            by = np.lexsort((start, doc, home))
            key, doc, start, count, home = key[by], doc[by], start[by], count[by], home[by]
            edge = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else np.zeros(0, np.int64)
            out = [pack([np.diff(doc[a:b], prepend=0), key[a:b], start[a:b], count[a:b]], b"") for a, b in zip(edge, np.append(edge[1:], len(home)))]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(home[edge], pa.int32()), "packed": pa.array(out, pa.binary())})

    return share


def _of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: its shared runs."""
    for _, packed in _by_bucket(batches):
        parts = [unpack(x, SEEN)[0] for x in packed]
        doc = np.concatenate([np.cumsum(p[0]) for p in parts])
        key, start, count = (np.concatenate([p[i] for p in parts]) for i in range(1, 4))
        by = np.lexsort((start, doc))
        doc, key, start, count = doc[by], key[by], start[by], count[by]
        heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        out = [pack([key[a:b], start[a:b], count[a:b]], b"") for a, b in zip(heads, np.append(heads[1:], len(doc)))]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[heads], pa.int64()), "runs": pa.array(out, pa.binary())})


def _shared_dealer(spec: Spec, buckets: int, homes: int) -> Callable:
    """A mapInArrow function over (doc_id, text, runs), as dealer; tokens are bytes."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Runs]]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = A.flat(batch.column("text"))
            packed = batch.column("runs").to_pylist()
            for lo, hi in A.pieces(data, offsets):
                parts = [unpack(x, SEEN[1:])[0] for x in packed[lo:hi]]
                key, start, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
                row = np.repeat(np.arange(hi - lo), [len(p[0]) for p in parts])
                key, count = key.astype(np.uint64), count.astype(np.int64)
                own = data[offsets[lo] : offsets[hi]]
                length = np.diff(offsets[lo : hi + 1])
                fits = start + count + spec.k - 1 <= length[row]  # else of another row with this id
                key, start, count, row = key[fits], start[fits], count[fits], row[fits]
                begin = offsets[lo:hi][row] - offsets[lo] + start
                end = begin + count + spec.k - 1
                content = A.mixed(A.range_hash(A.prefix_hash(A._BYTE[own]), begin, end)) + count.astype(np.uint64)
                yield ids[lo:hi], Runs(row, start, count, key, own, begin, end, content)

    return lambda batches: deal_runs(found(batches), spec, buckets, homes)


Strings = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]


def distinct_strings(length: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The number of each string, equal ones having one, and where each string begins in text."""
    offset = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offset), pa.py_buffer(text)])
    return strings.dictionary_encode().indices.to_numpy().astype(np.int64), offset[:-1]


def folded(spec: Spec, strings: Strings) -> tuple[Strings, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of equal strings those that may still be the first, and (doc, first window, windows) of the others, which repeat."""
    doc, start, count, length, key, text = strings
    one, begin = distinct_strings(length, text)
    by = np.lexsort((start, doc, one))
    head = np.append(True, one[by[1:]] != one[by[:-1]])
    lead = by[np.flatnonzero(head)[np.cumsum(head) - 1]]
    later = (doc[by] > doc[lead]) | ((doc[by] == doc[lead]) & (start[by] > start[lead]) & spec.within)
    stay, gone = np.sort(by[~later]), by[later]
    raw = b"".join([text[a:b] for a, b in zip(begin[stay].tolist(), (begin[stay] + length[stay]).tolist())])
    return (doc[stay], start[stay], count[stay], length[stay], key[stay], raw), (doc[gone], start[gone], count[gone])


def gatherer(spec: Spec, buckets: int, homes: int, repeats: Callable, fold_bytes: int = FOLD_BYTES) -> Callable:
    """A mapInArrow function over partitions sorted by bucket: packed spans by home.

    repeats(doc, start, count, length, key, text) gives (doc, first window, windows) of the repeated windows of a bucket.
    """

    def unpacked(packed: bytes) -> Strings:
        (doc, start, count, more, key), text = unpack(packed, KINDS)
        return np.cumsum(doc), start, count, more + count + (spec.k - 1), key, text

    def together(parts: list[Strings]) -> Strings:
        """All parts as one; the list is empty then, so that nothing is held twice."""
        *columns, texts = zip(*parts)
        parts.clear()
        return (*(np.concatenate(x) for x in columns), b"".join(texts))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, size, limit = -1, [], 0, fold_bytes
        for batch in batches:
            for b, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                if b != bucket:
                    if parts:
                        yield _dealt(*spans_by_home(*repeats(*together(parts)), homes))
                    bucket, size, limit = b, 0, fold_bytes
                if b >= buckets:
                    yield _dealt([b - buckets], [packed])
                    continue
                parts.append(unpacked(packed))
                size += len(parts[-1][5]) + 28 * len(parts[-1][0])
                if size > limit:
                    kept, known = folded(spec, together(parts))
                    yield _dealt(*spans_by_home(*known, homes))
                    parts.append(kept)
                    size = len(kept[5]) + 28 * len(kept[0])
                    limit = max(fold_bytes, 2 * size)  # so that a bucket of different strings isn't folded at every part
        if parts:
            yield _dealt(*spans_by_home(*repeats(*together(parts)), homes))

    return collect


def _spans_of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: its (first window, windows) pairs as int32."""
    for _, packed in _by_bucket(batches):
        parts = [unpack(x, SPANS)[0] for x in packed]
        doc = np.concatenate([np.cumsum(p[0]) for p in parts])
        start, count = (np.concatenate([p[i] for p in parts]) for i in range(1, 3))
        by = np.lexsort((start, doc))
        doc, raw = doc[by], np.stack((start[by], count[by]), 1).tobytes()
        heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        edge = np.append(heads, len(doc)) * 8
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[heads], pa.int64()), "spans": pa.array([raw[a:b] for a, b in zip(edge[:-1], edge[1:])], pa.binary())})


def repeated_spans(docs: DataFrame, spec: Spec, repeats: Callable, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, spans): the windows of each text that repeat, as int32 pairs (first window, windows).

    Windows of words travel at once.  Windows of bytes are many more: first only
    their minimisers travel, and then the strings of those that several documents have.
    Spans go back packed by home of their documents, and are a row for each document there.
    """
    bitmap, size = crowded_classes(docs, all_grams(spec))
    windows = 1 + (spec.k - spec.m + 1) / 2  # of a run, on average
    swell = 1 + (spec.k - 1) / windows
    homes = _count(size / HOME_TEXT)

    def by_bucket(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket")

    if spec.words:
        buckets = _count(size * swell / bucket_bytes)
        dealt = docs.mapInArrow(dealer(spec, bitmap, buckets, homes), DEALT)
    else:
        seen = docs.mapInArrow(_seen(spec, bitmap, _count(size / windows * 20 / bucket_bytes)), DEALT)
        runs = by_bucket(by_bucket(seen).mapInArrow(_shared(homes), DEALT)).mapInArrow(_of_documents, "doc_id long, runs binary")
        buckets = _count(size / bucket_bytes)
        dealt = docs.join(runs, "doc_id").select("doc_id", "text", "runs").mapInArrow(_shared_dealer(spec, buckets, homes), DEALT)
    met = by_bucket(dealt).mapInArrow(gatherer(spec, buckets, homes, repeats), DEALT)
    return by_bucket(met).mapInArrow(_spans_of_documents, "doc_id long, spans binary")


def _count(x: float) -> int:
    return max(1, min((1 << 30) - 1, round(x)))
