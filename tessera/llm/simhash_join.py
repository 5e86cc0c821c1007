"""SimHash near-duplicates: 64-bit fingerprints that differ in a few bits, and their classes.

Method: byte-position inverted index with count filtering.  A fingerprint is eight
positional bytes.  Two that differ in ``BITS`` = 3 bits or fewer share the byte at five
positions at least.  Posting lists are kept for three positional bytes at a time: of
five positions that agree, three are in the same half of the fingerprint, so the four
triples of each half (eight lists for a fingerprint) make every such pair meet.  In a list the
shared positional bytes of each pair are tallied; pairs that reach five are verified by
their differing bits.  A long list is cut by two more positional bytes (ten lists of five
bytes, as five agree); in one that is still long the at most 2,324 fingerprints near each
are looked up instead of pairing all.  Lists longer than a task's share are cut so before the shuffle.

Equal fingerprints are one throughout, and a list gives the links of a spanning forest,
so a group of copies costs what its different fingerprints cost and no pair is lost to
the classes.

Results for odd input: a null or empty text, or one without words, has fingerprint zero
and is linked like any other; a text of one or two words has its whole sequence as its
shingle; a very long text is hashed in pieces of bounded size; repeated rows are copies of each other;
each row with a null id is a document of its own after all others and comes back null,
its class too if it has no id in it; an empty table gives an empty one; other columns
are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .components import components
from .jaccard_join import HEAVY_KEYS, with_size
from .storage import apart, given_id, saved
from .superkmer import text_pieces

WIDTH, SEED, BITS, SHARED = 3, 42, 3, 5
#: Fingerprints of a posting list that are paired; longer lists are cut by two more bytes.
PAIRED = 256
#: A list longer than this is cut before the shuffle (longer where more than HEAVY_KEYS lists would be).
CROWDED = 1024
#: Shingles whose bits are held at a time.
HELD = 1 << 17
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
#: Two more positions for a list of each triple.
MORE = [list(combinations([p for p in range(8) if p not in t], 2)) for t in TRIPLES]
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of each row (uint64)."""
    low = A.LOWER[data]
    begin, end, row = A.words(low, offsets)
    n = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(first)
    text, at = A.joined(low, begin, end)
    text = text.tobytes()
    number = np.where(count >= width, count - width + 1, count > 0).astype(np.int64)
    head = A.ranges(first[:-1], number)
    of = np.repeat(np.arange(n), number)
    tail = np.where(count[of] < width, first[1:][of] - 1, head + width - 1)
    start, stop = at[head] if len(head) else head, at[tail] + (end - begin)[tail] if len(head) else tail
    sums = np.zeros((n, 64), np.int64)
    hashed = xxhash.xxh64_intdigest
    for lo in range(0, len(head), HELD):
        part = slice(lo, lo + HELD)
        h = np.array([hashed(text[a:b], SEED) for a, b in zip(start[part].tolist(), stop[part].tolist())], np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        new = np.flatnonzero(np.diff(of[part], prepend=-1))
        sums[of[part][new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > number[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprinted(width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, data, offsets in text_pieces(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "fp": pa.array(fingerprints(data, offsets, width).view(np.int64), pa.int64())})

    return of


class Forest:
    """Links among numbered fingerprints that join classes not yet joined."""

    def __init__(self, n: int):
        self.top = np.arange(n)
        self.a: list[int] = []
        self.b: list[int] = []

    def _root(self, x: int) -> int:
        while self.top[x] != x:
            self.top[x] = self.top[self.top[x]]
            x = self.top[x]
        return x

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.top[i] != self.top[j]
        if not apart.any():
            return
        for x, y in zip(i[apart].tolist(), j[apart].tolist()):
            p, q = self._root(x), self._root(y)
            if p != q:
                self.top[max(p, q)] = min(p, q)
                self.a.append(x)
                self.b.append(y)
        while True:  # every number points at its class again
            up = self.top[self.top]
            if (up == self.top).all():
                return
            self.top = up


def tally(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs share enough positional bytes and differ in few enough bits."""
    out = (x ^ y).view(np.uint8).reshape(-1, 8)
    enough = (out == 0).sum(1) >= SHARED
    enough[enough] = _ONES[out[enough]].sum(1) <= BITS
    return enough


def pair_lists(forest: Forest, numbers: np.ndarray, values: np.ndarray, ends: np.ndarray) -> None:
    """Pairs of each posting list: numbers and values one list after the other, and where each list ends."""
    last = np.repeat(ends, np.diff(ends, prepend=0))
    i = np.arange(len(values))
    away = 1
    while len(i := i[i + away < last[i]]):
        for lo in range(0, len(i), HELD):
            part = i[lo : lo + HELD]
            near = part[tally(values[part], values[part + away])]
            forest.link(numbers[near], numbers[near + away])
        away += 1


def near_lists(forest: Forest, numbers: np.ndarray, values: np.ndarray, positions: tuple[int, ...]) -> None:
    """Links of a long list whose values (ordered, distinct) agree at all but ``positions``: the values near each are looked up."""
    bits = [8 * p + b for p in positions for b in range(8)]
    for k in range(1, BITS + 1):
        for flipped in combinations(bits, k):
            mask = np.uint64(sum(1 << b for b in flipped))
            other = values ^ mask
            at = np.minimum(np.searchsorted(values, other), len(values) - 1)
            there = np.flatnonzero((values[at] == other) & (values < other))
            forest.link(numbers[there], numbers[at[there]])


def byte(values: np.ndarray, position: int) -> np.ndarray:
    return values >> np.uint64(8 * position) & np.uint64(255)


def long_list(forest: Forest, numbers: np.ndarray, values: np.ndarray, shared: tuple[int, ...]) -> None:
    """A list too long to pair, cut by two more positions; ``shared`` are the positions that agree in all of it."""
    rest = [p for p in range(8) if p not in shared]
    if len(shared) >= SHARED:
        near_lists(forest, numbers, values, tuple(rest))
        return
    for p, q in combinations(rest, 2):
        key = byte(values, p) << np.uint64(8) | byte(values, q)
        order = np.lexsort((values, key))
        ends = np.append(np.flatnonzero(np.diff(key[order])) + 1, len(order))
        lists(forest, numbers[order], values[order], ends, [(*shared, p, q)] * len(ends))


def lists(forest: Forest, numbers: np.ndarray, values: np.ndarray, ends: np.ndarray, shared: list[tuple[int, ...]]) -> None:
    size = np.diff(ends, prepend=0)
    short = np.repeat(size <= PAIRED, size)
    pair_lists(forest, numbers[short], values[short], np.cumsum(size[size <= PAIRED]))
    for k in np.flatnonzero(size > PAIRED).tolist():
        part = slice(ends[k] - size[k], ends[k])
        long_list(forest, numbers[part], values[part], shared[k])


def _shared(key: int) -> tuple[int, ...]:
    """The positions that agree in a list, from its key."""
    kind = key & 127
    return (*TRIPLES[kind >> 4], *(MORE[kind >> 4][(kind & 15) - 1] if kind & 15 else ()))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (key, fp) ordered by both: links of the lists; a list may go on in the next batch."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
        several = np.diff(ends, prepend=0) > 1
        keep = np.repeat(several, np.diff(ends, prepend=0))
        size = np.diff(ends, prepend=0)[several]
        starts = ends[several] - 1
        shared, fp = [_shared(k) for k in key[starts].tolist()], fp[keep]
        nodes, numbers = np.unique(fp, return_inverse=True)
        forest = Forest(len(nodes))
        lists(forest, numbers, fp, np.cumsum(size), shared)
        return pa.RecordBatch.from_pydict({"a": pa.array(nodes[forest.a].view(np.int64) if forest.a else [], pa.int64()), "b": pa.array(nodes[forest.b].view(np.int64) if forest.b else [], pa.int64())})

    held, bound = [(key, fp)], HELD
    for batch in batches:
        held.append((batch.column("key").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
        if sum(len(k) for k, _ in held) >= bound:
            key, fp = (np.concatenate(x) for x in zip(*held))
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield links(key[:whole], fp[:whole])
            held = [(key[whole:], fp[whole:])]
            bound = max(HELD, 2 * (len(key) - whole))  # a long list is copied a few times only
    key, fp = (np.concatenate(x) for x in zip(*held))
    if len(key):
        yield links(key, fp)


def _key(kind: int, positions: tuple[int, ...]):
    """The bytes at some positions and the kind of list, as one number."""
    out = F.lit(0).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255)))
    return F.shiftleft(out, 7).bitwiseOR(F.lit(kind).cast("long")).alias("key")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links of different fingerprints (fp), enough of them for the classes of all links."""
    rows = distinct.select("fp", F.explode(F.array(*(_key(i << 4, t) for i, t in enumerate(TRIPLES)))).alias("key"))
    limit = max(CROWDED, -(-len(TRIPLES) * distinct.count() // HEAVY_KEYS))  # HEAVY_KEYS lists at most are longer
    crowded = F.broadcast(saved(rows.groupBy("key").count().where(F.col("count") > limit).select("key")))
    finer = F.array()
    for i, t in enumerate(TRIPLES):
        own = F.array(*(_key(i << 4 | j + 1, (*t, *two)) for j, two in enumerate(MORE[i])))
        finer = own if i == 0 else F.when(F.col("key").bitwiseAND(127) == i << 4, own).otherwise(finer)
    long = rows.join(crowded, "key", "left_semi").select("fp", F.explode(finer).alias("key"))
    every = rows.join(crowded, "key", "left_anti").select("fp", "key").unionAll(long)
    return every.repartition("key").sortWithinPartitions("key", F.col("fp") < 0, "fp").select("key", "fp").mapInArrow(_linked, "a long, b long")


def simhash_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) and component_id: the smallest id that links lead to, itself included."""
    df, low = apart(df.select(id_col, text_col), id_col)
    docs = A.documents(df, id_col, text_col)
    ids = saved(docs.mapInArrow(_fingerprinted(width), "doc_id long, fp long"))
    least = saved(ids.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    classes = components(fingerprint_links(least.select("fp")))
    own = saved(least.join(classes, least["fp"] == classes["node"], "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("root")))
    tops = saved(own.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("sets")))
    named = saved(with_size(own, "root", tops).select("fp", "component_id", F.col("copies").alias("sets")))
    out = with_size(ids, "fp", named)
    return out.select(given_id(low), "fp", given_id(low, "component_id"))


def op12_simhash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
