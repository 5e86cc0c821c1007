"""Benchmark decontamination: passages of texts within an edit budget of a benchmark item.

Method: q-gram lemma filtering.  A passage within e edits of an item of n bytes
shares n - q + 1 - q * e q-grams with it, on diagonals (place in the text less place
in the item) that differ by e at most.  Shared q-grams are counted in bands of 2e
diagonals that overlap by e; bands that reach the bound are verified by banded
alignment, all of a piece together.  Bytes are compared after A-Z are lower-cased
and runs of white space made one space.

Besides a whole item, of any length, its parts of ``PART`` bytes, one every ``STRIDE``
bytes, are looked for with the edits for their own length; so a text that quotes
PART + STRIDE - 1 bytes of a longer item word for word is always found.  A part's shared
q-grams are those of its item at its places: they are looked up once, and given to parts
only where neighbouring diagonals hold as many as a part needs.  A part that would lie
over a passage of the whole item isn't aligned.  Alignment keeps one row of a band at a
time, and takes as many bands together as ``CELLS`` allows.
Items of fewer than q bytes are matched exactly, where they don't go on as a word.

The items go to all tasks in blocks of ``BLOCK_BYTES`` at most: their size is
taken first, and a larger benchmark is scanned block by block.  A text is in one task
whole, which settles its overlapping passages too, so nothing is shuffled.

Results for odd input: null and empty texts and items match nothing; repeated rows and items each give rows; null ids are kept;
of overlapping passages of one item the nearest stays, of the whole item before those
of its parts; very long texts are pieces of their own; empty tables give empty ones; other
columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import arrays as A

Q = 8
#: Edits for each byte of an item.
RATE = 0.1
#: Bytes of the parts of a longer item, and from one part to the next.
PART, STRIDE = 128, 32
#: Shared q-grams that a part's passage has at least.
PART_BOUND = PART - Q + 1 - Q * int(PART * RATE)
#: Normalised bytes of items that are sent to a task, and shared q-grams that are held at a time.
BLOCK_BYTES, HELD = 4 << 20, 1 << 21
#: Bytes of texts that are aligned together, and a width of diagonals that a part's bands don't pass.
CELLS, COARSE = 1 << 18, 32
#: Bytes that a word goes on with.
WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
IN_WORD = np.zeros(256, bool)
IN_WORD[list(WORD)] = True
#: A byte that no UTF-8 text has.
OUTSIDE = 255
_TABLE_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes with single spaces, their offsets, and where each byte comes from."""
    space = A.SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[first] = True
    out = A.LOWER[data]
    out[space] = 32
    source = np.flatnonzero(keep)
    return out[source], np.concatenate(([0], np.cumsum(keep)))[offsets], source


def tally(keys: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of their counts (None: one each)."""
    if len(keys) == 1 and keys[0][1] is None:
        return np.unique(keys[0][0], return_counts=True)
    every, count = np.concatenate([k for k, _ in keys]), np.concatenate([c for _, c in keys])
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(count[order], first) if len(every) else count


def part_places(size: int) -> list[int]:
    """Where the parts of an item of that many normalised bytes start: none if it's PART at most."""
    last = size - PART
    return [*range(0, last, STRIDE), last] if last > 0 else []


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram at each place, as one number."""
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data.tobytes(), strides=(1,)) if len(data) >= Q else np.zeros(0, "<u8")


class Items:
    """A block of benchmark items, then their parts, and the places of the items' q-grams."""

    def __init__(self, texts: list[bytes]):
        raw = [normalised(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
        self.whole = len(raw)
        at = [part_places(len(x)) for x in raw]
        self.parts = np.array([len(x) for x in at], np.int64)
        self.first_part = self.whole + np.cumsum(self.parts) - self.parts
        self.of = np.concatenate((np.arange(self.whole), np.repeat(np.arange(self.whole), self.parts))).astype(np.int64)
        self.data = raw + [x[i : i + PART] for x, places in zip(raw, at) for i in places]
        self.size = np.array([len(x) for x in self.data], np.int64)
        self.edits = np.minimum((self.size * RATE).astype(np.int64), np.maximum(self.size - Q, 0) // Q)
        self.bound = self.size - Q + 1 - Q * self.edits
        self.width = 2 * np.maximum(self.edits, 1)
        gram = [grams(x) for x in raw]
        all_grams = np.concatenate(gram) if gram else np.zeros(0, "<u8")
        item = np.repeat(np.arange(len(raw)), [len(g) for g in gram])
        place = np.concatenate([np.arange(len(g)) for g in gram]) if gram else np.zeros(0, np.int64)
        order = np.argsort(all_grams, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first, self.count = np.unique(all_grams[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.grams * _ODD) >> np.uint64(64 - _TABLE_BITS)] = True

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The row, the place in it and the number (of self.grams) of each q-gram that items have."""
        gram = grams(data)
        at = np.flatnonzero(self.table[(gram * _ODD) >> np.uint64(64 - _TABLE_BITS)])
        which = np.minimum(np.searchsorted(self.grams, gram[at]), max(0, len(self.grams) - 1))
        hit = self.grams[which] == gram[at] if len(self.grams) else np.zeros(0, bool)
        at, which = at[hit], which[hit]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[row + 1]
        at, which, row = at[inside], which[inside], row[inside]
        return row, at - offsets[row], which

    def shared(self, row: np.ndarray, at: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Row, item, diagonal and place in the item of shared q-grams, HELD or about that at a time."""
        total = np.cumsum(self.count[which])
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + HELD, "right")))
            n = self.count[which[lo:hi]]
            posting = A.ranges(self.first[which[lo:hi]], n)
            place = self.place[posting]
            yield np.repeat(row[lo:hi], n), self.item[posting], np.repeat(at[lo:hi], n) - place, place
            lo = hi

    def counted(self, keys: list[np.ndarray], row: np.ndarray, entry: np.ndarray, diagonal: np.ndarray) -> None:
        """Adds the keys of the two bands that each shared q-gram is in."""
        width = self.width[entry]
        diagonal = diagonal + self.size[entry]
        base = (row * len(self.data) + entry) << 32
        for shift in (0, 1):
            keys.append(tally([(base | ((diagonal + shift * (width // 2)) // width) << 1 | shift, None)]))

    def bands(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, entry (an item or a part) and first diagonal (from the row's start) of the bands that reach the bound."""
        hits = self.hits(data, offsets)
        found, near = [], []
        span = np.int64(1) << 32
        for row, item, diagonal, _ in self.shared(*hits):
            self.counted(found, row, item, diagonal)
            own = self.parts[item] > 0
            near.append(tally([((row[own] * len(self.data) + item[own]) * span + (diagonal[own] + self.size[item[own]]) // COARSE + 1, None)]))
        # a part's bands lie in two neighbouring coarse ones
        if near:
            key, count = tally(near)
            enough = np.zeros(len(key), bool)
            pair = (key[1:] == key[:-1] + 1) & (count[1:] + count[:-1] >= PART_BOUND)
            enough |= count >= PART_BOUND
            enough[1:] |= pair
            enough[:-1] |= pair
            key = key[enough]
            if len(key):
                for row, item, diagonal, place in self.shared(*hits):
                    coarse = (row * len(self.data) + item) * span + (diagonal + self.size[item]) // COARSE + 1
                    own = (self.parts[item] > 0) & (key[np.minimum(np.searchsorted(key, coarse), len(key) - 1)] == coarse)
                    row, item, diagonal, place = row[own], item[own], diagonal[own], place[own]
                    regular = self.parts[item] - 1  # the last part ends with the item
                    high = np.minimum(place // STRIDE, regular - 1)
                    low = np.maximum(-((PART - Q - place) // STRIDE), 0)
                    n = np.maximum(high - low + 1, 0)
                    of, part = np.repeat(np.arange(len(row)), n), A.ranges(low, n)
                    last = np.flatnonzero(place >= self.size[item] - PART)
                    of, part = np.concatenate((of, last)), np.concatenate((part, regular[last]))
                    start = np.where(part == regular[of], self.size[item[of]] - PART, part * STRIDE)
                    self.counted(found, row[of], self.first_part[item[of]] + part, diagonal[of] + start)
        if not found:
            return (np.zeros(0, np.int64),) * 3
        key, count = tally(found)
        entry = (key >> 32) % len(self.data)
        key, entry = key[count >= self.bound[entry]], entry[count >= self.bound[entry]]
        shift = key & 1
        band = (key & 0xFFFFFFFF) >> 1
        return (key >> 32) // len(self.data), entry, band * self.width[entry] - shift * (self.width[entry] // 2) - self.size[entry]

    def aligned(self, data: np.ndarray, offsets: np.ndarray, row: np.ndarray, entry: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """align for any number of bands, those of like size together."""
        out = np.zeros((3, len(row)), np.int64)
        order = np.argsort(self.size[entry], kind="stable")
        lo = 0
        while lo < len(order):
            cells = self.size[entry[order[lo:]]] + 4 * self.edits[entry[order[lo:]]]
            hi = lo + max(1, int(np.searchsorted(cells * np.arange(1, len(cells) + 1), CELLS, "right")))
            own = order[lo:hi]
            out[:, own] = self.align(data, offsets, row[own], entry[own], diagonal[own])
            lo = hi
        return out[0], out[1], out[2]

    def align(self, data: np.ndarray, offsets: np.ndarray, row: np.ndarray, entry: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edits, start and end (from the row's start) of the best passage on each band and e diagonals either side."""
        length = offsets[row + 1] - offsets[row]
        edits, size = self.edits[entry], self.size[entry]
        low = diagonal - edits
        own_span = self.width[entry] + 2 * edits + 1
        span, longest = int(own_span.max()), int(size.max())
        item = np.zeros((len(entry), longest), np.uint8)
        text = np.full((len(entry), longest + span), OUTSIDE, np.uint8)
        for i, x in enumerate(entry):
            item[i, : size[i]] = self.data[x]
            a, b = max(0, int(low[i])), min(int(length[i]), int(low[i]) + longest + span)
            if a < b:
                text[i, a - low[i] : b - low[i]] = data[offsets[row[i]] + a : offsets[row[i]] + b]
        # edits times one, plus the diagonal where it began; in 32 bits where all of it fits
        small = longest <= 4096
        kind, bits = (np.int32, 16) if small else (np.int64, 32)
        one, big = kind(1 << bits), kind(1 << 29 if small else 1 << 60)
        across = np.arange(span, dtype=kind)
        outside = across[None, :] >= own_span[:, None]
        start = low[:, None] + across
        score = np.where(~outside & (start >= 0) & (start <= length[:, None]), across, big).astype(kind)
        beyond = text == OUTSIDE
        rise = across * one
        best, where = np.full(len(entry), big, kind), np.zeros(len(entry), np.int64)
        ends = set(size.tolist())
        for i in range(1, longest + 1):
            along = score + (text[:, i - 1 : i - 1 + span] != item[:, i - 1 : i]) * one
            along[beyond[:, i - 1 : i - 1 + span]] = big
            np.minimum(along[:, :-1], score[:, 1:] + one, out=along[:, :-1])
            along -= rise
            np.minimum.accumulate(along, axis=1, out=along)
            along += rise
            np.minimum(along, big, out=along)
            along[outside] = big
            score = along
            if i in ends:
                done = np.flatnonzero(size == i)
                where[done] = score[done].argmin(1)
                best[done] = score[done, where[done]]
        return (best >> bits).astype(np.int64), low + (best & (one - 1)), low + size + where

    def short(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and start (from the row's start) of each item of fewer than Q bytes that isn't a part of a longer word."""
        found = []
        raw = data.tobytes() if (self.size < Q).any() else b""
        for item in np.flatnonzero((self.size[: self.whole] > 0) & (self.size[: self.whole] < Q)).tolist():
            own = self.data[item].tobytes()
            at = np.array([m.start() for m in re.finditer(b"(?=" + re.escape(own) + b")", raw)], np.int64)
            row = np.searchsorted(offsets, at, "right") - 1
            end = at + len(own)
            good = end <= offsets[row + 1]
            if own[0] in WORD:
                good &= (at == offsets[row]) | ~IN_WORD[data[np.maximum(at - 1, 0)]]
            if own[-1] in WORD:
                good &= (end >= offsets[row + 1]) | ~IN_WORD[data[np.minimum(end, len(data) - 1)]]
            found += [(r, item, a) for r, a in zip(row[good].tolist(), (at - offsets[row])[good].tolist())]
        return tuple(np.array([x[k] for x in found], np.int64) for k in range(3))


def parts(text: bytes) -> list[bytes]:
    """The parts of an item of more than PART normalised bytes."""
    data = normalised(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tobytes()
    return [data[i : i + PART] for i in part_places(len(data))]


class Passages:
    """The passages of one item in one text that are kept, none over another: given from the nearest on, each stays where it's free."""

    def __init__(self):
        self.starts, self.ends = [], []

    def covers(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start

    def add(self, start: int, end: int) -> bool:
        if self.covers(start, end):
            return False
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def scanner(texts: list[bytes], names: pa.Array):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(texts)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            all_data, all_offsets = A.flat(batch.column("text"))
            for lo, hi in A.pieces(all_data, all_offsets, rows=(1 << 31) // max(1, len(items.data))):  # row and entry share 31 bits
                raw, at = all_data[all_offsets[lo] : all_offsets[hi]], all_offsets[lo : hi + 1] - all_offsets[lo]
                row, item, start, end, edits = passages(items, raw, at)
                if len(row):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[lo + row], pa.int64()), "item_id": names.take(pa.array(item, pa.int64())), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64()), "edits": pa.array(edits, pa.int64())})

    return scan


def passages(items: Items, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Row, item, start and end (code points of the row) and edits of the passages of texts that are kept."""
    data, offsets, source = normalised(raw, at)
    source_end = np.append(source, len(raw))
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    rows, entries, diagonals = items.bands(data, offsets)
    kept: dict[tuple[int, int], Passages] = {}
    taken: dict[tuple[int, int], Passages] = {}  # the whole items' ones, in normalised bytes
    out: list[tuple[int, ...]] = []

    def settle(row, entry, edits, start, end) -> None:
        good = (edits <= items.edits[entry]) & (end > start)
        row, entry, edits, start, end = (x[good] for x in (row, entry, edits, start, end))
        item = items.of[entry]
        begin = lead[source[offsets[row] + start]] - lead[at[row]]
        stop = lead[source_end[offsets[row] + end - 1] + 1] - lead[at[row]]
        for i in np.lexsort((stop, begin, edits)).tolist():
            key = (int(row[i]), int(item[i]))
            if kept.setdefault(key, Passages()).add(int(begin[i]), int(stop[i])):
                out.append((*key, int(begin[i]), int(stop[i]), int(edits[i])))
                taken.setdefault(key, Passages()).add(int(start[i]), int(end[i]))

    whole = entries < items.whole
    row, entry, start = items.short(data, offsets)
    edits, begin, stop = items.aligned(data, offsets, rows[whole], entries[whole], diagonals[whole])
    settle(*(np.concatenate(x) for x in ((rows[whole], row), (entries[whole], entry), (edits, np.zeros_like(start)), (begin, start), (stop, start + items.size[entry]))))
    # a part's passage starts at the latest, and ends at the earliest, at these bytes; 4 bytes are a character at most
    rows, entries, diagonals = rows[~whole], entries[~whole], diagonals[~whole]
    late, early = diagonals + items.width[entries] + items.edits[entries] + 4, diagonals - items.edits[entries] + PART - 4
    free = np.array([not ((own := taken.get((r, i))) and own.covers(a, b)) for r, i, a, b in zip(rows.tolist(), items.of[entries].tolist(), late.tolist(), early.tolist())], bool)
    rows, entries, diagonals = rows[free], entries[free], diagonals[free]
    settle(rows, entries, *items.aligned(data, offsets, rows, entries, diagonals))
    return [*np.array(sorted(out), np.int64).reshape(-1, 5).T]


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, start, end (code points of the text) and edits of each passage near a benchmark item."""
    docs = A.documents(df, id_col, text_col)
    bench = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    pieces = F.when(F.octet_length("text") > PART, F.ceil((F.octet_length("text") - PART) / STRIDE) + 1).otherwise(0)
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 64 + pieces * (PART + 64)), F.lit(0)).alias("n")).first().n
    blocks = -(-size // block_bytes)
    field = benchmark.schema[item_col].dataType
    schema = f"doc_id long, item_id {field.simpleString()}, start long, end long, edits long"
    found = []
    for block in range(blocks):
        own = bench.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block) if blocks > 1 else bench
        items = own.orderBy("item_id", "text").collect()  # block_bytes or about that
        names = pa.array([r.item_id for r in items], to_arrow_type(field))
        found.append(docs.mapInArrow(scanner([r.text.encode() for r in items], names), schema))
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, found).select(A.outer_id(), "item_id", "start", "end", "edits")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
