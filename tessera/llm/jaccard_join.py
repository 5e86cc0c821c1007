"""N-gram Jaccard join: links between texts whose shingle sets are similar, and their classes.

Method: prefix-tree join.  A set is its texts' distinct shingles of five words; all
sets are ordered by one global order (crowded hash classes last, then the hash).
Neighbours in a set's order make its links of two shingles.  Between two sets that
have c shingles in common, each shingle that only one has parts one pair of common
neighbours at most, so they have c - 1 less those links in common: ``least_links`` of n.
So the first of their common links, in one global order of links, is among the
first (n - 1) - least_links(n) + 1 links of each, its prefix.  One shingle that unrelated
texts happen to share makes no common link, so few unrelated sets meet.
For each prefix link the sets that have it gather around
one of them, its hub; a set has few hubs, as near copies share most links, so it
goes to a few clusters and not to one for each link, and two sets with a common
prefix link still meet in a cluster.  A cluster whose sets all are in another one
too is left out.  In each that remains the sets are stored in a
trie (frequent shingles first, so that near copies share long paths).  A query
walks it, adding up what it shares with each path once for all sets below, and
leaves a subtree when the shingles that remain can't reach the least overlap.  The
hub is the first query; sets that it links are in its class, and only the others
are queries in their turn, which leave out subtrees of sets that are in their class
already.  A cluster gives the links of a spanning forest: fewer than its sets.

Equal sets are one set throughout (a 64-bit fingerprint and the size stand for
it).  Crowded links (of two crowded shingles) get their hub by a combining aggregate and
joins instead of a bucket: links of very many sets by a broadcast table of ``HEAVY_KEYS``
rows at most, the others by a shuffle; pairs find the size of their hub's cluster likewise.  A cluster of more than ``BLOCK`` sets is cut into
blocks, each with the hub; a set that isn't in the hub's class after its own block is
compared with every other block (those that are need no link to each other).

Sets are told apart by 63 bits: among N different sets two are taken as equal with a
chance of about N * N / 2**64 (10**9 sets: one in 18; beyond 10**10 a few pairs are to be expected).
Shingles inside the tries are told apart by 48 bits (see the README).

Results for odd input: a null text, or one without words, has an empty set and
links with nothing; a text of fewer than five words has its whole sequence as its
shingle; a very long text is one set, in a piece of its own; repeated rows are copies of
each other; each row with a null id is a document of its own after all others and
comes back null, its class too if it has no id in it; an empty table gives an empty one;
of equal priorities the smaller set id is the hub; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .components import components
from .storage import apart, given_id, saved
from .superkmer import CLASS_BITS, SEGMENT_BITS, crowded_classes, flags, pack, text_pieces, unpack

SHINGLE, PERCENT = 5, 80
#: Bytes of text for each bucket of prefix shingles, and sets in a block of a cluster.
BUCKET_TEXT, BLOCK = 32 << 20, 512
#: A crowded link or a hub is heavy above this many sets (HEAVY_SETS), or more, so that there are HEAVY_KEYS of them at most.
HEAVY_SETS, HEAVY_KEYS = 1024, 100_000
_SHORT = np.uint64(0x5851F42D4C957F2D)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle, repeats included, in order of rows."""
    low = A.LOWER[data]
    begin, end, row = A.words(low, offsets)
    n = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(first)
    prefix = A.prefix_hash(A.word_hashes(low, begin, end))
    short = (count > 0) & (count < width)
    number = np.where(short, 1, np.maximum(count - width + 1, 0))
    at = A.ranges(first[:-1], number)
    of = np.repeat(np.arange(n), number)
    last = np.where(short[of], first[1:][of], at + width)
    salt = np.where(short[of], _SHORT * count[of].astype(np.uint64), np.uint64(0))
    return of, A.mixed(A.range_hash(prefix, at, last) + salt) if len(at) else np.zeros(0, np.uint64)


def hashes_for(width: int) -> Callable:
    return lambda data, offsets: shingles(data, offsets, width)[1]


class Sets:
    """The ordered sets of a piece: ordered shingles, first of each row, sizes and set ids (0 for an empty set)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, crowded: np.ndarray | None):
        row, value = shingles(data, offsets, width)
        order = value >> np.uint64(1)
        if crowded is not None:
            order |= crowded[(value >> np.uint64(64 - CLASS_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
        by = np.lexsort((order, row))
        row, order = row[by], order[by]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (order[1:] != order[:-1])
        self.row, self.order = row[new], order[new]
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))
        self.size = np.diff(self.first)
        sums = np.append(np.uint64(0), np.cumsum(A.mixed((self.order << np.uint64(1)) ^ _SHORT)))
        total = sums[self.first[1:]] - sums[self.first[:-1]]
        self.id = np.where(self.size > 0, A.mixed(total + self.size.astype(np.uint64) * _SHORT) | np.uint64(1), np.uint64(0)).view(np.int64)


def _ids(width: int):
    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, data, offsets in text_pieces(batches):
            sets = Sets(data, offsets, width, None)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "n": pa.array(sets.size, pa.int64()), "sid": pa.array(sets.id, pa.int64())})

    return ids


def least_links(n, percent: int):
    """The links that a set of n shingles has in common with any set that it links with, at least."""
    return -(-n * (2 * percent - 100) // 100) - 1


def _prefixes(sets: Sets, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links in the prefix of each distinct set that may link with another, and set id, size and prefix length of each."""
    _, one = np.unique(sets.id, return_index=True)
    one = one[sets.size[one] * (100 - percent) >= percent]  # fewer shingles than that: only an equal set would do
    size = sets.size[one]
    at = A.ranges(sets.first[one], size - 1)
    owner = np.repeat(np.arange(len(one)), size - 1)
    link = (A.mixed(A.mixed(sets.order[at]) + sets.order[at + 1]) >> np.uint64(1)) | (sets.order[at] & _CROWDED)
    link = link[np.lexsort((link, owner))]
    length = np.minimum(size - 1, size - least_links(size, percent))
    return link[A.ranges(np.cumsum(size - 1) - (size - 1), length)], sets.id[one], size, length


_CROWDED = np.uint64(1) << np.uint64(63)
#: Set ids, sizes, number of links of each, and 32 bits of the links (which the bucket completes; a false match only adds a candidate).
_KINDS = [np.int64, np.int32, np.int32, np.uint32]


def _prefix_dealer(width: int, percent: int, bitmap: bytes, buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = flags(bitmap)
        for _, data, offsets in text_pieces(batches):
            token, sid, size, length = _prefixes(Sets(data, offsets, width, crowded), percent)
            owner = np.repeat(np.arange(len(sid)), length)
            keep = token < _CROWDED
            token, owner = A.mixed(token[keep]), owner[keep]
            home = (token % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(home, kind="stable")
            home, token, owner = home[by], (token[by] >> np.uint64(32)).astype(np.uint32), owner[by]
            edge = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else np.zeros(0, np.int64)
            out = []
            for a, b in zip(edge, np.append(edge[1:], len(home))):
                own, count = np.unique(owner[a:b], return_counts=True)
                out.append(pack([sid[own], size[own].astype(np.int32), count.astype(np.int32), token[a:b]], b""))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(home[edge], pa.int32()), "packed": pa.array(out, pa.binary())})

    return deal


def _crowded_rows(width: int, percent: int, bitmap: bytes):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = flags(bitmap)
        for _, data, offsets in text_pieces(batches):
            token, sid, _, length = _prefixes(Sets(data, offsets, width, crowded), percent)
            sid = np.repeat(sid, length)
            keep = token >= _CROWDED
            if keep.any():
                yield pa.RecordBatch.from_pydict({"token": pa.array(token[keep].view(np.int64), pa.int64()), "sid": pa.array(sid[keep], pa.int64()), "priority": pa.array(A.mixed(sid[keep].view(np.uint64)).view(np.int64), pa.int64())})

    return rows


def hub_pairs(token: np.ndarray, sid: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hub and member (the hub is a member too); sets whose sizes can't link are kept apart."""
    by = np.lexsort((sid, size, token))
    token, sid, size = token[by], sid[by], size[by].astype(np.int64)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
    token, sid, size = token[new], sid[new], size[new]
    head = np.ones(len(token), bool)
    head[1:] = (token[1:] != token[:-1]) | (100 * size[:-1] < percent * size[1:])
    heads = np.flatnonzero(head)
    count = np.diff(np.append(heads, len(token)))
    keep = np.repeat(count > 1, count)
    sid, size, heads, count = sid[keep], size[keep], np.cumsum(count[count > 1]) - count[count > 1], count[count > 1]
    if not len(sid):
        return sid, sid
    priority = A.mixed(sid.view(np.uint64))
    lowest = np.repeat(np.minimum.reduceat(priority, heads), count)
    hub = np.repeat(sid[priority == lowest], count)
    by = np.lexsort((sid, hub))
    hub, sid = hub[by], sid[by]
    heads = np.flatnonzero(np.append(True, (hub[1:] != hub[:-1]) | (sid[1:] != sid[:-1])))
    return hub[heads], sid[heads]


PAIRS = "hub long, sid long"


def _bucket_pairs(percent: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[bytes]) -> pa.RecordBatch:
            parts = [unpack(p, _KINDS)[0] for p in held]
            token = np.concatenate([p[3] for p in parts])
            sid, size = (np.concatenate([np.repeat(p[i], p[2]) for p in parts]) for i in range(2))
            return pa.RecordBatch.from_pydict(dict(zip(("hub", "sid"), (pa.array(x, pa.int64()) for x in hub_pairs(token, sid, size, percent)))))

        bucket, held = -1, []
        for batch in batches:
            for b, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                if b != bucket and held:
                    yield found(held)
                    held = []
                bucket = b
                held.append(packed)
        if held:
            yield found(held)

    return pairs


def wanted_bitmap(sids: DataFrame) -> bytes:
    """A bitmap, of fixed size, of the hash classes that hold one of the set ids."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << CLASS_BITS + 2, bool)
        for batch in batches:
            bits[_class(batch.column("sid").to_numpy(zero_copy_only=False))] = True
        parts = bits.reshape(-1, 1 << SEGMENT_BITS)
        full = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_pydict({"segment": pa.array(full, pa.int32()), "bits": pa.array([np.packbits(parts[i]).tobytes() for i in full], pa.binary())})

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, bits in zip(batch.column("segment").to_pylist(), batch.column("bits").to_pylist()):
                out[segment] = out.get(segment, 0) | np.frombuffer(bits, np.uint8)
        if out:
            yield pa.RecordBatch.from_pydict({"segment": pa.array(list(out), pa.int32()), "bits": pa.array([x.tobytes() for x in out.values()], pa.binary())})

    rows = sids.mapInArrow(mark, "segment int, bits binary").repartition("segment").mapInArrow(either, "segment int, bits binary").collect()  # 2**(CLASS_BITS + 2 - SEGMENT_BITS) rows at most
    bits = {r.segment: bytes(r.bits) for r in rows}
    return b"".join(bits.get(i, bytes(1 << SEGMENT_BITS - 3)) for i in range(1 << CLASS_BITS + 2 - SEGMENT_BITS))


def _class(sid: np.ndarray) -> np.ndarray:
    return (A.mixed(sid.view(np.uint64)) >> np.uint64(64 - CLASS_BITS - 2)).astype(np.int64)


def _wanted_sets(width: int, bitmap: bytes):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = flags(bitmap)
        for doc, data, offsets in text_pieces(batches):
            own = Sets(data, offsets, width, None)
            by = np.lexsort((doc, own.id))
            one = by[np.append(True, own.id[by[1:]] != own.id[by[:-1]])]  # of each set the smallest document
            one = one[(own.size[one] > 0) & wanted[_class(own.id[one])]]
            if len(one):
                yield pa.RecordBatch.from_pydict({"sid": pa.array(own.id[one], pa.int64()), "least": pa.array(doc[one], pa.int64()), "members": pa.array([packed_shingles(own.order[own.first[i] : own.first[i + 1]]) for i in one], pa.binary())})

    return sets


def packed_shingles(order: np.ndarray) -> bytes:
    """The upper 48 bits of 62-bit hashes, which tell the shingles of a few sets apart; the least first."""
    values = np.unique((order << np.uint64(1)) >> np.uint64(16))
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked_shingles(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class Trie:
    """Sets as paths of shingles, frequent ones first; equal beginnings are one path."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        flat = np.concatenate(sets)
        _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int32)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.int32)
        edge = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        ranked = rank[inverse]
        self.paths = [np.sort(ranked[a:b]) for a, b in zip(edge[:-1], edge[1:])]
        self.width = len(count)
        self.order = sorted(range(len(sets)), key=lambda i: self.paths[i].astype(">i4").tobytes())
        self.size = np.array([len(self.paths[i]) for i in self.order])
        self.shared = [0]
        for i, j in zip(self.order, self.order[1:]):
            a, b = self.paths[i], self.paths[j]
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            self.shared.append(int(differ.argmax()) if differ.any() else n)
        self.shared.append(0)
        self.root = list(range(len(sets)))
        self.classes = len(sets)
        self.nodes = self._build()
        self.one_class = [-1] * len(self.nodes)

    def _build(self) -> list[tuple]:
        """(depth of its first shingle, depth after its last, a set below, children, least and largest size below, number of the set that ends here or -1)."""
        nodes: list[list] = [[0, 0, -1, [], 1 << 40, 0, -1]]
        stack = [0]
        for at in range(len(self.order)):
            keep = self.shared[at]
            last = -1
            while nodes[stack[-1]][1] > keep:
                last = stack.pop()
            top = stack[-1]
            if last >= 0 and nodes[top][1] < keep:  # the path parts inside the last node: cut it
                nodes.append([nodes[last][0], keep, nodes[last][2], [last], 0, 0, -1])
                cut = len(nodes) - 1
                nodes[top][3][nodes[top][3].index(last)] = cut
                nodes[last][0] = keep
                stack.append(cut)
                top = cut
            n = len(self.paths[self.order[at]])
            if nodes[top][1] == n and top:
                nodes[top][6] = at  # ends where another goes on (equal sets don't occur)
            else:
                nodes.append([nodes[top][1], n, at, [], 0, 0, at])
                nodes[top][3].append(len(nodes) - 1)
                stack.append(len(nodes) - 1)
        done: list[int] = []
        todo = [0]
        while todo:
            x = todo.pop()
            done.append(x)
            todo += nodes[x][3]
        for x in reversed(done):
            sizes = [self.size[nodes[x][6]]] if nodes[x][6] >= 0 else []
            low, high = [nodes[c][4] for c in nodes[x][3]] + sizes, [nodes[c][5] for c in nodes[x][3]] + sizes
            nodes[x][4], nodes[x][5] = int(min(low)), int(max(high))
        self.upward = done[::-1]
        return [tuple(x) for x in nodes]

    def top(self, x: int) -> int:
        """The set that stands for the class of x, by the links so far."""
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def joined(self, x: int, y: int) -> bool:
        """Puts the classes of x and y together; whether they were apart."""
        x, y = self.top(x), self.top(y)
        self.root[max(x, y)] = min(x, y)
        self.classes -= x != y
        return x != y

    def note_classes(self) -> None:
        """Notes the subtrees whose sets are all in one class; as classes only grow, they stay so."""
        for x in self.upward:
            below = {self.one_class[c] if self.one_class[c] < 0 else self.top(self.one_class[c]) for c in self.nodes[x][3]}
            if self.nodes[x][6] >= 0:
                below.add(self.top(self.order[self.nodes[x][6]]))
            self.one_class[x] = below.pop() if len(below) == 1 else -1

    def query(self, which: int) -> list[int]:
        """The sets that link with set ``which``, but for those of subtrees noted to be in its class."""
        own = self.paths[which]
        n, p = len(own), self.percent
        inside = np.zeros(self.width, bool)
        inside[own] = True
        found, todo = [], [(c, 0) for c in self.nodes[0][3]]
        while todo:
            x, overlap = todo.pop()
            start, end, some, children, low, high, here = self.nodes[x]
            if self.one_class[x] >= 0 and self.top(self.one_class[x]) == self.top(which):
                continue
            if 100 * high < p * n or 100 * n < p * low:
                continue
            path = self.paths[self.order[some]]
            overlap += int(np.count_nonzero(inside[path[start:end]]))
            # what is left of the query comes after the last shingle of the path
            left = min(n - int(np.searchsorted(own, path[end - 1], "right")), high - end)
            if (100 + p) * (overlap + left) < p * (n + low):
                continue
            if here >= 0 and self.order[here] != which and 100 * overlap >= p * (n + int(self.size[here]) - overlap):
                found.append(self.order[here])
            todo += [(c, overlap) for c in children]
        return found


def linked(sets: list[np.ndarray], first: list[int], percent: int, queries: set[int] | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """Links of a spanning forest of the classes of all links among the sets, and the sets outside the class of ``first``.

    Queries are ``first`` (one set or none) and then all others that it doesn't link; or only ``queries``.
    """
    if len(sets) < 2:
        return [], []
    trie = Trie(sets, percent)
    links, near = [], set(first)
    for q in first:
        near.update(trie.query(q))
        links += [(q, x) for x in near if trie.joined(q, x)]
    rest = [q for q in range(len(sets)) if q not in near] if queries is None else sorted(queries)
    for n, q in enumerate(rest):
        if trie.classes == 1:
            break
        if n & (n - 1) == 0:
            trie.note_classes()
        links += [(q, x) for x in trie.query(q) if trie.joined(q, x)]
    return links, [x for x in range(len(sets)) if not first or trie.top(x) != trie.top(first[0])]


CELLS = ["hub", "block", "asking", "blocks", "sid", "least", "role", "members"]
LINKS = "hub long, blocks int, a long, b long, open long"


def _clusters(percent: int):
    """mapInArrow over CELLS sorted by hub, block and asking. role: 0 hub, 1 member, 2 a query of the block ``asking`` (else -1).

    Gives links (a, b) between the smallest documents of sets, and with several blocks the sets (open) that other blocks are to be asked for.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(hub: int, blocks: int, rows: dict[int, tuple[int, int, bytes]]) -> pa.RecordBatch:
            sids, least = list(rows), [x[1] for x in rows.values()]
            sets = [unpacked_shingles(x[2]) for x in rows.values()]
            asked = {i for i, x in enumerate(rows.values()) if x[0] == 2}
            first = [i for i, x in enumerate(rows.values()) if x[0] == 0]
            links, outside = linked(sets, [], percent, asked) if asked else linked(sets, first, percent)
            open_ = [sids[i] for i in outside] if blocks > 1 and not asked else []
            n, none = len(links) + len(open_), [None] * len(open_)
            a, b = [least[x] for x, _ in links], [least[y] for _, y in links]
            return pa.RecordBatch.from_pydict({"hub": pa.array([hub] * n, pa.int64()), "blocks": pa.array([blocks] * n, pa.int32()), "a": pa.array(a + none, pa.int64()), "b": pa.array(b + none, pa.int64()), "open": pa.array([None] * len(links) + open_, pa.int64())})

        key, held = None, {}
        for batch in batches:
            for hub, block, asking, blocks, sid, least, role, members in zip(*(batch.column(c).to_pylist() for c in CELLS)):
                if (hub, block, asking, blocks) != key and held:
                    yield found(key[0], key[3], held)
                    held = {}
                key = (hub, block, asking, blocks)
                if sid not in held or role != 1:
                    held[sid] = (role, least, members)
        if held:
            yield found(key[0], key[3], held)

    return join


def with_size(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """rows (saved) joined with sizes (saved; key, sets and more columns), sets being the rows of a key, so that a heavy key's rows stay where they are."""
    limit = max(HEAVY_SETS, -(-rows.count() // HEAVY_KEYS))  # so many rows have HEAVY_KEYS keys above it at most
    heavy, light = F.broadcast(sizes.where(F.col("sets") > limit)), sizes.where(F.col("sets") <= limit)
    return rows.join(heavy, key).unionByName(rows.join(heavy, key, "left_anti").join(light, key))


def largest_clusters(pairs: DataFrame) -> DataFrame:
    """(hub, sid, sets) of saved pairs: clusters of two sets or more whose sets aren't all in a larger one; of equal ones the least hub's.

    A set has at most as many hubs as links in its prefix, so this counts pairs of a set's own hubs, not of a cluster's sets.
    """
    sizes = saved(pairs.groupBy("hub").agg(F.count("*").alias("sets")).where("sets > 1"))
    own = saved(with_size(pairs, "hub", sizes))
    several = own.groupBy("sid").agg(F.collect_list(F.struct("hub", "sets")).alias("hubs")).where(F.size("hubs") > 1)
    each = several.select(F.explode("hubs").alias("x"), "hubs").select("x.hub", "x.sets", F.explode("hubs").alias("y")).where("y.sets > sets OR y.sets = sets AND y.hub < hub")
    inside = each.select("hub", "sets", F.col("y.hub").alias("other")).groupBy("hub", "other").agg(F.count("*").alias("n"), F.first("sets").alias("all")).where("n = all").select(F.col("hub")).distinct()
    return with_size(pairs, "hub", saved(sizes.join(inside, "hub", "left_anti")))


def link_pairs(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between the smallest documents of different sets, enough of them for the classes of all links."""
    bitmap, size = crowded_classes(docs, hashes_for(width))
    buckets = max(1, round(size / BUCKET_TEXT))
    dealt = docs.mapInArrow(_prefix_dealer(width, percent, bitmap, buckets), "bucket int, packed binary")
    plain = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_pairs(percent), PAIRS)
    more = _crowded_pairs(docs.mapInArrow(_crowded_rows(width, percent, bitmap), "token long, sid long, priority long"))
    pairs = saved(largest_clusters(saved(plain.unionAll(more).distinct())).select("hub", "sid", F.ceil(F.col("sets") / BLOCK).cast("int").alias("blocks")))
    wanted = wanted_bitmap(pairs.select("sid").distinct())
    sets = docs.mapInArrow(_wanted_sets(width, wanted), "sid long, least long, members binary").groupBy("sid").agg(F.min("least").alias("least"), F.first("members").alias("members"))
    block = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    members = pairs.where("sid <> hub").select("hub", "blocks", block.alias("block"), "sid", F.lit(1).alias("role"))
    seats = pairs.where("sid = hub").select("hub", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "sid", F.lit(0).alias("role"))

    def compared(cells: DataFrame) -> DataFrame:
        key = ["hub", "block", "asking"]
        return cells.join(sets, "sid").select(*CELLS).repartition(*key).sortWithinPartitions(*key).mapInArrow(_clusters(percent), LINKS)

    first = saved(compared(members.unionByName(seats).withColumn("asking", F.lit(-1))))
    links = first.where(F.col("a").isNotNull()).select("a", "b")
    left = first.where(F.col("open").isNotNull()).select("hub", "blocks", F.col("open").alias("sid"))
    if left.isEmpty():
        return links
    left = left.withColumn("asking", block)
    others = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("asking"))).alias("block")
    asked = left.select("hub", "blocks", "sid", "asking", others).withColumn("role", F.lit(2))
    there = members.join(left.select("hub", "blocks", "asking").distinct().select("hub", "asking", others), ["hub", "block"])
    second = compared(there.unionByName(asked))
    return links.union(second.where(F.col("a").isNotNull()).select("a", "b"))


def _crowded_pairs(rows: DataFrame) -> DataFrame:
    """(hub, sid) of crowded links: rows (token, sid, priority) with the set of least priority of each token."""
    rows = saved(rows.distinct())
    hubs = saved(rows.groupBy("token").agg(F.min(F.struct("priority", "sid")).alias("h"), F.count("*").alias("sets")).where("sets > 1").select("token", F.col("h.sid").alias("hub"), "sets"))
    return with_size(rows, "token", hubs).select("hub", "sid")


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest id that links lead to, itself included.

    Two texts link when 100 * intersection >= percent * union of their sets.
    percent is 67 to 100: below, sets of three shingles may link without a common link.
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent is 67 to 100")
    df, low = apart(df.select(id_col, text_col), id_col)
    docs = A.documents(df, id_col, text_col)
    ids = saved(docs.mapInArrow(_ids(width), "doc_id long, n long, sid long"))
    least = ids.where(F.col("n") > 0).groupBy("sid").agg(F.min("doc_id").alias("least"))
    classes = components(link_pairs(docs, width, percent))
    named = least.join(classes, least["least"] == classes["node"], "left").select("sid", F.coalesce("component", "least").alias("component_id"))
    out = ids.join(named, "sid", "left")
    own = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return own.select(given_id(low), "n_shingles", given_id(low, "component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
