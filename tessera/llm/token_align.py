"""Alignment of two tokenizers over the same texts, and how often their tokens correspond.

Method: identity-map fast path.  For each id of A the id of B with the same bytes is
precomputed.  Where a token of A and one of B that are each other's same span the same
bytes (an exact one-to-one group), the document counts for the pair in a vector as long
as A's vocabulary, one for each task; only irregular groups give rows of pairs, which
are summed by a shuffle after each task has summed its own.

Texts are cut before a space between two characters that aren't white space.  Neither
tokenizer has a token across such a place (A's pattern starts a token there; no piece of
B has a space behind another character, which is checked), so the parts are encoded by
themselves, each distinct one once while it is held, and every part ends a group.

A pair's count is of documents.  The counts that links are weighed by come back as
vectors as long as A's vocabulary and as the ``TABLE`` most frequent irregular pairs at
most; links of other pairs, which few documents have, are joined with theirs by a shuffle.

Results for odd input: texts that are null or empty, or whose tokens' bytes differ from
a space and the text, have no tokens: zeros and an empty string; a very long text is
encoded part by part; repeated rows are documents of their own; a null id comes back
null; an empty table gives an empty one; special tokens' strings are plain text; other
columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .storage import saved

#: Irregular pairs that are sent to every task at most (16 bytes each).
TABLE = 1 << 20
#: Characters of parts, and links, that are held between texts.
HELD_TEXT, HELD_LINKS = 20 << 20, 5 << 20
#: Pairs that a task holds before it gives their sums away.
HELD_PAIRS = 1 << 20
#: Bytes of text for which links are arrays at a time.
PIECE = 1 << 20
#: Characters of parts that are encoded together, with the spaces between them.
JOINED = 1 << 16
#: Before the key of a part with white space at an end: a character that no text of Spark's begins a part with twice.
_KEPT = "\ud800"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and B's id for the same bytes as each of A's (-1: none)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = byte_level()
        names = {i: token for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(byte[c] for c in names[i]) if i in names and all(c in byte for c in names[i]) else b"" for i in range(max(names) + 1)]
        self.b_bytes, same = [], {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if re.search("[^▁]▁", piece):
                raise ValueError("B has a piece with a space behind another character, so texts can't be cut at spaces")
            self.b_bytes.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        plain = [i for i in range(len(self.b_bytes)) if not (self.b.is_unknown(i) or self.b.is_control(i) or self.b.is_unused(i))]
        for i in sorted(plain, key=lambda i: (self.b.is_byte(i), i)):
            same.setdefault(self.b_bytes[i], i)
        self.same = np.array([same.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.shift = len(self.b_bytes).bit_length()
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)


class Parts:
    """Alignments of the distinct parts of texts: numbers of tokens, groups and links, the links' codes, and (with_text) the groups as text."""

    def __init__(self, known: Vocabularies, with_text: bool = True):
        self.known, self.age, self.with_text = known, 0, with_text
        shown = ([f"{i}{mark}".encode() for i in range(n)] for n, mark in ((len(known.a_bytes), ","), (len(known.a_bytes), "|"), (len(known.b_bytes), ","), (len(known.b_bytes), ";")))
        self.names = [x for part in shown for x in part] if with_text else []
        self.clear()

    def clear(self) -> None:
        #: the number of each part; -1 where white space is at an end of it, as then it isn't to be cut there
        self.number: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.text, self.age = 0, self.age + 1
        #: tokens of A, tokens of B, groups, links, whether the bytes differ
        self.counts = np.zeros((0, 5), np.int64)
        self.first, self.codes = np.zeros(1, np.int64), np.zeros(0, np.int64)
        #: whether a link is an exact one-to-one group of the same bytes
        self.exact = np.zeros(0, bool)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of all texts, one after the other, and where each text's begin."""
        if self.text > HELD_TEXT or len(self.codes) > HELD_LINKS:
            self.clear()
        split = [t.split(" ") if t else [] for t in texts]
        number = self.number
        every = list(chain.from_iterable(split))
        flat = np.fromiter(map(number.get, every, repeat(-2)), np.int64, len(every))
        lacking = np.flatnonzero(flat == -2).tolist()
        new = {every[i] for i in lacking}
        odd = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        number.update(dict.fromkeys(odd, -1))
        self._add(list(new - odd))
        flat[lacking] = [number[every[i]] for i in lacking]
        size = np.array([len(x) for x in split], np.int64)
        first = np.concatenate(([0], np.cumsum(size)))
        again = np.unique(np.searchsorted(first, np.flatnonzero(flat < 0), "right") - 1)
        if len(again):
            cut = [[_KEPT + p if not p or p[0].isspace() or p[-1].isspace() else p for p in _CUT.split(texts[i])] for i in again.tolist()]
            self._add(sorted({p for parts in cut for p in parts if p not in number}))
            own = dict(zip(again.tolist(), (np.array([number[p] for p in parts], np.int64) for parts in cut)))
            flat = np.concatenate([own[i] if i in own else flat[p:q] for i, (p, q) in enumerate(zip(first[:-1].tolist(), first[1:].tolist()))])
            size[again] = [len(x) for x in cut]
            first = np.concatenate(([0], np.cumsum(size)))
        return flat, first

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B for all parts, and which parts' bytes differ (they have no ids)."""
        known = self.known
        a, b, bad = [], [], np.zeros(len(parts), bool)
        at = 0
        while at < len(parts):
            alone = parts[at].startswith(_KEPT)
            end, size = at + 1, len(parts[at])
            while not alone and end < len(parts) and size < JOINED and not parts[end].startswith(_KEPT):
                size += len(parts[end]) + 1
                end += 1
            text = parts[at].removeprefix(_KEPT) if alone else " ".join(parts[at:end])
            if not self._encode(text, a, b):
                for i in range(at, end):
                    bad[i] = not self._encode(parts[i].removeprefix(_KEPT), a, b)
            at = end
        flat = lambda lists: np.array([i for x in lists for i in x], np.int64)
        return flat(a), flat(b), bad

    def _encode(self, text: str, a: list[list[int]], b: list[list[int]]) -> bool:
        known, want = self.known, (" " + text).encode()
        x, y = known.a.encode(" " + text, add_special_tokens=False).ids, known.b.encode(text, num_threads=1)
        if b"".join(map(known.a_bytes.__getitem__, x)) != want or b"".join(map(known.b_bytes.__getitem__, y)) != want:
            return False
        a.append(x)
        b.append(y)
        return True

    def _add(self, new: list[str]) -> None:
        """Parts with white space at an end come behind ``_KEPT`` and are encoded alone."""
        known, n = self.known, len(new)
        if not n:
            return
        ids_a, ids_b, bad = self._encoded(new)
        length = np.array([len(p.removeprefix(_KEPT).encode()) + 1 for p in new], np.int64)
        edge = np.cumsum(np.where(bad, 0, length))  # where each part ends in the bytes of all
        end_a, end_b = np.cumsum(known.a_size[ids_a]), np.cumsum(known.b_size[ids_b])
        cut = np.intersect1d(end_a, end_b, assume_unique=True)  # a part's end is one of both
        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        until = lambda ends: np.diff(np.searchsorted(ends, edge, "right"), prepend=0)
        links = in_a * in_b
        before = np.concatenate(([0], np.cumsum(links)))
        of_groups = until(cut)
        to = before[np.cumsum(of_groups)]
        counts = np.stack((until(end_a), until(end_b), of_groups, np.diff(to, prepend=0), bad), 1).astype(np.int64)
        group = np.repeat(np.arange(len(cut)), links)
        place = np.arange(len(group)) - before[group]
        x, y = ids_a[first_a[group] + place // in_b[group]], ids_b[first_b[group] + place % in_b[group]]
        if self.with_text:
            self.shown += self._shown(ids_a, ids_b, group_a, group_b, counts[:, 0] + counts[:, 1])
        self.number.update(zip(new, range(len(self.counts), len(self.counts) + n)))
        self.text += sum(map(len, new))
        self.counts = np.concatenate((self.counts, counts))
        self.first = np.concatenate((self.first, self.first[-1] + to))
        self.codes = np.concatenate((self.codes, x << known.shift | y))
        self.exact = np.concatenate((self.exact, (links[group] == 1) & (known.same[x] == y)))

    def _shown(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, tokens: np.ndarray) -> list[bytes]:
        """The groups of each part as text: ids with the mark behind them, in order of groups, A before B."""
        n_a = len(self.known.a_bytes)
        last = lambda group: np.diff(group, append=-1) != 0
        name = np.concatenate((ids_a + n_a * last(group_a), 2 * n_a + ids_b + len(self.known.b_bytes) * last(group_b)))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        marked = list(map(self.names.__getitem__, name[order].tolist()))
        edge = np.concatenate(([0], np.cumsum(tokens))).tolist()
        return [b"".join(marked[p:q])[:-1] for p, q in zip(edge[:-1], edge[1:])]


@lru_cache(1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


@lru_cache(1)
def parts_of(a_path: str, b_path: str, with_text: bool) -> Parts:
    return Parts(vocabularies(a_path, b_path), with_text)


def _pieces(parts: Parts, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of (doc_id, text) batches with the numbers of their parts; texts whose bytes differ have none."""
    for batch in batches:
        column = batch.column("text")
        data, offsets = A.flat(column)
        for lo, hi in A.pieces(data, offsets, PIECE):
            flat, first = parts.of(column.slice(lo, hi - lo).to_pylist())
            differs = np.concatenate(([0], np.cumsum(parts.counts[flat, 4])))
            bad = differs[first[1:]] > differs[first[:-1]]
            if bad.any():
                size = np.where(bad, 0, np.diff(first))
                flat, first = flat[np.repeat(~bad, np.diff(first))], np.concatenate(([0], np.cumsum(size)))
            yield batch.slice(lo, hi - lo), flat, first


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order, by sorting in place."""
    values.sort()
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def _distinct(parts: Parts, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the texts have each A id in an identity pair, and the codes of the others, one for each text that has it."""
    known = parts.known
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    own = distinct(row << 40 | flat)  # each part once for a text
    row, flat = own >> 40, own & ((1 << 40) - 1)
    links = parts.counts[flat, 3]
    at = A.ranges(parts.first[flat], links)
    row, code, exact = np.repeat(row, links), parts.codes[at], parts.exact[at]
    a = code >> known.shift
    same = known.same[a] == code & ((1 << known.shift) - 1)
    wide = len(known.same)
    # the fast path: exact groups, and identity pairs that are in an irregular group, count for a document once in a vector
    seen = np.bincount(distinct(row[exact | same] * wide + a[exact | same]) % wide, minlength=wide)
    rest, bits = ~(exact | same), 2 * known.shift + 2
    return seen, distinct(row[rest] << bits | code[rest]) & ((1 << bits) - 1)


def _counted(a_path: str, b_path: str):
    """mapInArrow over (doc_id, text): codes of pairs and in how many documents of the task they are."""

    def sums(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, where = np.unique(codes, return_inverse=True)
        return code, np.bincount(where, weights=n, minlength=len(code)).astype(np.int64)

    def batch_of(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"code": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = parts_of(a_path, b_path, False)
        known = parts.known
        identity = np.zeros(len(known.same), np.int64)
        held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for _, flat, first in _pieces(parts, batches):
            seen, codes = _distinct(parts, flat, first)
            identity += seen
            held.append((codes, np.ones(len(codes), np.int64)))
            size += len(codes)
            if size > HELD_PAIRS:
                held = [sums(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield batch_of(*held[0])
                    held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        yield batch_of(*sums(*(np.concatenate(x) for x in zip(*held))))
        a = np.flatnonzero(identity)
        yield batch_of(a << known.shift | known.same[a], identity[a])

    return count


class Weights:
    """Counts of pairs that every task has: identity pairs and each A id's highest by vectors, and a table of the most frequent others."""

    def __init__(self, identity: np.ndarray, best: np.ndarray, codes: np.ndarray, counts: np.ndarray):
        self.identity, self.best, self.codes, self.counts = identity, best, codes, counts

    def of(self, known: Vocabularies, code: np.ndarray) -> np.ndarray:
        """The count of each link's pair; -1 where the table lacks it."""
        a = code >> known.shift
        out = np.where(known.same[a] == code & ((1 << known.shift) - 1), self.identity[a], -1)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            out = np.where((out < 0) & (self.codes[at] == code), self.counts[at], out)
        return out


class _Sums:
    """Sums over each held part's links: of counts, of links with their A id's highest, and where links aren't in the table."""

    def __init__(self, parts: Parts, weights: Weights):
        self.parts, self.weights, self.age = parts, weights, -1

    def now(self) -> tuple[np.ndarray, np.ndarray]:
        """A row for each held part; and whether each held link is in the table."""
        parts = self.parts
        if self.age != parts.age:
            self.age, self.rows, self.known = parts.age, np.zeros((0, 2), np.int64), np.zeros(0, bool)
        if len(self.rows) < len(parts.counts):
            done = len(self.known)
            code = parts.codes[done:]
            count = self.weights.of(parts.known, code)
            there = count >= 0
            value = np.stack((np.where(there, count, 0), there & (count == self.weights.best[code >> parts.known.shift])), 1)
            total = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(value, axis=0)))
            at = parts.first[len(self.rows) :] - done
            self.rows = np.concatenate((self.rows, total[at[1:]] - total[at[:-1]]))
            self.known = np.concatenate((self.known, there))
        return self.rows, self.known


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
RARE = "doc_id long, h long, code long, best long, links long"


def _aligned(a_path: str, b_path: str, weights, digest: bool):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = parts_of(a_path, b_path, True)
        sums = _Sums(parts, weights.value)
        for rows, flat, first in _pieces(parts, batches):
            each = np.concatenate((parts.counts[:, :4], sums.now()[0][:, ::-1]), axis=1)[flat]
            total = np.concatenate((np.zeros((1, 6), np.int64), np.cumsum(each, axis=0)))
            out = total[first[1:]] - total[first[:-1]]
            shown, number, edge = parts.shown, flat.tolist(), first.tolist()
            texts = [b";".join([shown[k] for k in number[p:q]]) for p, q in zip(edge[:-1], edge[1:])]
            texts = [hashlib.sha256(t).hexdigest() if t else "" for t in texts] if digest else [t.decode() for t in texts]
            names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id")} | {c: pa.array(out[:, i], pa.int64()) for i, c in enumerate(names)} | {"groups": pa.array(texts, pa.string()), "h": rows.column("h")})

    return align


def _rare(a_path: str, b_path: str, weights):
    """mapInArrow: the links of each text that the table lacks, added up by pair."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = parts_of(a_path, b_path, False)
        sums = _Sums(parts, weights.value)
        for rows, flat, first in _pieces(parts, batches):
            known = sums.now()[1]
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            links = parts.counts[flat, 3]
            at = A.ranges(parts.first[flat], links)
            row = np.repeat(row, links)[~known[at]]
            code = parts.codes[at[~known[at]]]
            bits = 2 * parts.known.shift + 2
            both, n = np.unique(row << bits | code, return_counts=True)
            row, code = both >> bits, both & ((1 << bits) - 1)
            ids, h = (rows.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc_id", "h"))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "h": pa.array(h, pa.int64()), "code": pa.array(code, pa.int64()), "best": pa.array(weights.value.best[code >> parts.known.shift], pa.int64()), "links": pa.array(n, pa.int64())})

    return find


def token_align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, table: int = TABLE, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The alignment of each text, and the counts of all id pairs.

    First: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is their A
    id's highest), count_sum (over links), groups (``a1,a2|b1;a3|b2``; its sha256
    with digest).  Second: a, b and n, the documents that have the pair linked.
    """
    spark = df.sparkSession
    paths = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    known = vocabularies(*paths)
    docs = A.documents(df, id_col, text_col)
    pairs = saved(docs.mapInArrow(_counted(*paths), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    a, b = F.shiftright("code", known.shift), F.col("code").bitwiseAND((1 << known.shift) - 1)
    same = spark.createDataFrame(list(enumerate(known.same.tolist())), "a long, same long").where("same >= 0")  # as long as A's vocabulary
    marked = pairs.join(F.broadcast(same.withColumnRenamed("a", "_a")), (a == F.col("_a")) & (b == F.col("same")), "left")
    identity, best = np.zeros(len(known.same), np.int64), np.zeros(len(known.same), np.int64)
    for r in marked.where("same IS NOT NULL").select("_a", "n").collect():
        identity[r[0]] = r[1]
    for r in pairs.groupBy(a.alias("a")).agg(F.max("n").alias("n")).collect():
        best[r[0]] = r[1]
    others = marked.where("same IS NULL").select("code", "n")
    levels = sorted(((r[0], r[1]) for r in others.groupBy(F.floor(F.log2("n") * 8).alias("level")).count().collect()), reverse=True)
    least, room = None, table
    for level, n in levels:  # some hundreds at most
        if n > room:
            break
        least, room = level, room - n
    chosen = others.where(F.floor(F.log2("n") * 8) >= least).toArrow() if least is not None else None
    codes, counts = (chosen.column(c).to_numpy() for c in ("code", "n")) if chosen is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(codes)
    weights = spark.sparkContext.broadcast(Weights(identity, best, codes[order], counts[order]))
    keyed = docs.withColumn("h", F.xxhash64("text"))
    out = keyed.mapInArrow(_aligned(*paths, weights, digest), ALIGNED + ", h long")
    if len(codes) < sum(n for _, n in levels):
        rare = keyed.mapInArrow(_rare(*paths, weights), RARE).dropDuplicates(["doc_id", "h", "code"])  # rows that are repeated
        less = others if least is None else others.where(F.floor(F.log2("n") * 8) < least)
        more = rare.join(less, "code").groupBy("doc_id", "h").agg(F.sum(F.col("links") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0)).alias("_best"))
        out = out.join(more, ["doc_id", "h"], "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    names = [x.split(" ")[0] for x in ALIGNED.split(", ")]
    return out.select(A.outer_id(), *names[1:]), pairs.select(a.alias("a"), b.alias("b"), "n")


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)[0].withColumnRenamed("groups", "groups_sha256")
