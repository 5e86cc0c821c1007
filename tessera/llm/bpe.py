"""BPE encoding and decoding by per-prefix dynamic programming.

For each prefix of a word there is exactly one token that can end its encoding.
An automaton over the suffixes of prefixes (the trie of the vocabulary's tokens with
suffix links: its state is the longest suffix of a prefix that begins a token) gives
the tokens that end at a prefix, longest first; the first that can stand after the last token of the prefix before
it (the pair-compatibility test) is stored, and following these back from the end
of the word gives the ids.  Words of a batch advance together, a byte at a time.

Two tokens are compatible if merging never joins anything across their border:
undoing the merges of both in order of rank, no pair that meets at the border may
be a merge of a rank below those still undone.

Results for odd input: a null or empty text has no ids; repeated rows each have a
result; a null document id is kept; a very long text is encoded in pieces between
words, which gives the same ids; there are no ties, as each prefix has one last token; an
empty table gives an empty one; other columns are left out, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .pretokens import Encoder

#: The symbol that ends a word.
END = 256
_SYMBOL_BITS = 9
_SYMBOLS = (1 << _SYMBOL_BITS) - 1
#: Bytes of text that are encoded at a time.
TEXT_PIECE = 1 << 18
_MEMO_BITS = 20


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """The vocabulary's automaton, merges and token texts."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, suffix, letter = model["vocab"], model["end_of_word_suffix"], byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.text: list[bytes] = [b""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            self.text[i] = token.encode()
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.full(size, -1, np.int64)
        made: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            i = vocab[a + b]
            made.setdefault(vocab[a] << 32 | vocab[b], i)
            if self.rank[i] < 0:
                self.left[i], self.right[i], self.rank[i] = vocab[a], vocab[b], rank
        self._pairs = np.array(sorted(made), np.int64)
        self._pair_rank = self.rank[[made[k] for k in self._pairs.tolist()]]
        self._memo_key = np.full(1 << _MEMO_BITS, -1, np.int64)
        self._memo = np.zeros(1 << _MEMO_BITS, bool)
        self._symbols = lambda: self._automaton({i: ([letter[c] for c in (t.removesuffix(suffix) if t.endswith(suffix) else t)] + [END] * t.endswith(suffix)) for t, i in vocab.items()})

    def prepared(self) -> PrefixBpe:
        """self with its automaton, which only encoding needs."""
        if self._symbols:
            self._symbols()
            self._symbols = None
        return self

    def _automaton(self, tokens: dict[int, list[int]]) -> None:
        """Edges by state and symbol; fail: the state of the longest other suffix; best: the longest token that ends in a state; shorter: the next one.

        Edges and suffix links take a hundredth of the memory of a full table of states and symbols.
        """
        edges: dict[int, int] = {}
        entry, depth, own = [0], [0], [-1]
        self.size = np.zeros(len(self.text), np.int64)  # in bytes, without END
        for i, symbols in tokens.items():
            state = 0
            for s in symbols:
                key = state << _SYMBOL_BITS | s
                if key not in edges:
                    edges[key] = len(own)
                    entry.append(key)
                    depth.append(depth[state] + 1)
                    own.append(-1)
                state = edges[key]
            own[state] = i
            self.size[i] = len(symbols) - (symbols[-1] == END)
        fail, best, self.shorter = [0] * len(own), [-1] * len(own), np.full(len(self.text), -1, np.int32)
        for state in np.argsort(depth, kind="stable")[1:].tolist():  # shorter ones first
            parent, symbol = entry[state] >> _SYMBOL_BITS, entry[state] & _SYMBOLS
            while parent:
                parent = fail[parent]
                if (parent << _SYMBOL_BITS | symbol) in edges:
                    fail[state] = edges[parent << _SYMBOL_BITS | symbol]
                    break
            best[state] = best[fail[state]]
            if own[state] >= 0:
                self.shorter[own[state]] = best[state]
                best[state] = own[state]
        self.fail, self.best = np.array(fail, np.int32), np.array(best, np.int32)
        self._edges = np.array(sorted(edges), np.int32)
        self._targets = np.array([edges[k] for k in self._edges.tolist()], np.int32)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after one more symbol each."""
        out = np.zeros(len(state), np.int32)
        todo = np.arange(len(state))
        while len(todo):
            key = state << _SYMBOL_BITS | symbol[todo]
            at = np.minimum(np.searchsorted(self._edges, key), len(self._edges) - 1)
            hit = self._edges[at] == key
            out[todo[hit]] = self._targets[at[hit]]
            on = ~hit & (state > 0)
            todo, state = todo[on], self.fail[state[on]]
        return out

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or a large number."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._pair_rank[at], 1 << 40)

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs whose border no merge crosses."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), 1 << 39, np.int64)
        while len(live):
            crossed = self._rank_of(a, b) < limit
            out[live[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~crossed & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            undo_left = ra > rb
            # until a token is undone its last merge holds its border symbol, so a merge across must come before it;
            # at equal rank the left one is made first, and what it would share with the right is gone
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_stable, with a memory of fixed size."""
        key = a.astype(np.int64) << 32 | b
        slot = (A.mixed(key.astype(np.uint64)) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
        new = self._memo_key[slot] != key
        out = self._memo[slot]
        if new.any():
            fresh, back = np.unique(key[new], return_inverse=True)
            value = self._stable(fresh >> 32, fresh & 0xFFFFFFFF)
            out[new] = value[back]
            self._memo_key[slot[new]], self._memo[slot[new]] = key[new], out[new]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words, one after the other, and how many each has."""
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.cumsum(size) - size
        base = begin + np.arange(len(words))  # prefixes of length 0 to n of each word
        last, count = np.zeros(len(data) + len(words), np.int32), np.zeros(len(data) + len(words), np.int32)
        order = np.argsort(-size, kind="stable")
        ordered = size[order]
        state = np.zeros(len(words), np.int32)
        for i in range(1, int(size.max(initial=0)) + 1):
            n = int(np.searchsorted(-ordered, -i, "right"))  # words with i bytes at least
            word = order[:n]
            at = self.step(state[:n], data[begin[word] + i - 1].astype(np.int32))
            state[:n] = at
            ends = np.flatnonzero(size[word] == i)
            at[ends] = self.step(at[ends], np.full(len(ends), END, np.int32))
            token = self.best[at]
            todo = np.arange(n)
            while len(todo):
                t, w = token[todo], word[todo]
                before = i - self.size[t]
                ok = before == 0
                rest = np.flatnonzero(~ok)
                ok[rest] = self.compatible(last[base[w[rest]] + before[rest]], t[rest])
                todo = todo[~ok]
                token[todo] = self.shorter[token[todo]]
                if (token[todo] < 0).any():
                    raise ValueError("a word has bytes that the vocabulary lacks")
            last[base[word] + i] = token
            count[base[word] + i] = count[base[word] + i - self.size[token]] + 1
        counts = count[base + size].astype(np.int64)
        out = np.zeros(int(counts.sum()), np.int32)
        place, where, live = np.cumsum(counts) - 1, size.copy(), np.arange(len(words))
        while len(live):  # back-pointers, from the ends of the words
            token = last[base[live] + where[live]]
            out[place[live]] = token
            place[live] -= 1
            where[live] -= self.size[token]
            live = live[where[live] > 0]
        return out, counts


@lru_cache(2)
def vocabulary(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode_rows(encoder: Encoder, batch: pa.RecordBatch, piece: int = TEXT_PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of (doc_id, text, ...) with their ids and counts."""
    column = batch.column("text")
    data, offsets = A.flat(column)
    for lo, hi in A.pieces(data, offsets, piece):
        ids, counts = encoder(column.slice(lo, hi - lo).to_pylist())
        yield batch.slice(lo, hi - lo), ids, counts


def _decoded(text: list[bytes], ids: list[int], edge: list[int]) -> list[str]:
    """The tokens of each row's ids with a space between."""
    return [b" ".join(map(text.__getitem__, ids[a:b])).decode() for a, b in zip(edge[:-1], edge[1:])]


def _encoded(path: str, with_decoded: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path).prepared()
        encoder = Encoder(bpe.encode_words, bpe.added)
        for batch in batches:
            for rows, ids, counts in encode_rows(encoder, batch):
                edge = np.concatenate(([0], np.cumsum(counts))) * 4
                raw = ids.astype("<u4").tobytes()
                out = {"doc_id": rows.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array([raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary())}
                if with_decoded:
                    out["decoded"] = pa.array(_decoded(bpe.text, np.frombuffer(raw, "<u4").tolist(), (edge // 4).tolist()), pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return encode


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each text.

    With with_decoded also what bpe_decode makes of the ids, in the same Python
    worker: one that held the vocabulary for each would double an executor's memory.
    """
    docs = A.documents(df, id_col, text_col)
    return docs.mapInArrow(_encoded(path or public_tokenizers.path("word_bpe_49k.json"), with_decoded), "doc_id long, n_tokens long, ids binary" + ", decoded string" * with_decoded).withColumn("doc_id", A.outer_id())


def bpe_decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """df with decoded: the tokens of ``ids`` with a space between, as a vocabulary without a decoder gives them."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = vocabulary(path).text
        for batch in batches:
            column = batch.column(ids_col)
            data, offsets = A.flat(column)
            for lo, hi in A.pieces(data, offsets, TEXT_PIECE):
                ids = np.frombuffer(data[offsets[lo] : offsets[hi]].tobytes(), "<u4").tolist()
                edge = ((offsets[lo : hi + 1] - offsets[lo]) // 4).tolist()
                out = _decoded(text, ids, edge)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(decode, T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_decoded=True).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
