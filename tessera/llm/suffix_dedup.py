"""Suffix-array dedup: remove bytes covered by a k-byte string that a smaller document also has.

Method: column-wise construction of the Burrows-Wheeler transform and the common
prefixes of many strings at once.  Round r inserts, for every string, its suffix
of r symbols into the sorted list of all suffixes so far: the symbol before the
last suffix and its rank in the transform give the place, and the least common
prefix between two places of the round before gives the new one.  Each round reads
the list's columns in sequence and writes the next ones.  Neighbours in the final
list with a common prefix of k bytes or more share a k-byte string.

The strings are super-k-mers (see superkmer), so a bucket holds all that can
match and the rounds are as many as a packed string is long; a bucket's lists are
of whole minimisers and of about LIST_BYTES, so they stay in memory, and nothing is
written to a folder of the executor.  Equal strings are folded before (the smallest
document stays), and a string that is alone with its minimiser has nothing to match.

Results for odd input: a null text has no bytes; each row with a null id is a
document of its own after all others, and comes back null; rows with one id are one
document, each with a result; texts under k bytes lose nothing; a very long text is a
piece of its own; of equal strings in one document none goes; an empty table gives an
empty one; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import arrays as A
from .substring_dedup import covered
from .storage import apart, given_id
from .superkmer import Spec, distinct_strings, repeated_spans

MINIMISER_BYTES = 20
#: Bytes of strings in one suffix list (strings with one minimiser are in one list, however many they are).
LIST_BYTES = 128 << 10


def suffix_groups(data: np.ndarray, begin: np.ndarray, length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, offset and group number of the suffixes that share k bytes with another, in sorted order.

    The list's columns: the symbol before a suffix (0: none), its owner and
    length, its common prefix with the suffix above (k at most), and whether its
    owner goes on from it.  Sorting the list by the symbol before, stably, gives
    the next list but for the empty suffixes at its head; what is new in it is
    inserted, and each new neighbourhood gets its common prefix from the round
    before: one more than the least between the two places that it comes from.
    """
    n, end, most = len(length), begin + length, int(length.max(initial=0))
    common_of, suffix_of = np.min_scalar_type(k + 1), np.min_scalar_type(n * (most + 1))
    symbol = data[end - 1] + np.uint8(1)  # no byte of UTF-8 is 255
    suffix = np.arange(n).astype(suffix_of) * suffix_of.type(most + 1)  # owner and length in one
    common, goes_on = np.zeros(n, common_of), np.ones(n, bool)
    for r in range(1, most + 1):
        order = np.argsort(symbol, kind="stable")
        ended = int(np.count_nonzero(symbol == 0))
        new = np.flatnonzero(goes_on[order])
        to = new + (n - ended)
        taken = suffix[order[new]]
        own = taken // suffix_of.type(most + 1)
        before = np.where(length[own] > r, data[np.maximum(end[own] - r - 1, 0)] + np.uint8(1), np.uint8(0))
        touched = np.zeros(len(order) + 1, bool)
        touched[new] = touched[new + 1] = True
        touched[: ended + 1] = False
        at = np.flatnonzero(touched[:-1])
        high, low = order[at], order[at - 1]
        value = np.zeros(len(at), common_of)
        same = np.flatnonzero(symbol[high] == symbol[low])
        same = same[np.argsort(-low[same])]  # from the end, so that reduceat does nothing between two ranges
        if len(same):
            edges = np.stack((low[same] + 1, high[same] + 1), 1).ravel()
            value[same] = np.minimum(np.minimum.reduceat(np.append(common, common_of.type(0)), edges)[::2] + common_of.type(1), k)
        old = np.ones(len(order) + len(new), bool)
        old[to] = False

        def merged(column: np.ndarray, added) -> np.ndarray:
            out = np.empty(len(old), column.dtype)
            out[old] = column
            out[to] = added
            return out

        symbol, suffix, common = merged(symbol, before), merged(suffix, taken + suffix_of.type(1)), merged(common, 0)
        common[at + (n - ended)] = value
        goes_on = np.zeros(len(old), bool)
        goes_on[to] = before > 0
    join = common >= k
    inside = join | np.append(join[1:], False)
    owner, size = np.divmod(suffix[inside].astype(np.int64), most + 1)
    return owner, length[owner] - size, np.cumsum(~join)[inside]


def repeats_by_suffixes(k: int):
    """For a bucket of packed strings: (doc, first window, windows) of the windows that a smaller document also has."""

    def find(doc, start, count, length, key, text):
        data = np.frombuffer(text, np.uint8)
        one, begin = distinct_strings(length, text)
        kinds = int(one.max(initial=-1)) + 1
        least = np.full(kinds, A.NULL_ID, np.int64)
        np.minimum.at(least, one, doc)
        first = np.zeros(kinds, np.int64)
        first[one[::-1]] = np.arange(len(one))[::-1]
        whole = doc > least[one]
        by = np.argsort(key[first], kind="stable")
        _, sizes = np.unique(key[first][by], return_counts=True)
        chosen, sizes = by[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]  # distinct strings that share a minimiser with others, by minimiser
        out = [(doc[whole], start[whole].astype(np.int64), count[whole].astype(np.int64))]
        if len(chosen):
            edge = np.append(0, np.cumsum(sizes))
            total = np.append(0, np.cumsum(length[first[chosen]], dtype=np.int64))[edge]
            parts, lo = [], 0
            while lo < len(sizes):  # lists of whole minimisers
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + LIST_BYTES, "right")) - 1)
                lead = first[chosen[edge[lo] : edge[hi]]]
                found = suffix_groups(data, begin[lead], length[lead].astype(np.int64), k)
                parts.append((found[0] + edge[lo], found[1], found[2] + total[lo] + edge[lo]))
                lo = hi
            owner, at, group = (np.concatenate(x) for x in zip(*parts))
            if len(owner):
                order = np.argsort(group, kind="stable")
                owner, at, group = owner[order], at[order], group[order]
                heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                holder = least[chosen[owner]]
                low = np.repeat(np.minimum.reduceat(holder, heads), np.diff(np.append(heads, len(group))))
                later = holder > low
                owner, at = owner[later], at[later]
                order = np.lexsort((at, owner))
                owner, at = owner[order], at[order]
                opens = np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)) if len(owner) else np.zeros(0, bool)
                heads = np.flatnonzero(opens)
                runs = np.diff(np.append(heads, len(owner)))
                owner, at = owner[heads], at[heads]
                # every occurrence in that smallest document
                lines = np.flatnonzero(~whole)
                lines = lines[np.argsort(one[lines], kind="stable")]
                lo = np.searchsorted(one[lines], chosen[owner], "left")
                hi = np.searchsorted(one[lines], chosen[owner], "right")
                line = lines[A.ranges(lo, hi - lo)]
                each = np.repeat(np.arange(len(owner)), hi - lo)
                out.append((doc[line], start[line] + at[each], runs[each]))
        return tuple(np.concatenate(x) for x in zip(*out))

    return find


def _remover(k: int, with_bytes: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_data, all_offsets = A.flat(batch.column("text"))
            spans = batch.column("spans").to_pylist()
            ids = batch.column("doc_id")
            for lo, hi in A.pieces(all_data, all_offsets):
                data, first = all_data[all_offsets[lo] : all_offsets[hi]], all_offsets[lo : hi + 1] - all_offsets[lo]
                lengths = np.diff(first)
                gone = covered(first, lengths, spans[lo:hi], k)
                total = np.append(0, np.cumsum(gone))
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                heads = first[:-1][lengths > 0]
                opens[heads] = gone[heads]
                opened = np.append(0, np.cumsum(opens))
                kept = data[~gone].tobytes()
                edge = first - total[first]
                texts = [kept[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                out = {"doc_id": ids.slice(lo, hi - lo), "n_bytes": pa.array(lengths, pa.int64()), "n_removed": pa.array(np.diff(total[first]), pa.int64()), "n_spans": pa.array(np.diff(opened[first]), pa.int64()), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in texts]}
                if with_bytes:
                    out["kept_bytes"] = pa.array(texts, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return remove


def suffix_dedup(df: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", minimiser: int = MINIMISER_BYTES, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with with_bytes, kept_bytes (which may cut a character).

    A byte goes if a string of k bytes over it also starts in a document with a smaller id.
    """
    df, least = apart(df.select(id_col, text_col), id_col)
    docs = A.documents(df, id_col, text_col)
    spans = repeated_spans(docs, Spec(k, min(minimiser, k), False, False), repeats_by_suffixes(k))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_bytes
    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_remover(k, with_bytes), schema).withColumn("doc_id", given_id(least))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_bytes=False)
