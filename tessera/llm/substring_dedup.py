"""Substring dedup: remove words covered by a window of words that starts earlier elsewhere.

Method: super-k-mer partitioning (see superkmer); in its bucket each packed string
is cut into windows, whose hashes are sorted; equal neighbours are compared byte
by byte, so the counts are exact.

Results for odd input: a null text has no words; each row with a null id is a
document of its own after all others, and comes back null; repeated rows of one id are
one document, each with a result; a text of fewer than k words loses nothing; a very
long text is a piece of its own; of equal windows the smallest id's stays, in it the
earliest; an empty table gives an empty one; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import arrays as A
from .storage import apart, given_id
from .superkmer import Spec, repeated_spans

#: Words of a minimiser: longer ones are rarer, shorter ones make longer super-k-mers, with fewer words sent twice.
MINIMISER_WORDS = 3


def repeats_by_sort(k: int):
    """For a bucket of packed strings: (doc, first window, windows) of the windows that start earlier elsewhere."""

    def find(doc, start, count, length, key, text):
        offsets = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
        data = np.frombuffer(text, np.uint8)
        begin, end, row = A.words(data, offsets)
        first = np.searchsorted(row, np.arange(len(doc)))
        by = np.lexsort((start, doc))
        at = A.ranges(first[by], count[by])  # the first word of each window, in order of (doc, start)
        line = np.repeat(by, count[by])
        hashes = A.range_hash(A.prefix_hash(A.word_hashes(data, begin, end)), at, at + k)
        order = np.argsort(hashes)
        ordered = hashes[order]
        head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        size = np.diff(np.append(head, len(order)))
        lead = np.minimum.reduceat(order, head)
        several = size > 1
        members = order[A.ranges(head[several], size[several])]
        leads = np.repeat(lead[several], size[several])
        rest = members != leads
        members, leads = members[rest], leads[rest]
        b, e = begin[at], end[at + k - 1]
        same = np.array([text[p:q] == text[r:s] for p, q, r, s in zip(b[members].tolist(), e[members].tolist(), b[leads].tolist(), e[leads].tolist())], bool)
        if not same.all():  # different windows with one hash: by their words
            seen: dict[bytes, int] = {}
            odd = np.isin(hashes, hashes[members[~same]])
            for x in np.flatnonzero(odd).tolist():
                seen.setdefault(text[b[x] : e[x]], x)
            keep = ~odd[members]
            more = [(x, y) for x in np.flatnonzero(odd).tolist() if (y := seen[text[b[x] : e[x]]]) != x]
            members = np.append(members[keep], np.array([x for x, _ in more], np.int64))
            leads = np.append(leads[keep], np.array([y for _, y in more], np.int64))
        window = start[line] + at - first[line]
        later = (doc[line[members]] != doc[line[leads]]) | (window[members] != window[leads])  # else a repeated row
        marked = np.zeros(len(at), bool)
        marked[members[later]] = True
        opens = marked.copy()
        opens[1:] &= ~marked[:-1] | (line[1:] != line[:-1])
        heads = np.flatnonzero(opens)
        total = np.cumsum(marked)
        counts = np.diff(np.append(total[heads] - 1, total[-1] if len(total) else 0))
        return doc[line[heads]], window[heads], counts

    return find


def covered(first: np.ndarray, lengths: np.ndarray, spans: list, k: int) -> np.ndarray:
    """Which tokens repeated windows cover. first: of each text; spans: packed (window, windows) pairs for each, or None."""
    n = int(first[-1]) if len(first) else 0
    row = [i for i, x in enumerate(spans) if x]
    if not row:
        return np.zeros(n, bool)
    raw = [spans[i] for i in row]
    pairs = np.frombuffer(b"".join(raw), np.int32).reshape(-1, 2).astype(np.int64)
    owner = np.repeat(np.array(row), [len(x) // 8 for x in raw])
    begin = np.minimum(pairs[:, 0], lengths[owner])
    end = np.minimum(pairs[:, 0] + pairs[:, 1] + k - 1, lengths[owner])
    steps = np.bincount(first[owner] + begin, minlength=n + 1) - np.bincount(first[owner] + end, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def remover(k: int, with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_data, all_offsets = A.flat(batch.column("text"))
            spans = batch.column("spans").to_pylist()
            ids = batch.column("doc_id")
            for lo, hi in A.pieces(all_data, all_offsets):
                data, offsets = all_data[all_offsets[lo] : all_offsets[hi]], all_offsets[lo : hi + 1] - all_offsets[lo]
                begin, end, row = A.words(data, offsets)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                lengths = np.diff(first)
                gone = covered(first, lengths, spans[lo:hi], k)
                line, _ = A.joined(data, begin, end)
                kept = line[np.repeat(~gone, end - begin + 1)].tobytes()
                edges = np.concatenate(([0], np.cumsum(np.where(gone, 0, end - begin + 1))))[first]
                texts = [kept[a : b - 1] if b > a else b"" for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(first[:-1], len(gone))) * (lengths > 0) if hi > lo else lengths
                out = {"doc_id": ids.slice(lo, hi - lo), "n_words": pa.array(lengths, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in texts]}
                if with_text:
                    out["kept_text"] = pa.array([x.decode() for x in texts], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return remove


def substring_dedup(df: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", minimiser: int = MINIMISER_WORDS, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with with_text, kept_text: the words that remain, joined by one space.

    A word goes if a window of k words over it also starts earlier: in a smaller
    id, or earlier in the same text.  Windows are judged on the input.
    """
    df, least = apart(df.select(id_col, text_col), id_col)
    docs = A.documents(df, id_col, text_col)
    spans = repeated_spans(docs, Spec(k, min(minimiser, k), True, True), repeats_by_sort(k))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(remover(k, with_text), schema)
    return out.withColumn("doc_id", given_id(least))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
wins AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
dups AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM wins) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dups),
allw AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = w.doc_id
LEFT JOIN (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS kept FROM allw a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.p WHERE g.p IS NULL GROUP BY a.doc_id) k ON k.doc_id = w.doc_id
"""
