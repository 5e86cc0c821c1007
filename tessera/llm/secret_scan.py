"""Secret scans: credential patterns, and values that would cost many guesses.

Fixed patterns find assignments, access keys and long hexadecimal runs.  Values in
a credential context that the patterns leave (shorter ones, other key names) are
weighed by a guess cost: dynamic programming over the whole value finds its cheapest
segmentation into words, dates, repeats, keyboard walks and brute-force spans, in
powers of ten of guesses.  Words are the fixed ones below and then those of a public
tokenizer's vocabulary, most frequent first.  Every word, every date, every part of a
walk of 3 keys or more and every repeat (two or more of a unit that isn't a repeat itself,
of any length, from any place) can be a segment.  A value that costs ``LEAST_COST`` or more
is a secret, and so is a shorter one of 6 characters or more that costs as much as brute
force over all of it.  Where a pattern's span ends inside a value, the value up to an ``&``
with a key and ``=`` is weighed in the same way, and is a guess span too where it passes, so
that no rest of a secret stays; what follows the ``&`` is looked at for itself.

Results for odd input: a null or empty text has no spans; repeated rows each have
a result; a null id is kept; a value of any length is weighed whole: its runs are found in
steps that grow as its length times the logarithm of that, and segments are followed only
from places that cost less than a secret; of segmentations that cost the same the cost counts, not which one it is; an
empty table gives an empty one; other columns are left out (``secret_scan``) or stay as
they are, whatever their names (``mask_secrets``).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A

#: The base patterns, in the order in which kinds are listed, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of 16 or more, which equals dropping shorter runs
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "guess")
#: Credential contexts whose values are weighed.
CONTEXT = re.compile(r"""(password|passwd|passphrase|pwd|secret|token|api[_-]?key|credentials?|auth)["']?\x20*(?:[:=]|\x20is\x20)\x20*["']?([^\s"'<>,;]{6,})""", re.ASCII | re.IGNORECASE)
#: One of these, in lower case, is in every text that ASSIGN or CONTEXT match.
HINTS = ("passw", "passphrase", "pwd", "secret", "token", "api", "credential", "auth")
LEAST_COST = 8.0
#: Where a value ends for a query string: the next key and its sign.
NEXT_KEY = re.compile(r"&(?:amp;)?[A-Za-z0-9_.\[\]-]+=")
#: Words that guessing starts with, most common first.
WORDS = """password admin welcome letmein monkey dragon master login secret token user guest root test default changeme
qwerty abc summer winter spring autumn love iloveyou sunshine princess football baseball shadow michael jordan superman
batman trustno hello freedom whatever ninja mustang access flower hottie charlie donald killer jennifer hunter buster
soccer harley ranger daniel andrew thomas george computer maggie pepper ginger cookie cheese summer internet service
server system manager public private demo temp example sample company office home account mail google apple orange
banana silver golden purple yellow green black white red blue happy lucky star angel baby money power magic music
rock tiger lion eagle wolf bear snake phoenix london paris berlin madrid boston texas america england france germany
key api pass word pwd auth the and for you with this that none null true false""".split()
LEET = str.maketrans("013457@$!", "oieastasi")
YEAR, MONTH, DAY, MARK = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"[-/._]?"
DATES = [re.compile(x) for x in (YEAR + MARK + MONTH + MARK + DAY, DAY + MARK + MONTH + MARK + YEAR, YEAR)]
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (x + y * 0.5, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
PLACE |= dict(zip('~!@#$%^&*()_+{}|:"<>?', map(PLACE.get, r"`1234567890-=[]\;',./")))


@lru_cache(maxsize=2)
def ranks(path: str) -> tuple[dict[str, int], int]:
    """The rank of each word, from 1, and the length of the longest: WORDS and then the vocabulary's whole words of three letters or more."""
    vocabulary = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    ends = sorted((i, t.removesuffix("</w>")) for t, i in vocabulary.items() if t.endswith("</w>"))
    every = dict.fromkeys([*WORDS, *(w for _, w in ends if len(w) >= 3 and w.isalpha())])
    return {w: i for i, w in enumerate(every, 1)}, max(map(len, every))


def words_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _near(a: str, b: str) -> bool:
    p, q = PLACE.get(a), PLACE.get(b)
    return bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def _common(codes: list[int]) -> list[int]:
    """For each place the length of what it has in common with the start."""
    n = len(codes)
    out, lo, hi = [n] + [0] * (n - 1), 0, 0
    for i in range(1, n):
        k = min(hi - i, out[i - lo]) if i < hi else 0
        while i + k < n and codes[k] == codes[i + k]:
            k += 1
        if i + k > hi:
            lo, hi = i, i + k
        out[i] = k
    return out


def runs(value: str) -> list[tuple[int, int, int]]:
    """(start, end, unit) of each longest run of a unit of any length, whole at least twice, that isn't a repeat itself.

    Halves are searched for themselves; a run across the middle goes on from one unit beside it.
    """
    codes = [*map(ord, value)]
    found: dict[int, list[tuple[int, int]]] = {}
    spans = [(0, len(codes))]
    while spans:
        lo, hi = spans.pop()
        mid = (lo + hi) // 2
        if mid == lo:
            continue
        spans += [(lo, mid), (mid, hi)]
        left, right, whole = codes[lo:mid][::-1], codes[mid:hi], codes[lo:hi]
        ahead, behind = _common(right), _common(left)
        to_right = _common([*right, -1, *whole])[len(right) + 1 :]
        to_left = _common([*left, -1, *whole[::-1]])[len(left) + 1 :]
        for unit in range(1, len(right) + 1):
            after = ahead[unit] if unit < len(right) else 0
            before = to_left[len(right) - unit] if unit < len(right) else min(to_left[0], len(left))
            if after + before >= unit:
                found.setdefault(unit, []).append((mid - before, mid + unit + after))
        for unit in range(1, len(left) + 1):
            before = behind[unit] if unit < len(left) else 0
            after = to_right[len(left) - unit]
            if after + before >= unit:
                found.setdefault(unit, []).append((mid - unit - before, mid + after))
    least: dict[tuple[int, int], int] = {}
    for unit in sorted(found):
        last = 0
        for start, end in sorted(found[unit], key=lambda x: (x[0], -x[1])):
            if end > last:  # else it's a part of the one before
                least.setdefault((start, end), unit)  # a longer unit of the same run is a repeat of this one
                last = end
    return [(a, b, unit) for (a, b), unit in least.items()]


class Words:
    """The words and dates that start at a place of a value, with the log10 of their guesses."""

    def __init__(self, value: str, path: str | None):
        self.value, (self.rank_of, self.longest) = value, ranks(path or words_path())
        self.low = value.lower() if len(value.lower()) == len(value) else value
        self.plain = self.low.translate(LEET)

    def at(self, i: int) -> Iterator[tuple[int, float]]:
        low, plain, rank_of = self.low, self.plain, self.rank_of
        for j in range(i + 3, min(len(low), i + self.longest) + 1):
            rank = rank_of.get(low[i:j]) or rank_of.get(plain[i:j])
            if rank:
                part = self.value[i:j]
                upper = sum(c.isupper() for c in part)
                shape = 0 if not upper else math.log10(2) if part[0].isupper() and upper == 1 or upper == len(part) else math.log10(sum(math.comb(len(part), k) for k in range(1, upper + 1)) + 1)
                swapped = sum(a != b for a, b in zip(low[i:j], plain[i:j])) if low[i:j] not in rank_of else 0
                yield j, math.log10(rank + 1) + shape + swapped * math.log10(2)
        for pattern in DATES:
            if m := pattern.match(low, i):
                yield m.end(), math.log10(120) if len(m[0]) == 4 else math.log10(365 * 120) + (len(m[0]) > 8) * math.log10(4)


def _walks(low: str) -> tuple[list[int], list[int], list[int]]:
    """For each place the start and the end of the walk it is in, and how often walks have turned up to it."""
    n = len(low)
    start, end, turned = [*range(n)], [*range(1, n + 1)], [0] * n
    last = None
    for i in range(1, n):
        near = _near(low[i - 1], low[i])
        step = (PLACE[low[i]][0] - PLACE[low[i - 1]][0], PLACE[low[i]][1] - PLACE[low[i - 1]][1]) if near else None
        turned[i] = turned[i - 1] + (near and last is not None and step != last)
        last = step
        if near:
            start[i] = start[i - 1]
    for i in range(n - 2, -1, -1):
        if start[i + 1] == start[i]:
            end[i] = end[i + 1]
    return start, end, turned


def _least(starts: list[tuple[int, float]], at: int, growth) -> float:
    """The least of level + growth(length) of segments from starts to a place.

    growth slows down with length: a start that a later one of a lower level beats, or a
    later one that is already dearer than an earlier one, is beaten from here on and goes.
    """
    kept: list[tuple[int, float]] = []
    low = math.inf
    for start, level in starts:
        here = level + growth(at - start)
        if here < low:
            while kept and kept[-1][1] >= level:
                kept.pop()
            kept.append((start, level))
            low = here
    starts[:] = kept
    return low


@lru_cache(maxsize=4096)
def _unit_cost(unit: str, path: str | None, limit: float) -> float:
    return cost(unit, path, limit)


def cost(value: str, path: str | None = None, limit: float = math.inf) -> float:
    """log10 of the guesses for the cheapest segmentation of a value; limit, if it is that or more.

    A brute-force span costs ten guesses a character, and each further segment twice as many.
    """
    n, turn, walk = len(value), math.log10(4), math.log10(47)
    words = Words(value, path)
    begin, end, turned = _walks(words.low)
    starting: dict[int, list[tuple[int, int, int, list]]] = {}
    for a, b, unit in runs(value):
        starting.setdefault(a, []).append((a, b, unit, [[] for _ in range(min(unit, b - a - 2 * unit + 1))]))
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)  # brute: the best that ends in a brute-force span
    inside: list[tuple[int, int, int, list]] = []
    walks: list[tuple[int, float]] = []
    reach = 0
    for i in range(n + 1):
        if i > reach:
            return limit
        step = math.log10(2) if i else 0.0
        before = lambda at: best[at] + (math.log10(2) if at else 0.0)
        inside = [run for run in inside if run[1] >= i]
        for a, b, unit, by_start in inside:
            at = i - 2 * unit
            if at >= a:
                starts = by_start[(at - a) % unit]
                if best[at] < limit and (own := _unit_cost(value[at : at + unit], path, limit)) < limit:
                    starts.append((at, before(at) + own))
                if starts:
                    best[i] = min(best[i], _least(starts, i, lambda size, unit=unit: math.log10(size // unit + 1)))
        if i >= 1 and walks and begin[i - 1] > walks[-1][0]:
            walks = []
        at = i - 3
        if at >= 0 and begin[i - 1] <= at and best[at] < limit:
            walks.append((at, before(at) + walk + (1 - turned[at + 1]) * turn))
        if walks:
            best[i] = min(best[i], _least(walks, i, math.log10) + turned[i - 1] * turn)
        best[i] = min(best[i], brute[i])
        if i == n:
            return min(best[n], limit)
        inside += starting.get(i, ())
        if best[i] >= limit:
            continue
        brute[i + 1] = min(brute[i], best[i] + step) + 1
        reach = max(reach, i + 1, end[i], *(b for _, b, unit, _ in inside if i + 2 * unit <= b))
        for j, guesses in words.at(i):
            best[j] = min(best[j], best[i] + step + guesses)
            reach = max(reach, j)
    return min(best[n], limit)


def find_secrets(text: str, path: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind as listed, end) of all spans, in order."""
    low = text.lower()
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if any(h in low for h in HINTS):
        taken = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
        out += taken
        edges = iter(taken)
        span = next(edges, None)
        m = CONTEXT.search(text)
        while m:
            start, stop = m.span(2)
            while span and span[2] <= m.start():
                span = next(edges, None)
            after_base = span and span[0] <= start < span[2]  # the base pattern's value: what it leaves of a secret goes too
            if after_base and (then := NEXT_KEY.search(text, span[2], stop)):
                stop = then.start()
            end = start + len(text[start:stop].rstrip(".?)" if after_base else ".!?)"))
            least = min(LEAST_COST, end - start)
            if end > span[2] if after_base else end - start >= 6:
                if cost(text[start:end], path, least) >= least:
                    out.append((start, 3, end))
            m = CONTEXT.search(text, stop)
    return sorted(out)


MASK = "[SECRET]"


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each run of spans replaced."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, path: str | None = None) -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points) of each text, and masked_text with with_text. path: a vocabulary for words."""
    path = path or words_path()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            column = batch.column("text")
            data, offsets = A.flat(column)
            for lo, hi in A.pieces(data, offsets):
                texts = column.slice(lo, hi - lo).to_pylist()
                found = [find_secrets(t, path) for t in texts]
                out = {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "spans": pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in found], kind)}
                if with_text:
                    out["masked_text"] = pa.array([masked(t, x) if x else t for t, x in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>" + ", masked_text string" * with_text
    return A.documents(df, id_col, text_col).mapInArrow(scan, schema).withColumn("doc_id", A.outer_id())


def mask_secrets(df: DataFrame, text_col: str = "text", length_col: str = "n_chars", path: str | None = None) -> DataFrame:
    """df with secrets masked in its texts (nulls stay), and length_col, where there is one, as the new length in characters."""
    path = path or words_path()
    A.bound_batches(df.sparkSession)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None or not (x := find_secrets(t, path)) else masked(t, x) for t in batch.column(text_col).to_pylist()]
            at = batch.schema.get_field_index(text_col)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    out = df.mapInArrow(mask, df.schema)
    return out.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType)) if length_col in df.columns else out


def digests(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("guess"), F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
