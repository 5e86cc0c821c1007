"""Near-duplicate pairs from embeddings and weighted terms."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.shared import saved, written
from .search import dot
from .temporal import merge

#: Categories of a pair's rounded score.
NEAR, WEAK = 0.90, 0.60
#: Blocks of asked vectors where there are few of them.
TASKS = 24
#: Texts whose words are counted in one task.
COUNTED = 4096
#: How far a product of unit vectors in single precision, and a score rounded to six decimals, may be off.
SLACK = 2e-5


def _counted(rows: DataFrame, n: int, key: str, column: str, fold: bool, only: DataFrame | None = None) -> DataFrame:
    """key, asked, terms: a row for each key, its terms with tf; asked: whether the key is in ``only``.

    The n texts are dealt out by key before they are split, so that their words are counted where they are, and
    in parts of COUNTED texts, as words take many times the room of their text.
    """
    parts = max(1, -(-n // COUNTED), min(TASKS, -(-n // 256)))
    text = X.folded(F.col(column)) if fold else F.col(column)
    texts = rows.select(key, text.alias("_text")).repartition(parts, key)
    if only is None:
        texts = texts.withColumn("asked", F.lit(True))
    else:
        known = only.select(key).repartition(parts, key).distinct().withColumn("_in", F.lit(True))
        texts = texts.join(known.hint("shuffle_hash"), key, "left").select(key, "_text", F.col("_in").isNotNull().alias("asked"))
    words = texts.select(key, "asked", F.explode(X.tokens(F.col("_text"))).alias("term"))
    return written(words.groupBy(key, "asked", "term").agg(F.count("*").alias("tf")).groupBy(key, "asked").agg(F.collect_list(F.struct("term", "tf")).alias("terms")))


def _vocabulary(counted: DataFrame, n: int, most: int) -> DataFrame:
    """term, idf of the ``most`` terms by corpus frequency, in that order."""
    each = counted.select(F.inline("terms")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all"))
    return each.orderBy(F.desc("all"), "term").limit(most).select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def term_weights(rows: DataFrame, key: str, column: str, most: int = 10_000, fold: bool = False) -> DataFrame:
    """key, term, weight: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), of unit length; the ``most`` terms by corpus frequency.

    Texts are split once; a row's norm comes from the list of its own terms.  fold: without accents.
    """
    n = rows.count()
    counted = _counted(rows, n, key, column, fold)
    raw = counted.select(key, F.inline("terms")).join(F.broadcast(_vocabulary(counted, n, most)), "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    lists = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("terms"))
    return lists.select(key, "norm", F.inline("terms")).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


@dataclass
class TermVectors:
    """Unit vectors of term weights in short: rows (key, packed, norm) hold the sorted numbers of a text's terms and how often it has each; idf: by number."""

    rows: DataFrame
    idf: np.ndarray


def term_vectors(rows: DataFrame, key: str, column: str, most: int = 10_000, fold: bool = False, only: DataFrame | None = None) -> TermVectors:
    """term_weights as a row for each key, which holds counts instead of weights.  only: a table of the keys whose vectors are asked; all texts count for the vocabulary."""
    n = rows.count()
    counted = _counted(rows, n, key, column, fold, only)
    vocabulary = _vocabulary(counted, n, most).toArrow()  # ``most`` rows
    idf = vocabulary.column("idf").to_numpy().astype(np.float64)
    asked = counted.where("asked").select(F.col(key), F.transform("terms", lambda x: x["term"]).alias("terms"), F.transform("terms", lambda x: x["tf"]).alias("counts"))
    kind = asked.schema[key].dataType.simpleString()
    return TermVectors(asked.mapInArrow(_packed(key, vocabulary.column("term").combine_chunks(), idf), f"`{key}` {kind}, packed binary, norm double"), idf)


def _packed(key: str, vocabulary: pa.Array, idf: np.ndarray):
    """mapInArrow over (key, terms, counts): the steps between the terms' sorted numbers, then their counts, deflated; texts without a term of the vocabulary are left out."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            number = pc.index_in(lists.flatten(), value_set=vocabulary.cast(lists.type.value_type))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            known = number.is_valid().to_numpy(zero_copy_only=False)
            number, row = number.fill_null(0).to_numpy()[known].astype(np.int64), row[known]
            count = batch.column("counts").flatten().to_numpy()[known]
            by = np.lexsort((number, row))
            number, row, count = number[by], row[by], count[by]
            norm = np.sqrt(np.bincount(row, ((1 + np.log(count)) * idf[number]) ** 2, len(lists)))
            start = np.searchsorted(row, np.arange(len(lists) + 1))
            step = np.diff(number, prepend=0)
            there = np.flatnonzero(np.diff(start))
            step[start[there]] = number[start[there]]
            step, count = step.astype("<u4"), count.astype("<u4")
            each = [zlib.compress(step[lo:hi].tobytes() + count[lo:hi].tobytes(), 1) for lo, hi in zip(start[there], start[there + 1])]
            yield pa.RecordBatch.from_pydict({key: batch.column(key).take(pa.array(there)), "packed": pa.array(each, pa.binary()), "norm": pa.array(norm[there])})

    return packed


def _unpacked(packed: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each vector starts (and the last ends), and all their terms and counts."""
    each = [np.frombuffer(zlib.decompress(x), "<u4").reshape(2, -1) for x in packed.to_pylist()]
    start = np.concatenate([[0], np.cumsum([x.shape[1] for x in each])]).astype(np.int64)
    out = np.empty((2, start[-1]), np.uint32)
    for lo, x in zip(start, each):
        np.cumsum(x[0], out=out[0, lo : lo + x.shape[1]], dtype=np.uint32)
        out[1, lo : lo + x.shape[1]] = x[1]
    return start, out[0], out[1]


#: Bytes of packed vectors in a block at most, and pairs of two blocks on average: they bound a task's memory.
PACKED, MET = 32 << 20, 2_000_000


def pair_cosine(vectors: TermVectors, pairs: DataFrame, key: str, a: str, b: str, block: int = 100_000) -> DataFrame:
    """pairs of long keys and their cosine: the product of their unit vectors of terms, 0 where one has none; other columns of the pairs stay.

    Runs of neighbouring keys are dealt into blocks of about ``block`` vectors (fewer where they are long or have many pairs).  A
    vector goes once to each pair of blocks that has a pair of it, so never more often than it has pairs or there are blocks.
    """
    rows = written(vectors.rows.select(F.col(key).cast("long").alias("key"), "packed", "norm"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("packed")), F.lit(0))).first()
    blocks = max(1, -(-n // block), min(5, -(-n // 2000)), -(-size // PACKED), math.ceil(math.sqrt(pairs.count() / MET)))
    dealt = lambda c: F.pmod(F.xxhash64(F.shiftright(c, 8)), F.lit(blocks)).cast("int")
    rest = [c for c in pairs.columns if c not in (a, b)]
    asked = pairs.select(F.col(a).cast("long").alias("key"), F.col(b).cast("long").alias("other"), *(F.col(c).alias(f"_{c}") for c in rest))
    asked = asked.select(dealt("key").alias("own"), dealt("other").alias("there"), F.lit(2).alias("kind"), "key", "other", *(f"_{c}" for c in rest))
    none = lambda frame, names: [F.lit(None).cast(frame.schema[c].dataType).alias(c) for c in names]
    sides = [asked.select("own", "there", F.col(c).alias("key")).distinct().join(rows, "key").select("own", "there", F.lit(i).alias("kind"), "key", *none(asked, ["other", *(f"_{c}" for c in rest)]), "packed", "norm") for i, c in enumerate(("key", "other"))]
    met = sides[0].unionAll(sides[1]).unionAll(asked.select("*", *none(rows, ["packed", "norm"])))
    out = asked.select("key", "other", *(f"_{c}" for c in rest)).withColumn("cosine", F.lit(0.0)).schema
    found = met.groupBy("own", "there").applyInArrow(_dots(vectors.idf, [f"_{c}" for c in rest]), out)
    return found.select(F.col("key").alias(a), F.col("other").alias(b), *(F.col(f"_{c}").alias(c) for c in rest), "cosine")


def _placed(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each asked key is among distinct keys; -1 where it isn't."""
    if not len(keys):
        return np.full(len(asked), -1)
    by = np.argsort(keys, kind="stable")
    found = by[np.minimum(np.searchsorted(keys, asked, sorter=by), len(keys) - 1)]
    return np.where(keys[found] == asked, found, -1)


def _dots(idf: np.ndarray, rest: Sequence[str]):
    """applyInArrow over a pair of blocks: each left vector is spread out once and met by those that it is paired with."""

    def dots(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        asked = table.select(["key", "other", *rest]).filter(pa.array(kind == 2))
        place, start, terms, counts, norm = [], [], [], [], []
        for i, name in enumerate(("key", "other")):
            side = table.select(["key", "packed", "norm"]).filter(pa.array(kind == i))
            place.append(_placed(side.column("key").to_numpy(), asked.column(name).to_numpy()))
            norm.append(side.column("norm").to_numpy())
            for held, x in zip((start, terms, counts), _unpacked(side.column("packed"))):
                held.append(x)
        log = lambda n: 1 + np.log(n)
        cosine, spread = np.zeros(asked.num_rows), np.zeros(len(idf))
        both = np.flatnonzero((place[0] >= 0) & (place[1] >= 0))
        both = both[np.argsort(place[0][both], kind="stable")]
        edges = np.flatnonzero(np.diff(place[0][both], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:]):
            i = place[0][both[lo]]
            own = slice(start[0][i], start[0][i + 1])
            mine = terms[0][own]
            spread[mine] = log(counts[0][own]) * idf[mine] ** 2 / norm[0][i]
            for at in range(lo, hi, 1024):
                met = both[at : min(at + 1024, hi)]
                first = start[1][place[1][met]]
                many = start[1][place[1][met] + 1] - first
                row = np.repeat(np.arange(len(met)), many)
                entry = np.arange(len(row)) + (first - np.cumsum(many) + many)[row]
                part = spread[terms[1][entry]]
                hit = np.flatnonzero(part)
                cosine[met] = np.bincount(row[hit], part[hit] * log(counts[1][entry[hit]]), len(met)) / norm[1][place[1][met]]
            spread[mine] = 0.0
        return asked.append_column("cosine", pa.array(cosine))

    return dots


def normalise(vectors: DataFrame, column: str, least: float = 0.01) -> DataFrame:
    """vectors with norm, valid and, where valid, unit."""
    out = vectors.withColumn("norm", F.sqrt(dot(F.col(column), F.col(column)))).withColumn("valid", F.col("norm") > least)
    return out.withColumn("unit", F.when(F.col("valid"), F.transform(column, lambda x: x.cast("double") / F.col("norm"))))


def nearest(
    vectors: DataFrame, key: str, column: str, k: int, block: int = 32_768, first: int = 1, last: int | None = None,
    asked: DataFrame | None = None, among: DataFrame | None = None,
) -> DataFrame:
    """key, other, score, rank: each vector's k nearest by cosine (above 0, itself left out; ties by key).

    Only keys of ``asked`` get a list, and only keys of ``among`` are in one (tables
    with the key; all keys where there are none).  The asked vectors are dealt into
    blocks of at most about ``block`` rows, and all vectors stream by each block, which
    holds the k best so far: a task's memory is that of its block, its output k rows
    for each asked vector.  Every pair of the two sides is compared.
    """
    every = vectors.select(F.col(key).cast("long").alias("key"), (F.slice(column, first, (last or 1 << 30) - first + 1) if first > 1 or last else F.col(column)).alias("v"))
    side = lambda keys: every if keys is None else every.join(keys.select(F.col(key).cast("long").alias("key")), "key", "left_semi")
    return streamed_nearest(side(asked), side(among), k, block)


def streamed_nearest(one: DataFrame, two: DataFrame, k: int, block: int = 32_768) -> DataFrame:
    """As nearest, of the vectors (key, v) of one table among those of another."""
    n = one.count()
    blocks = max(1, -(-n // block), min(TASKS, -(-n // 512)))
    asks = one.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("own"), F.lit(False).alias("there"), "key", "v")
    there = two.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("own"), F.lit(True).alias("there"), "key", "v")
    met = asks.unionAll(there).repartition(2 * blocks, "own").sortWithinPartitions("own", "there")
    return met.mapInArrow(_streamed(k), "key long, other long, score double, rank int")


def unit_rows(column: pa.Array) -> np.ndarray:
    """The unit vectors of a list column, as rows."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


class Best:
    """The k best scores of some asked vectors (unit rows) among those that were met so far."""

    def __init__(self, keys: np.ndarray, m: np.ndarray, k: int):
        self.keys, self.m, self.k = keys, m, k
        self.low = m.astype(np.float32)
        self.least = np.full(len(keys), -np.inf)  # a row's k-th best, once it has k
        self.held, self.rows, self.settled = [], 0, False
        self.full = 2 * k * len(keys)

    def meet(self, others: np.ndarray, m: np.ndarray) -> None:
        low, step = m.astype(np.float32).T.copy(), max(1, 1_000_000 // max(len(others), 1))
        for lo in range(0, len(self.keys), step):
            self._meet(lo, lo + step, others, m, low)
        if self.rows > self.full or not self.settled:
            self.settle()

    def _meet(self, lo: int, hi: int, others: np.ndarray, m: np.ndarray, low: np.ndarray) -> None:
        score = self.low[lo:hi] @ low  # a first look, to SLACK
        least = self.least[lo:hi]
        if len(others) > self.k and not np.isfinite(least).any():  # its k + 1 best, of which one may be itself, hold the k best
            least = np.partition(score, len(others) - self.k - 1, axis=1)[:, len(others) - self.k - 1]
        at = np.flatnonzero(score >= np.maximum(least - SLACK, 0.0).astype(np.float32)[:, None])
        row, col = at // len(others) + lo, at % len(others)
        got, other = np.round(np.einsum("ij,ij->i", self.m[row], m[col]), 6), others[col]
        keep = (got > 0) & (self.keys[row] != other)
        self.held.append((row[keep], other[keep], got[keep]))
        self.rows += len(self.held[-1][0])

    def settle(self) -> tuple[np.ndarray, ...]:
        """row, other, score, rank of the best; ties by the other key."""
        row, other, score = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
        by = np.lexsort((other, -score, row))
        row, other, score = row[by], other[by], score[by]
        start = np.searchsorted(row, np.arange(len(self.keys)))
        rank = np.arange(len(row)) - start[row] + 1 if len(row) else row
        best = rank <= self.k
        row, other, score, rank = row[best], other[best], score[best], rank[best]
        last = rank == self.k
        self.least[row[last]] = score[last]
        self.held, self.rows, self.settled = [(row, other, score)], len(row), True
        return row, other, score, rank

    def batch(self) -> pa.RecordBatch:
        row, other, score, rank = self.settle()
        return pa.RecordBatch.from_pydict({"key": pa.array(self.keys[row], pa.int64()), "other": pa.array(other, pa.int64()), "score": pa.array(score, pa.float64()), "rank": pa.array(rank, pa.int32())})


def _streamed(k: int):
    """mapInArrow over (own, there, key, v) in the order of own and there: the k best of each block's asked vectors."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asks, best = None, [], None
        for batch in batches:
            own, there = batch.column("own").to_numpy(), batch.column("there").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(own) != 0) | (there[1:] != there[:-1])) + 1).tolist(), len(own)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi == lo:
                    continue
                if own[lo] != now:
                    if best is not None:
                        yield best.batch()
                    now, asks, best = own[lo], [], None
                keys, m = batch.column("key")[lo:hi].to_numpy(), unit_rows(batch.column("v")[lo:hi])
                if not there[lo]:
                    asks.append((keys, m))
                elif asks:
                    best = best or Best(np.concatenate([x for x, _ in asks]), np.concatenate([x for _, x in asks]), k)
                    for at in range(0, len(keys), 2048):
                        best.meet(keys[at : at + 2048], m[at : at + 2048])
        if best is not None:
            yield best.batch()

    return streamed


def pair_values(pairs: DataFrame, vectors: DataFrame, key: str, column: str, parts: Sequence[tuple[int, int]], block: int = 100_000) -> DataFrame:
    """key, other, c of pairs (key, other): the cosines of each slice (first, last from 1) of their vectors.

    Both sides' vectors are dealt into blocks, and each pair of blocks meets its pairs, so that a vector goes to each
    block once and not to each of its pairs.
    """
    n = vectors.count()
    blocks = max(1, -(-n // block), min(5, -(-n // 2000)))
    dealt = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.lit(None).cast("long").alias("other"), F.col(column).alias("v"))
    order = ["own", "there", "kind", "key", "other", "v"]
    left = rows.select("*", dealt("key").alias("own"), each.alias("there"), F.lit(0).alias("kind")).select(*order)
    right = rows.select("*", dealt("key").alias("there"), each.alias("own"), F.lit(1).alias("kind")).select(*order)
    asked = pairs.select(dealt("key").alias("own"), dealt("other").alias("there"), F.lit(2).alias("kind"), "key", "other", F.lit(None).cast(vectors.schema[column].dataType).alias("v"))

    def values(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        at = [table.filter(pa.array(kind == i)) for i in range(3)]
        sides, place = [], []
        for side, name in zip(at, ("key", "other")):
            keys, ask = side.column("key").to_numpy(), at[2].column(name).to_numpy()
            by = np.argsort(keys, kind="stable")
            found = by[np.minimum(np.searchsorted(keys, ask, sorter=by), len(keys) - 1)] if len(keys) else np.zeros(0, int)
            place.append((found, keys[found] == ask if len(keys) else np.zeros(len(ask), bool)))
            sides.append(side.column("v").combine_chunks())
        there = place[0][1] & place[1][1] if all(len(s) for s in sides) else np.zeros(at[2].num_rows, bool)
        took = at[2].select(["key", "other"]).filter(pa.array(there))
        if not took.num_rows:
            return took.append_column("c", pa.array([], pa.list_(pa.float64())))
        x, y = (v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) for v in sides)
        i, j = place[0][0][there], place[1][0][there]
        out = np.empty((took.num_rows, len(parts)))
        for lo in range(0, took.num_rows, 8192):
            out[lo : lo + 8192] = slice_cosines(x[i[lo : lo + 8192]], y[j[lo : lo + 8192]], parts)
        ends = np.arange(0, out.size + 1, len(parts), dtype=np.int32)
        return took.append_column("c", pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel())))

    return left.unionAll(right).unionAll(asked).groupBy("own", "there").applyInArrow(values, "key long, other long, c array<double>")


def slice_cosines(a: np.ndarray, b: np.ndarray, parts: Sequence[tuple[int, int]]) -> np.ndarray:
    """The cosine of each slice of the rows of two matrices; 0 where one has no length."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    out = []
    for lo, hi in parts:
        p, q = x[:, lo - 1 : hi], y[:, lo - 1 : hi]
        norm = np.sqrt((p * p).sum(1) * (q * q).sum(1))
        out.append(np.divide((p * q).sum(1), norm, out=np.zeros(len(p)), where=norm > 0))
    return np.stack(out, 1)


def best_of(lists: DataFrame, k: int) -> DataFrame:
    """The k best of each key's entries, with their rank; ties by the other key."""
    w = Window.partitionBy("key").orderBy(F.desc("score"), "other")
    return lists.select("key", "other", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def updated_nearest(lists: DataFrame, vectors: DataFrame, changed: DataFrame, key: str, column: str, k: int, **how) -> tuple[DataFrame, DataFrame]:
    """The k nearest after some vectors came, changed or went, and the keys whose list may have changed.

    lists: the k nearest before; vectors: all of now; changed: the keys (key).  A
    changed vector gets a new list.  Of the others, those whose list was full and
    lost an entry are compared with all again, as what was behind it isn't known; the
    rest keep their list, and the changed vectors that beat its last entry come in.
    """
    c = changed.select(F.col(key).cast("long").alias("key")).distinct()
    now = vectors.select(F.col(key).cast("long").alias("key"))
    same = now.join(c, "key", "left_anti")
    old = lists.select("key", "other", "score").join(c, "key", "left_anti").join(now, "key", "left_semi")
    is_in = c.select(F.col("key").alias("other"))
    lost = old.join(is_in, "other", "left_semi").select("key").distinct()
    full = old.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("key")
    again = saved(lost.join(full, "key", "left_semi").union(c.join(now, "key", "left_semi")).distinct())
    rest = same.join(again, "key", "left_anti")
    name = lambda df: df.withColumnRenamed("key", key)
    fresh = nearest(vectors, key, column, k, asked=name(again), **how).select("key", "other", "score")
    came = nearest(vectors, key, column, k, asked=name(rest), among=name(c), **how).select("key", "other", "score")
    held = old.join(is_in, "other", "left_anti").join(again, "key", "left_anti")
    last = held.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    came = saved(came.join(last, "key", "left").where(F.coalesce(F.col("n"), F.lit(0)) < k).unionByName(came.join(last, "key").where((F.col("n") >= k) & (F.col("score") >= F.col("least")))).select("key", "other", "score"))
    out = saved(fresh.unionByName(best_of(held.unionByName(came), k).drop("rank")))
    return best_of(out, k), again.union(came.select("key")).union(lost).distinct()


def rebuild_mode(n: int, changed: int, affected: int, forced: bool = False, guard: int = 20_000) -> str:
    """full, incremental or skip: full when forced, when as many changed as there are, or when a hub makes too many affected."""
    if forced or n and changed >= n or affected > guard:
        return "full"
    return "incremental" if changed else "skip"


def rescanned(vectors: DataFrame, key: str, column: str, parts: Sequence[tuple[int, int]], asked: DataFrame, k: int = 200) -> DataFrame:
    """The k candidates of some keys by the mean cosine of all parts (of the valid ones, where a part has no length)."""
    units = vectors
    for i, (lo, hi) in enumerate(parts):
        units = normalise(units.withColumn("_p", F.slice(column, lo, hi - lo + 1)), "_p")
        units = units.withColumn(f"_u{i}", F.coalesce("unit", F.array_repeat(F.lit(0.0), hi - lo + 1))).drop("_p", "norm", "valid", "unit")
    joined = units.select(key, F.concat(*(f"_u{i}" for i in range(len(parts)))).alias("_v"))
    return nearest(joined, key, "_v", k, asked=asked)


def pair_versions(versions: DataFrame, touched: DataFrame, pairs: DataFrame, now: Column, columns: Sequence[str] = ("score", "category", "rank")) -> DataFrame:
    """Versions of pairs (key, other) after the touched keys' pairs were made anew: what changed or went is closed, what is new is opened."""
    mine = versions.join(touched.select("key"), "key", "left_semi")
    others = versions.join(touched.select("key"), "key", "left_anti")
    return others.unionByName(merge(mine.select("key", "other", *columns, "tx_from", "tx_to"), pairs, ["key", "other"], columns, now, close_missing=True).select(others.columns))


def pair_score(parts: Sequence[tuple[Column, Column]]) -> Column:
    """The mean over features of the mean of two clipped signals; a missing one counts as 0."""
    clip = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    total = F.lit(0.0)
    for a, b in parts:
        total = total + (clip(a) + clip(b)) / 2
    return F.round(total / len(parts), 4)


def category(score: Column, near: float = NEAR, weak: float = WEAK) -> Column:
    return F.when(score >= near, "near_duplicate").when(score >= weak, "weak_similar")


def top_pairs(scored: DataFrame, key: str, other: str, k: int = 3, near: float = NEAR, weak: float = WEAK) -> DataFrame:
    """The k best categorised pairs of each key, ranked."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), other)
    return scored.withColumn("category", category(F.col("score"), near, weak)).where("category IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def refresh(kept: DataFrame, scored: DataFrame, changed: DataFrame, key: str, other: str, k: int = 3, near: float = NEAR, weak: float = WEAK) -> DataFrame:
    """Top pairs after some keys changed: only keys that changed, or whose pairs touch a changed one, are ranked anew."""
    touched = changed.select(key).union(kept.join(changed.select(F.col(key).alias(other)), other, "left_semi").select(key)).union(scored.join(changed.select(F.col(key).alias(other)), other, "left_semi").select(key)).distinct()
    return kept.join(touched, key, "left_anti").unionByName(top_pairs(scored.join(touched, key, "left_semi"), key, other, k, near, weak).select(kept.columns))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The maximum spanning forest of a (a, b, score) table, by Boruvka rounds of joins; ties by ends.

    Each round every component takes its best edge.  These edges point from component to component; as their order is
    total, two that point to each other are all the cycles there are, and pointers are halved until each is at its root.
    What is left are edges between roots, of at most half as many components.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").distinct()
    live = written(e.select(F.col("a").alias("la"), F.col("b").alias("lb"), "a", "b", "score"))
    chosen = edges.limit(0).select("a", "b", "score")
    while not live.isEmpty():
        order = F.struct((-F.col("score")).alias("d"), "a", "b")
        ends = live.select(F.inline(F.array(F.struct(F.col("la").alias("l"), F.col("lb").alias("to"), order.alias("m")), F.struct(F.col("lb").alias("l"), F.col("la").alias("to"), order.alias("m")))))
        best = written(ends.groupBy("l").agg(F.min_by("to", "m").alias("to"), F.min("m").alias("m")))
        chosen = chosen.unionAll(best.select("m.a", "m.b", (-F.col("m.d")).alias("score")).distinct())
        back = best.select(F.col("l").alias("to"), F.col("to").alias("_back"))
        step = written(best.select("l", "to").join(back, "to").select("l", F.when((F.col("_back") == F.col("l")) & (F.col("l") < F.col("to")), F.col("l")).otherwise(F.col("to")).alias("to")))
        while True:
            two = written(step.join(step.select(F.col("l").alias("to"), F.col("to").alias("next")), "to").select("l", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            step = two.select("l", "to")
            if two.where("moved").isEmpty():
                break
        named = live.join(step.select(F.col("l").alias("la"), F.col("to").alias("ra")), "la").join(step.select(F.col("l").alias("lb"), F.col("to").alias("rb")), "lb").where("ra <> rb")
        live = written(named.select(F.col("ra").alias("la"), F.col("rb").alias("lb"), "a", "b", "score"))
    return chosen
