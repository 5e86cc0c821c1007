"""Nearest neighbours by an index that is kept, and exactly by bounds on angles.

Unit vectors are dealt to the nearest of some centres, in each to rings by their angle
to it, and a ring of many rows to cells of about ``CELL``.  The index is Parquet with a
folder for each centre's list: short product codes of what is left of a vector after its
centre, and beside them the vectors.  A search gives each asked vector the lists of its
``probe`` nearest centres, ranks their codes, and takes the best ``short`` keys' vectors to
rank them exactly.  ``pruned_nearest`` is exact: a first pass finds each asked vector's
k-th best in its own list, and a second one takes only the rings that may hold a better
one, as an angle is no smaller than the difference of both angles to the centre.

Centres and code words are fitted on ``SAMPLE`` rows at most, by the hash of the key;
every row is indexed.  ``probe`` is the least number of lists that reaches ``RECALL`` for
``TRIED`` of the sample's rows; what a search reaches is measured by ``recall``.
Centres are ``LISTS`` at most and rings ``RINGS`` for each, so their table can be sent to all tasks.

Null vectors, those of another length than the first rows' and those without a length aren't in any list and
have none; keys are distinct longs; an empty table gives an index without lists.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import saved
from .similarity import TASKS, _streamed, best_of, streamed_nearest

SAMPLE, LISTS, RINGS, CELL = 20_000, 2048, 8, 4096
#: Asked vectors of a cell that are compared at a time, and rows that a list has on average.
ASKED, LIST_ROWS = 2048, 512
PARTS, WORDS = 16, 256
RECALL, TRIED = 0.95, 200
#: Rows of asked vectors and their lists that a task makes at a time.
SENT = 16_384
#: Scores are rounded to six decimals, so a bound this much worse may still tie.
SLACK = 2e-6
CELLS = "list int, ring int, cell int, key long, v array<double>"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The unit vectors of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def centres_of(m: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k means of the rows by distance; an empty one starts again from the row that is farthest off."""
    rng = np.random.default_rng(seed)
    c = m[rng.choice(len(m), k, replace=False)].copy()
    for _ in range(rounds):
        away = (c * c).sum(1) - 2 * (m @ c.T)
        own = away.argmin(1)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=k)
        np.add.at(sums, own, m)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = m[np.argsort(-(away.min(1) + (m * m).sum(1)), kind="stable")[: len(empty)]]
    return c


def directions(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)


@dataclass
class Model:
    """What every task knows of an index: centres, code words of each part and, of each ring, the angles between which it lies."""

    dim: int
    centres: np.ndarray
    words: list[np.ndarray]
    edges: np.ndarray
    probe: int = 1

    def angles(self, m: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(m @ self.centres.T, -1, 1))

    def parts(self) -> list[slice]:
        edge = np.linspace(0, self.dim, min(PARTS, self.dim) + 1).astype(int)
        return [slice(a, b) for a, b in zip(edge[:-1], edge[1:])]

    def codes(self, rest: np.ndarray) -> np.ndarray:
        out = np.empty((len(rest), len(self.words)), np.uint8)
        for i, (part, word) in enumerate(zip(self.parts(), self.words)):
            out[:, i] = ((word * word).sum(1) - 2 * (rest[:, part] @ word.T)).argmin(1)
        return out

    def tables(self, asked: np.ndarray) -> list[np.ndarray]:
        """For each part the products of the asked vectors with its code words."""
        return [asked[:, part] @ word.T for part, word in zip(self.parts(), self.words)]

    def dumps(self) -> str:
        return json.dumps({"dim": self.dim, "centres": self.centres.tolist(), "words": [w.tolist() for w in self.words], "edges": self.edges.tolist(), "probe": self.probe})

    @classmethod
    def loads(cls, text: str) -> Model:
        x = json.loads(text)
        shaped = lambda rows, width: np.array(rows, np.float64).reshape(-1, width)
        parts = np.diff(np.linspace(0, x["dim"], min(PARTS, max(x["dim"], 1)) + 1).astype(int))
        return cls(x["dim"], shaped(x["centres"], max(x["dim"], 1)), [shaped(w, n) for w, n in zip(x["words"], parts)], shaped(x["edges"], RINGS - 1), x["probe"])


def rows_of(vectors: DataFrame, key: str, column: str, dim: int | None = None) -> DataFrame:
    """(key, v) of the vectors that have a length."""
    v = F.col(column).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    out = vectors.select(F.col(key).cast("long").alias("key"), F.when(whole, v).alias("v")).where("key IS NOT NULL AND v IS NOT NULL")
    return out if dim is None else out.where(F.size("v") == dim)


def fit(rows: DataFrame, lists: int | None = None) -> Model:
    """A model from a bounded sample of (key, v)."""
    by_hash = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toArrow()
    if not by_hash.num_rows:
        return Model(0, np.zeros((0, 1)), [], np.zeros((0, RINGS - 1)))
    dim = len(by_hash.column("v")[0])
    m = matrix(by_hash.filter(pa.compute.equal(pa.compute.list_value_length(by_hash.column("v")), dim)).column("v"), dim)
    lists = min(lists or max(1, round(rows.count() / LIST_ROWS)), LISTS, len(m))
    model = Model(dim, directions(centres_of(m, lists)), [], np.zeros((lists, RINGS - 1)))
    angles = model.angles(m)
    own = angles.argmin(1)
    rest = m - model.centres[own]
    model.words = [centres_of(rest[:, part], min(WORDS, len(m)), 8) for part in model.parts()]
    for i in range(lists):
        mine = angles[own == i, i]
        model.edges[i] = np.quantile(mine, np.linspace(0, 1, RINGS + 1)[1:-1]) if len(mine) else 0.0
    tried = m[:TRIED]
    near = np.argsort(-(tried @ m.T), axis=1)[:, 1:11]
    place = np.argsort(np.argsort(angles[:TRIED], axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    model.probe = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1 if near.size else 1
    return model


def _dealt(model: Model):
    """mapInArrow over (key, v): list, ring, angle and code of each vector."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column("v"), model.dim)
            angles = model.angles(m)
            own = angles.argmin(1)
            angle = angles[np.arange(len(m)), own]
            ring = (angle[:, None] > model.edges[own]).sum(1)
            codes = model.codes(m - model.centres[own])
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key"), "v": pa.array(list(m), pa.list_(pa.float64())), "list": pa.array(own, pa.int32()), "ring": pa.array(ring, pa.int32()),
                "angle": pa.array(angle, pa.float64()), "code": pa.array([c.tobytes() for c in codes], pa.binary())})

    return deal


def build(vectors: DataFrame, key: str, column: str, folder: str, lists: int | None = None) -> VectorIndex:
    """Writes an index of all vectors to a new folder."""
    spark = vectors.sparkSession
    rows = rows_of(vectors, key, column)
    model = fit(rows, lists)
    spark.createDataFrame([(model.dumps(),)], "model string").coalesce(1).write.parquet(f"{folder}/model")
    if model.dim:
        dealt = saved(rows.where(F.size("v") == model.dim).mapInArrow(_dealt(model), "key long, v array<double>, list int, ring int, angle double, code binary"))
        rings = dealt.groupBy("list", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        rings = saved(rings.withColumn("cells", F.ceil(F.col("n") / CELL).cast("int")))
        rings.coalesce(1).write.parquet(f"{folder}/rings")
        out = dealt.join(F.broadcast(rings.select("list", "ring", "cells")), ["list", "ring"]).withColumn("cell", F.pmod(F.xxhash64("key"), F.col("cells")).cast("int"))
        out = out.repartition("list", "ring", "cell").sortWithinPartitions("list", "ring", "cell", "key")
        out.select("list", "ring", "cell", "key", "code").write.partitionBy("list").parquet(f"{folder}/codes")
        out.select("list", "ring", "cell", "key", "v").write.partitionBy("list").parquet(f"{folder}/vectors")
    return VectorIndex(spark, folder)


class VectorIndex:
    """A kept index; opening it reads the model alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.model = Model.loads(spark.read.parquet(f"{folder}/model").first().model)

    def table(self, name: str, lists: list[int] | None = None) -> DataFrame:
        """codes or vectors, of some lists."""
        kind = {"codes": "code binary", "vectors": "v array<double>"}[name]
        out = self.spark.read.schema(f"ring int, cell int, key long, {kind}, list int").parquet(f"{self.folder}/{name}")
        return out if lists is None else out.where(F.col("list").isin(*lists))

    def rings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rings")

    def search(self, asked: DataFrame, key: str, column: str, k: int, probe: int | None = None, short: int | None = None) -> DataFrame:
        """key, other, score, rank: the k nearest that the index finds for each asked vector (above 0, itself left out)."""
        model, spark = self.model, self.spark
        if not model.dim:
            return spark.createDataFrame([], "key long, other long, score double, rank int")
        asks = rows_of(asked, key, column, model.dim)
        probe, short = min(probe or model.probe, len(model.centres)), short or 8 * k + 32
        if probe == len(model.centres) and short >= self.rings().agg(F.sum("n")).first()[0]:  # nothing is left out
            return streamed_nearest(asks, self.table("vectors").select("key", "v"), k)
        sent = saved(asks.mapInArrow(_probes(model, probe), "key long, v array<double>, list int"))
        lists = sorted(r[0] for r in sent.select("list").distinct().collect())  # LISTS at most
        goes = sent.join(F.broadcast(self.rings().select("list", "ring", "cells")), "list")
        coded = _compared(goes, self.table("codes", lists), "code binary", _code_scores(model, short), short)
        chosen = best_of(coded, short).select("key", "other")
        own = self.table("vectors", lists).select(F.col("key").alias("other"), F.col("v").alias("_w"))
        met = chosen.join(own, "other").join(asks.withColumnRenamed("v", "_v"), "key")
        return best_of(met.mapInArrow(_exact, "key long, other long, score double"), k)

    def pruned_nearest(self, asked: DataFrame, key: str, column: str, k: int) -> tuple[DataFrame, DataFrame]:
        """The k nearest of all indexed vectors, exactly, for each asked vector; and a row with the pairs compared and all pairs there are."""
        model, spark = self.model, self.spark
        if not model.dim:
            return spark.createDataFrame([], "key long, other long, score double, rank int"), spark.createDataFrame([(0, 0)], "compared long, pairs long")
        asks = rows_of(asked, key, column, model.dim)
        rings = self.rings()
        first = saved(asks.mapInArrow(_probes(model, 1), "key long, v array<double>, list int").join(F.broadcast(rings.select("list", "ring", "cells", "n")), "list"))
        near = saved(_compared(first, self.table("vectors"), "v array<double>", _vector_scores(model.dim, k), k))
        last = best_of(near, k).groupBy("key").agg(F.count("*").alias("m"), F.min("score").alias("least")).select("key", F.when(F.col("m") >= k, F.col("least")).otherwise(0.0).alias("least"))
        table = rings.toArrow()  # LISTS * RINGS rows at most
        bounded = asks.join(last, "key", "left").join(first.select("key", "list").distinct(), "key").select("key", "v", F.coalesce("least", F.lit(0.0)).alias("least"), "list")
        blocks = self._blocks(bounded)
        own = F.col("start") + F.pmod(F.xxhash64("key"), "parts").cast("int")
        bounded = saved(bounded.join(F.broadcast(blocks), "list").select(own.alias("own"), "key", "v", "least"))
        within = bounded.repartition("own").mapInArrow(_within(model, table), "own int, list int, ring int")
        wanted = saved(within.distinct())  # rings that some vector of a block needs
        there = self.table("vectors").join(F.broadcast(wanted), ["list", "ring"]).select("own", F.lit(True).alias("there"), "key", "v")
        sides = bounded.select("own", F.lit(False).alias("there"), "key", "v").unionAll(there)
        met = sides.repartition(2 * max(1, blocks.agg(F.sum("parts")).first()[0] or 1), "own").sortWithinPartitions("own", "there")
        found = met.mapInArrow(_streamed(k), "key long, other long, score double, rank int")
        most = bounded.groupBy("own").agg(F.count("*").alias("m"))
        more = wanted.join(F.broadcast(rings.select("list", "ring", "n")), ["list", "ring"]).join(F.broadcast(most), "own").select((F.col("n") * F.col("m")).alias("n"))
        counted = more.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
        every = asks.agg(F.count("*").alias("asks")).crossJoin(F.broadcast(rings.agg(F.sum("n").alias("rows"))))  # one row each
        count = counted.crossJoin(F.broadcast(every)).select("compared", (F.col("asks") * F.col("rows")).alias("pairs"))
        return found, count

    def _blocks(self, asks: DataFrame) -> DataFrame:
        """list, start, parts: the blocks of asked vectors (list, ...) of each list; lists near to each other share one, a large one is cut."""
        sizes = {r.list: r.n for r in asks.groupBy("list").agg(F.count("*").alias("n")).collect()}  # LISTS at most
        block = ASKED * max(1, min(4, sum(sizes.values()) // (ASKED * TASKS)))
        groups = max(1, min(len(self.model.centres), round(sum(sizes.values()) / block)))
        near = (self.model.centres @ directions(centres_of(self.model.centres, groups)).T).argmax(1)
        rows, start, held = [], 0, 0
        for x in sorted(sizes, key=lambda x: (near[x], x)):
            if held and (held + sizes[x] > block):
                start, held = start + 1, 0
            parts = max(1, -(-sizes[x] // block))
            rows.append((int(x), start, parts))
            start, held = (start + parts, 0) if parts > 1 else (start, held + sizes[x])
        return self.spark.createDataFrame(rows, "list int, start int, parts int")


def _probes(model: Model, probe: int):
    """mapInArrow over (key, v): a row for each of the ``probe`` nearest lists; about ``SENT`` rows leave at a time."""
    step = max(1, SENT // max(1, probe))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                m = matrix(part.column("v"), model.dim)
                lists = np.argsort(model.angles(m), axis=1, kind="stable")[:, :probe]
                row = np.repeat(np.arange(len(m)), lists.shape[1])
                yield pa.RecordBatch.from_pydict({"key": part.column("key").take(pa.array(row)), "v": part.column("v").take(pa.array(row)), "list": pa.array(lists.ravel(), pa.int32())})

    return probes


def _within(model: Model, rings: pa.Table):
    """mapInArrow over (own, key, v, least): for each block the rings that may hold a score of ``least`` or more for one of its vectors."""
    cols = {c: rings.column(c).to_numpy() for c in ("list", "ring", "low", "high")}

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                to = model.angles(matrix(part.column("v"), model.dim))[:, cols["list"]]
                bound = np.maximum(0, np.maximum(to - cols["high"], cols["low"] - to))
                least, own = part.column("least").to_numpy(zero_copy_only=False), part.column("own").to_numpy()
                may = np.cos(np.minimum(bound, np.pi)) >= least[:, None] - SLACK
                for x in np.unique(own).tolist():
                    found[x] = found.get(x, False) | may[own == x].any(0)
        for x, some in found.items():
            ring = np.flatnonzero(some)
            yield pa.RecordBatch.from_pydict({"own": pa.array(np.full(len(ring), x), pa.int32()), **{c: pa.array(cols[c][ring], pa.int32()) for c in ("list", "ring")}})

    return within


def _compared(goes: DataFrame, rows: DataFrame, kind: str, scores, k: int) -> DataFrame:
    """key, other, score of asked vectors (key, v, list, ring, cells) in the cells that they go to: the k best of each cell.

    Of a ring that many ask for, its asked vectors are cut into parts of about ``ASKED``, and its rows go to each part.
    """
    asks = goes.groupBy("list", "ring").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))  # LISTS * RINGS rows at most
    name = kind.split(" ")[0]
    mine = goes.join(F.broadcast(asks), ["list", "ring"]).select("list", "ring", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), "key", "v")
    theirs = rows.join(F.broadcast(asks), ["list", "ring"]).select("list", "ring", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", name)
    by = ["list", "ring", "cell", "part"]
    return mine.groupBy(*by).cogroup(theirs.groupBy(*by)).applyInArrow(scores, "key long, other long, score double")


def _best(keys: np.ndarray, others: np.ndarray, score: np.ndarray, k: int, least: float | None) -> pa.Table:
    """The k best of each row of scores; ties by the other key."""
    by = np.argsort(others, kind="stable")
    others, score = others[by], score[:, by]
    score[keys[:, None] == others[None, :]] = -np.inf
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    taken = np.take_along_axis(score, order, 1)
    row, col = np.nonzero(taken > (-np.inf if least is None else least))
    return pa.table({"key": pa.array(keys[row], pa.int64()), "other": pa.array(others[order[row, col]], pa.int64()), "score": pa.array(taken[row, col], pa.float64())})


_NONE = pa.table({"key": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def _vector_scores(dim: int, k: int):
    def scores(key: tuple, asks: pa.Table, rows: pa.Table) -> pa.Table:
        if not asks.num_rows or not rows.num_rows:
            return _NONE
        score = np.round(matrix(asks.column("v"), dim) @ matrix(rows.column("v"), dim).T, 6)
        return _best(asks.column("key").to_numpy(), rows.column("key").to_numpy(), score, k, 0.0)

    return scores


def _code_scores(model: Model, short: int):
    def scores(key: tuple, asks: pa.Table, rows: pa.Table) -> pa.Table:
        if not asks.num_rows or not rows.num_rows:
            return _NONE
        asked = matrix(asks.column("v"), model.dim)
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        score = np.repeat((asked @ model.centres[key[0].as_py() if hasattr(key[0], "as_py") else key[0]])[:, None], rows.num_rows, 1)
        for i, table in enumerate(model.tables(asked)):
            score += table[:, codes[:, i]]
        return _best(asks.column("key").to_numpy(), rows.column("key").to_numpy(), score, short, None)

    return scores


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            dim = len(batch.column("_v")[0])
            score = np.round((matrix(batch.column("_v"), dim) * matrix(batch.column("_w"), dim)).sum(1), 6)
            out = pa.RecordBatch.from_pydict({"key": batch.column("key"), "other": batch.column("other"), "score": pa.array(score, pa.float64())})
            yield out.filter(pa.array(score > 0))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: asked vectors that have neighbours, and the share of their exact neighbours that were found."""
    hits = exact.select("key", "other").join(found.select("key", "other", F.lit(1).alias("hit")), ["key", "other"], "left")
    each = hits.groupBy("key").agg((F.count("hit") / F.count("*")).alias("share"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("share"), 4).alias("recall"))
