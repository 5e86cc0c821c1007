"""Connected components of an edge table: alternating large and small stars.

Each round joins a node's neighbours to the smallest of them; the table never has
more edges than it began with, and rounds grow with the logarithm of the longest path.
Before, each partition's own edges are folded into stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a batch as stars around the smallest node of each of its components."""
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = list(range(len(nodes)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(index[: len(a)].tolist(), index[len(a) :].tolist()):
            x, y = top(x), top(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        tops = np.array([top(x) for x in range(len(nodes))], np.int64)
        other = tops != np.arange(len(nodes))
        yield pa.RecordBatch.from_pydict({"a": pa.array(nodes[other], pa.int64()), "b": pa.array(nodes[tops[other]], pa.int64())})


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """a > b in all edges."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes but the smallest of each component; edges: (a, b)."""
    edges = edges.where(F.col("a") != F.col("b")).mapInArrow(_stars, "a long, b long").distinct()
    state = saved(edges)
    before = None
    while True:
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == now:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
        state = saved(_small_star(_large_star(state)))
