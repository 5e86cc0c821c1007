"""Interval labels of hierarchies: what is below a node is a range of numbers.

Each node keeps one parent, its least; numbers are in the order of a walk that goes
through a node's children one after the other, so the nodes below one with number
``pre`` and ``size`` nodes have the numbers ``pre`` to ``pre + size - 1``.  Parents are followed by
doubling their reach, sizes are summed from the deepest level up, and a child's place
among its siblings is a running sum inside buckets of the siblings and over the
buckets, so a node with very many children isn't one task's.  Edges that the tree has no
room for (further parents, and one edge of each cycle) are kept beside the labels: a
search goes on from their ends until nothing comes nearer, so it gives what ``closure`` gives;
in a forest it is one range join.

Nulls and edges of a node to itself are left out; repeated edges are one; an empty table has no labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import saved

#: Buckets of a node's children, and bins of numbers in a range join at least.
SIBLINGS, BINS = 1024, 4096


@dataclass
class Labels:
    """nodes: node, parent, level, pre, size; extra: src, dst of the edges beside the tree."""

    nodes: DataFrame
    extra: DataFrame
    count: int

    def write(self, folder: str) -> None:
        self.nodes.write.parquet(f"{folder}/nodes")
        self.extra.write.parquet(f"{folder}/extra")

    @classmethod
    def read(cls, spark, folder: str) -> Labels:
        nodes = spark.read.parquet(f"{folder}/nodes")
        return cls(nodes, spark.read.parquet(f"{folder}/extra"), nodes.count())


def _followed(parents: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(node, sum) of ``value`` over each node and what is above it; and (node, up, least) of nodes that no root is above.

    parents: node, parent (null: none), value.  Each round doubles how far a node has looked.
    """
    n = parents.count()
    done = parents.where("parent IS NULL").select("node", F.col(value).alias("sum"))
    open_ = parents.where("parent IS NOT NULL").select("node", F.col("parent").alias("up"), F.col(value).alias("sum"), F.least("node", "parent").alias("least"))
    state, reach = saved(open_), 1
    ends = [done]
    while reach <= 2 * n and not state.isEmpty():
        known = saved(ends[0] if len(ends) == 1 else ends[0].unionAll(ends[1]))
        arrived = saved(state.join(known.select(F.col("node").alias("up"), F.col("sum").alias("_s")), "up").select("node", (F.col("sum") + F.col("_s")).alias("sum")))
        left = state.join(arrived.select("node"), "node", "left_anti")
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("sum").alias("_s"), F.col("least").alias("_l"))
        state = saved(left.join(above, "up").select("node", F.col("_up").alias("up"), (F.col("sum") + F.col("_s")).alias("sum"), F.least("least", "_l").alias("least")))
        ends, reach = [known, arrived], reach * 2
    return (ends[0] if len(ends) == 1 else ends[0].unionAll(ends[1])), state.select("node", "up", "least")


def labels(edges: DataFrame, nodes: DataFrame | None = None) -> Labels:
    """Labels of all nodes of an edge table (src, dst), and of ``nodes`` (node) that have no edge."""
    e = saved(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    names = e.select(F.col("src").alias("node")).union(e.select("dst"))
    names = (names if nodes is None else names.union(nodes.select("node").where("node IS NOT NULL"))).distinct()
    up = e.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
    tree = saved(names.join(up, "node", "left").withColumn("one", F.lit(1).cast("long")))
    level, circles = _followed(tree, "one")
    if not circles.isEmpty():  # what a node looks at after more steps than there are nodes is on a circle: its least node becomes a root
        on = circles.select(F.col("up").alias("node")).distinct().join(circles.select("node", "least"), "node").where("node = least").select("node")
        tree = saved(tree.join(on.withColumn("_cut", F.lit(True)), "node", "left").select("node", F.when(F.col("_cut").isNull(), F.col("parent")).alias("parent"), "one"))
        level, _ = _followed(tree, "one")
    levelled = saved(tree.select("node", "parent").join(level.select("node", (F.col("sum") - 1).alias("level")), "node"))
    deepest = levelled.agg(F.max("level")).first()[0] or 0
    below, sizes = None, []
    for k in range(deepest, -1, -1):
        own = levelled.where(F.col("level") == k).select("node", "parent")
        size = own.withColumn("size", F.lit(1).cast("long")) if below is None else own.join(below, "node", "left").select("node", "parent", (1 + F.coalesce("_size", F.lit(0))).cast("long").alias("size"))
        sizes.append(saved(size))
        below = sizes[-1].where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("_size"))
    sized = sizes[0]
    for x in sizes[1:]:
        sized = sized.unionAll(x)
    sized = saved(sized.withColumn("_bucket", F.pmod(F.xxhash64("node"), F.lit(SIBLINGS))))
    each = sized.groupBy("parent", "_bucket").agg(F.sum("size").alias("s"))
    before = each.withColumn("_before", F.sum("s").over(Window.partitionBy("parent").orderBy("_bucket")) - F.col("s")).drop("s")
    inside = Window.partitionBy("parent", "_bucket").orderBy("node")
    placed = sized.withColumn("_inside", F.sum("size").over(inside) - F.col("size")).join(before.withColumnRenamed("parent", "_p").withColumnRenamed("_bucket", "_b"), F.col("parent").eqNullSafe(F.col("_p")) & (F.col("_bucket") == F.col("_b")))
    # a node's number is one more than its parent's, and what its earlier siblings take up
    steps = saved(placed.select("node", "parent", (F.col("_before") + F.col("_inside") + F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("step")))
    pre, _ = _followed(steps, "step")
    out = saved(levelled.join(pre.select("node", F.col("sum").alias("pre")), "node").join(sized.select("node", "size"), "node").select("node", "parent", F.col("level").cast("int").alias("level"), "pre", "size"))
    extra = saved(e.join(tree.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("node").alias("dst")), ["src", "dst"], "left_anti"))
    return Labels(out, extra, out.count())


def _ranges(points: DataFrame, ranges: DataFrame, bins: int, count: int) -> DataFrame:
    """points (pre, ...) joined with the ranges (low, high, ...) that hold them: by bins of numbers, so that no point meets all ranges."""
    width = max(1, -(-count // bins))
    spread = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    return points.withColumn("_bin", F.floor(F.col("pre") / width)).join(spread, "_bin").where("pre >= low AND pre <= high").drop("_bin")


def _searched(tree: Labels, seeds: DataFrame, depth: int, up: bool) -> DataFrame:
    """node, level of what is below (or above) seeds by the tree and the edges beside it, in ``depth`` steps at most."""
    nodes = tree.nodes.select("node", "level", "pre", "size")
    a, b = ("dst", "src") if up else ("src", "dst")
    given = seeds.select("node").where("node IS NOT NULL").distinct().withColumn("at", F.lit(0))
    given = saved(given)
    found = given.select("node", F.col("at").alias("steps"))  # a seed without an edge is there, too
    beside = None if tree.extra.isEmpty() else tree.extra
    front = given
    while True:
        own = saved(front.join(nodes, "node"))
        bins = max(BINS, own.count())
        if up:
            met = _ranges(own.select("pre", "at", F.col("level").alias("_from")), nodes.select("node", "level", F.col("pre").alias("low"), (F.col("pre") + F.col("size") - 1).alias("high")), bins, tree.count)
            reached = met.select("node", (F.col("at") + F.col("_from") - F.col("level")).alias("steps"))
        else:
            met = _ranges(nodes.select("node", "level", "pre"), own.select("at", F.col("level").alias("_from"), F.col("pre").alias("low"), (F.col("pre") + F.col("size") - 1).alias("high")), bins, tree.count)
            reached = met.select("node", (F.col("at") + F.col("level") - F.col("_from")).alias("steps"))
        reached = reached.where(F.col("steps") <= depth).groupBy("node").agg(F.min("steps").alias("steps"))
        if beside is None:
            return found.unionAll(reached).groupBy("node").agg(F.min("steps").cast("int").alias("level"))
        better = saved(reached.join(found.select("node", F.col("steps").alias("_old")), "node", "left").where("_old IS NULL OR steps < _old OR steps = 0").select("node", "steps"))
        found = saved(found.unionAll(better).groupBy("node").agg(F.min("steps").alias("steps")))
        ends = better.join(beside.select(F.col(a).alias("node"), F.col(b).alias("_to")), "node").select(F.col("_to").alias("node"), (F.col("steps") + 1).alias("at")).where(F.col("at") <= depth)
        ends = ends.groupBy("node").agg(F.min("at").alias("at")).join(found, "node", "left").where("steps IS NULL OR at < steps").select("node", "at")
        front = saved(ends)
        if front.isEmpty():
            return found.select("node", F.col("steps").cast("int").alias("level"))


def below(tree: Labels, seeds: DataFrame, depth: int = 10) -> DataFrame:
    """node, level: what is reached from seeds (node) in ``depth`` steps at most, seeds included, each at its least level."""
    return _searched(tree, seeds, depth, False)


def above(tree: Labels, seeds: DataFrame, depth: int = 10) -> DataFrame:
    """The same against the edges."""
    return _searched(tree, seeds, depth, True)
