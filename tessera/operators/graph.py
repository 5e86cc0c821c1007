"""Hierarchies as edge tables: closures, trees, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved


def closure(seeds: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    """node, level: what is reached from seeds (node) in at most ``depth`` steps, seeds included, each at its least level.

    Level by level; nodes seen before go no further, so cycles end.  Each level is
    written once and read by the later ones, so a level's plan is two joins over
    files however deep it is.  A null node has no edges.
    """
    step = saved(edges.select(F.col("src").alias("node"), F.col("dst")).distinct())
    front = saved(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    seen = front
    for level in range(1, depth + 1):
        reached = front.join(step, "node").select(F.col("dst").alias("node")).distinct()
        front = saved(reached.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def paths(top: DataFrame, edges: DataFrame, depth: int = 10, join: str = " / ") -> DataFrame:
    """node_id, level, path: every way down from the nodes of top in at most ``depth`` steps; a node of several parents has a row for each way.

    A job for each level, written once and read by the next; a cycle is walked until depth ends it.
    """
    step = saved(edges.select(F.col("src").alias("node_id"), "dst"))
    front = saved(top.select("node_id", F.lit(0).alias("level"), F.col("node_id").alias("path")))
    out = front
    for level in range(1, depth + 1):
        down = front.join(step, "node_id").select(F.col("dst").alias("node_id"), F.lit(level).alias("level"), F.concat("path", F.lit(join), "dst").alias("path"))
        front = saved(down)
        if front.isEmpty():
            break
        out = out.unionAll(front)
    return out


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def with_has_children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    parents = edges.select(F.col("src").alias("node_id")).distinct().withColumn("_p", F.lit(True))
    return nodes.join(parents, "node_id", "left").withColumn("has_children", F.col("_p").isNotNull()).drop("_p")


def children(nodes: DataFrame, edges: DataFrame, of: Column) -> DataFrame:
    """The children of a node with has_children."""
    below = edges.where(F.col("src") == of).select(F.col("src").alias("parent_id"), F.col("dst").alias("node_id"))
    return with_has_children(below.join(nodes, "node_id"), edges)


def scoped(owns: DataFrame, related: DataFrame, scope: str) -> DataFrame:
    """(id, node_id) edges that are owned, related or both, each once."""
    if scope == "owns":
        return owns.distinct()
    return related.distinct() if scope == "related" else owns.union(related).distinct()


def facet(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """ids with an edge to one of nodes (node)."""
    return edges.join(nodes.select(F.col("node").alias("node_id")), "node_id", "left_semi").select("id").distinct()


def all_of(*facets: DataFrame) -> DataFrame:
    out = facets[0]
    for f in facets[1:]:
        out = out.join(f, "id", "left_semi")
    return out


def any_of(*facets: DataFrame) -> DataFrame:
    out = facets[0]
    for f in facets[1:]:
        out = out.union(f)
    return out.distinct()


def criteria_all_no(rows: DataFrame, criteria: DataFrame, parent: DataFrame, own: list[str], above: list[str]) -> DataFrame:
    """Rows none of whose asked criteria is yes (trimmed, any case; missing passes); second-level rows read ``above`` from their parent."""
    yes = lambda c: F.coalesce(F.lower(F.trim(c)) == "yes", F.lit(False))
    up = parent.groupBy(F.col("child_id").alias("id")).agg(F.min("parent_id").alias("_parent"))
    joined = rows.join(criteria.select("id", *own, *above), "id", "left").join(up, "id", "left").join(criteria.select(F.col("id").alias("_parent"), *(F.col(c).alias(f"_p_{c}") for c in above)), "_parent", "left")
    bad = F.lit(False)
    for c in own:
        bad = bad | yes(F.col(c))
    for c in above:
        bad = bad | yes(F.when(F.col("level") == "Level 2", F.col(f"_p_{c}")).otherwise(F.col(c)))
    return joined.where(~bad).select(*rows.columns)
