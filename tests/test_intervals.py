"""Interval labels against closures, on forests and on graphs with ties, several parents and cycles."""

from __future__ import annotations

import random

import pytest

from tessera.operators import graph, intervals


def walked(edges: list[tuple], seeds: list[str], depth: int) -> dict[str, int]:
    out, front = dict.fromkeys(seeds, 0), set(seeds)
    for level in range(1, depth + 1):
        front = {b for a, b in edges if a in front and a is not None and b is not None} - set(out)
        out |= dict.fromkeys(front, level)
    return out


def forest(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(f"n{rng.randrange(i // 3, i) if i % 5 else 0}", f"n{i}") for i in range(1, n) if i % 23]


def tangled(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    more = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(8)]
    ring = [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c3", "leaf"), ("n2", "c2"), ("d1", "d2"), ("d2", "d1"), ("s", "s"), (None, "x"), ("y", None)]
    return forest(60, seed) + more + ring + ring[:2]


CASES = [("forest", forest(150, 1)), ("chain", [(f"n{i}", f"n{i + 1}") for i in range(20)]), ("tangled", tangled(2))]


@pytest.mark.parametrize("name, edges", CASES, ids=[c[0] for c in CASES])
def test_labels_and_searches(spark, name, edges):
    df = spark.createDataFrame(edges, "src string, dst string")
    tree = intervals.labels(df)
    rows = {r.node: r for r in tree.nodes.collect()}
    names = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert set(rows) == names and sorted(r.pre for r in rows.values()) == list(range(len(names)))
    for r in rows.values():  # a child's range is inside its parent's
        if r.parent is not None:
            p = rows[r.parent]
            assert p.pre < r.pre and r.pre + r.size <= p.pre + p.size and r.level == p.level + 1
    assert tree.extra.isEmpty() == (not name.startswith("tangled"))
    seeds = ["n0", "n2", "n7", "c1", "nobody"]
    s = spark.createDataFrame([(x,) for x in [*seeds, None]], "node string")
    back = [(b, a) for a, b in edges]
    assert {r.node: r.level for r in intervals.below(tree, s, 10).collect()} == walked(edges, seeds, 10)
    assert {r.node: r.level for r in intervals.below(tree, s, 2).collect()} == walked(edges, seeds, 2)
    assert {r.node: r.level for r in intervals.above(tree, s, 10).collect()} == walked(back, seeds, 10)


def test_equal_to_closure_and_kept(spark, tmp_path):
    df = spark.createDataFrame(tangled(5), "src string, dst string")
    s = spark.createDataFrame([("n0",), ("d2",)], "node string")
    intervals.labels(df).write(f"file://{tmp_path}/l")
    tree = intervals.Labels.read(spark, f"file://{tmp_path}/l")
    want = sorted((r.node, r.level) for r in graph.closure(s, df).collect())
    assert sorted((r.node, r.level) for r in intervals.below(tree, s).collect()) == want


def test_empty(spark):
    tree = intervals.labels(spark.createDataFrame([(None, "a"), ("b", "b")], "src string, dst string"))
    s = spark.createDataFrame([("q",)], "node string")
    assert tree.nodes.count() == 0 and [tuple(r) for r in intervals.below(tree, s).collect()] == [("q", 0)]
