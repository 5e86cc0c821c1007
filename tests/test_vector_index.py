"""The kept vector index and the exact search by angle bounds, against comparing all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import similarity as M
from tessera.operators import vector_index as V

SCHEMA = "id long, v array<double>"


def clustered(n: int, groups: int, spread: float, dim: int = 12, seed: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, dim))
    return [(i, (c[i % groups] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


ODD = [(9001, None), (9002, []), (9003, [0.0] * 12), (9004, [1.0] * 5), (9005, [float("nan")] * 12), (9006, [1.0] * 11 + [None]), (None, [1.0] * 12)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = clustered(600, 12, 0.1) + [(7000 + i, clustered(1, 1, 0, seed=4)[0][1]) for i in range(150)]
    df = spark.createDataFrame(rows + ODD, SCHEMA).repartition(3)
    return df, V.build(df, "id", "v", f"file://{tmp_path_factory.mktemp('index')}/i", lists=12)


def shown(df):
    return sorted((r.key, r.other, r.score, r.rank) for r in df.collect())


def plain(rows: list[tuple], k: int) -> list[tuple]:
    m = V.directions(np.array([v for _, v in rows]))
    ids, score, out = [i for i, _ in rows], np.round(m @ m.T, 6), []
    for a, i in enumerate(ids):
        best = sorted((-score[a, b], j) for b, j in enumerate(ids) if b != a and score[a, b] > 0)[:k]
        out += [(i, j, -s, r + 1) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_pruned_search_is_exact_and_compares_less(spark, made, monkeypatch):
    df, index = made
    monkeypatch.setattr(V, "ASKED", 64)
    rows = [(r.id, r.v) for r in df.where("id < 9000").collect()]
    got, count = index.pruned_nearest(df, "id", "v", 5)
    assert shown(got) == plain(rows, 5)
    count = count.first()
    assert count.pairs == 750**2 and count.compared < count.pairs / 3


def test_no_clusters_is_exact_too(spark, tmp_path):
    rows = clustered(300, 300, 1.0, dim=4)
    df = spark.createDataFrame(rows, SCHEMA)
    index = V.build(df, "id", "v", f"file://{tmp_path}/i", lists=9)
    got, count = index.pruned_nearest(df, "id", "v", 7)
    assert shown(got) == plain(rows, 7) and count.first().compared <= 300**2


def test_search_of_some_lists(spark, made):
    df, index = made
    asked = df.where("id % 50 = 0")
    found = index.search(asked, "id", "v", 10)
    exact = M.nearest(df.where("id < 9000"), "id", "v", 10, asked=df.where("id % 50 = 0 AND id < 9000").select("id"))
    assert V.recall(found, exact).first().recall >= 0.9
    assert shown(index.search(asked, "id", "v", 10, probe=99, short=1000)) == shown(exact)


def test_a_search_reads_its_lists_alone(spark, made):
    df, index = made
    files = lambda x: {r[0].split("/list=")[1].split("/")[0] for r in x.select(F.input_file_name()).distinct().collect()}
    assert len(files(index.table("codes"))) == 12 and files(index.table("vectors", [2, 5])) == {"2", "5"}
    plan = index.table("codes", [3])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"list#\d+ = 3\)", plan) and "v" not in index.table("codes").columns
    again = V.VectorIndex(spark, index.folder)
    assert (again.model.centres == index.model.centres).all() and again.model.probe == index.model.probe < 12


def test_hot_ring_is_cut_into_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "CELL", 20)
    rows = [(i, [1.0, 0.0, 2.0]) for i in range(90)] + [(100 + i, [0.0, 1.0, i / 10]) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = V.build(df, "id", "v", f"file://{tmp_path}/i", lists=2)
    assert index.rings().agg(F.max("cells")).first()[0] >= 4
    got, _ = index.pruned_nearest(df, "id", "v", 3)
    assert shown(got) == plain(rows, 3)


def test_empty_and_odd_tables(spark, tmp_path):
    index = V.build(spark.createDataFrame(ODD[:3], SCHEMA), "id", "v", f"file://{tmp_path}/i")
    asked = spark.createDataFrame(clustered(3, 1, 0.1), SCHEMA)
    assert index.search(asked, "id", "v", 3).count() == 0 and index.pruned_nearest(asked, "id", "v", 3)[0].count() == 0
    one = V.build(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA), "id", "v", f"file://{tmp_path}/one")
    assert [(r.key, r.other) for r in one.search(spark.createDataFrame([(2, [1.0, 2.0]), (3, None), (4, [1.0])], SCHEMA), "id", "v", 3).collect()] == [(2, 1)]
