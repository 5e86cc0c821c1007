"""Results that are whole on tables larger than a limit, or with keys that repeat."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tessera.operators import search, temporal
from tessera.plans import registry

from .compare import as_text, oracle_rows


def test_id_sequence_past_its_width(spark):
    sf = "/root/testdata/sf0.1"
    assert as_text(registry.QUERIES["id_sequence"](spark, sf).toPandas()) == as_text(oracle_rows(registry.ORACLES["id_sequence"], sf))


def test_lists_without_a_limit_are_ranked_whole(spark):
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("thth"), (F.col("id") % 3 + 1).cast("int")), F.lit("erer")).alias("text"))
    found = search.keyword(search.inverted_index(docs, "doc_id", ["text"]), "doc_id", "thth erer", None)
    want = sorted(range(2500), key=lambda i: (-(i % 3), i))
    assert [(r.doc_id, r["rank"]) for r in found.orderBy("rank").collect()] == [(d, i) for i, d in enumerate(want, 1)]
    last = spark.createDataFrame([(want[-1], 1)], "doc_id long, rank int")
    fused = {r.doc_id: r for r in search.fuse([found, last], "doc_id", None).collect()}
    assert len(fused) == 2500 and fused[want[-1]].score == round(1 / 61 + 1 / 2560, 8) and fused[want[-1]]["rank"] == 1


def test_a_key_that_a_dump_repeats(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    old = spark.createDataFrame([(1, "a", day(1), day(2)), (1, "b", day(2), None), (2, "a", day(1), day(3))], "id long, x string, tx_from timestamp_ntz, tx_to timestamp_ntz")
    dump = spark.createDataFrame([(1, "b"), (1, "c"), (2, "a"), (2, "a")], "id long, x string")
    got = temporal.merge(old, dump, "id", ["x"], F.lit("2024-01-09").cast("timestamp_ntz"), repeats=True)
    want = [(1, "a", day(1), day(2))] * 2 + [(1, "b", day(2), None), (1, "b", day(2), day(9)), (1, "c", day(9), None)] + [(2, "a", day(1), day(3))] * 2 + [(2, "a", day(9), None)] * 2
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_streamed_neighbours_and_pair_values(spark):
    import numpy as np

    from tessera.operators import similarity

    g = np.random.default_rng(3)
    m = g.normal(size=(700, 6)).round(1)
    m[300:330] = m[5]  # ties by key
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = np.round(u @ u.T, 6)
    want = {(i, j): s for i in range(700) for j, s in sorted(((j, score[i, j]) for j in range(700) if j != i and score[i, j] > 0), key=lambda x: (-x[1], x[0]))[:4]}
    near = similarity.nearest(v, "id", "v", 4, block=90)
    got = {(r.key, r.other): r.score for r in near.collect()}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    assert "Window" not in near._jdf.queryExecution().toString()  # no list of a pair of blocks leaves its task
    each = similarity.pair_values(near.select("key", "other"), v, "id", "v", [(1, 3), (1, 6)], block=100).collect()
    assert len(each) == len(want) and all(abs(r.c[1] - got[r.key, r.other]) < 2e-6 for r in each)


def test_forest_of_a_long_chain(spark):
    import time

    from tessera.operators import similarity

    n = 300  # scores that rise along it point all nodes to its end
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.col("id").cast("double").alias("score"))
    extra = spark.range(0, n - 2, 7).select(F.col("id").alias("a"), (F.col("id") + 2).alias("b"), F.lit(-1.0).alias("score"))
    began = time.time()
    got = similarity.spanning_forest(edges.unionAll(extra))
    assert {(r.a, r.b) for r in got.collect()} == {(i, i + 1) for i in range(n)}
    assert time.time() - began < 120


def test_views_have_one_plan_and_the_rows_of_their_sql(spark):
    import re

    from tessera.sources import adapters

    sf = "/root/testdata/sf0.001"
    for name in adapters.PLANS:
        got = adapters.spark_view(spark, sf, name)
        want = spark.sql(adapters.VIEWS[name], **{x: adapters.spark_view(spark, sf, x) for x in set(re.findall(r"\{(\w+)\}", adapters.VIEWS[name]))})
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    for name in ("version_diff_parents", "export_at_time"):  # a union of joins loses its partitions while a query runs
        assert "Union" not in registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_criteria_and_units_join_and_copy_no_raw_rows(spark):
    sf = "/root/testdata/sf0.001"
    plan = lambda name: registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    for name in ("cascade_suggest", "cascade_all"):
        join = plan(name).split("Join Inner", 1)[1]
        assert join.count("Aggregate") >= 2  # both sides' different values
    for name in ("criterion_pass_rates", "snapshot_whole"):
        assert "Expand" not in plan(name)


def test_pairs_of_texts_meet_by_blocks(spark):
    import random

    from tessera.operators import similarity

    rng = random.Random(5)
    docs = spark.createDataFrame([(i * 37, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(12)))) for i in range(300)], "id long, text string")
    keys = [rng.randrange(305) * 37 for _ in range(1600)]
    pairs = spark.createDataFrame(sorted(set(zip(keys[::2], keys[1::2]))), "a long, b long")
    own: dict = {}
    for r in similarity.term_weights(docs, "id", "text", 30).collect():
        own.setdefault(r.id, {})[r.term] = r.weight
    near = similarity.pair_cosine(similarity.term_vectors(docs, "id", "text", 30), pairs, "id", "a", "b", block=40)
    got = {(r.a, r.b): r.cosine for r in near.collect()}
    want = {(r.a, r.b): sum(w * own.get(r.b, {}).get(term, 0.0) for term, w in own.get(r.a, {}).items()) for r in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want) and max(want.values()) > 0.5
    assert "term" not in near._jdf.queryExecution().optimizedPlan().toString().replace("terms", "")  # no pair is joined with its terms


def test_vectors_of_terms_travel_packed_and_only_where_asked(spark):
    import random

    from tessera.operators import similarity

    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(400)}" for _ in range(150))) for i in range(60)] + [(90, "zz zz"), (91, None)], "id long, text string")
    asked = spark.createDataFrame([(i,) for i in (*range(10), 10, 10, 90, 91, 95)], "id long")
    vectors = similarity.term_vectors(docs, "id", "text", 300, only=asked)
    rows = {r.id: r for r in vectors.rows.collect()}
    assert set(range(11)) <= set(rows) <= {*range(11), 90}  # a text without a frequent term has none
    own: dict = {}
    for r in similarity.term_weights(docs, "id", "text", 300).collect():  # the vocabulary is that of all texts
        own.setdefault(r.id, {})[r.term] = r.weight
    assert sum(len(rows[i].packed) for i in range(11)) < 5 * sum(len(own[i]) for i in range(11))  # a number and a weight take 12 bytes
    pairs = spark.createDataFrame([(a, b, [float(a), 0.5], f"{b}") for a in (0, 3, 10, 90, 91) for b in (1, 3, 10, 91, 95)], "a long, b long, c array<double>, d string")
    got = similarity.pair_cosine(vectors, pairs, "id", "a", "b").collect()
    assert sorted((r.a, r.b, r.c, r.d) for r in got) == sorted(map(tuple, pairs.collect()))  # other columns stay
    for r in got:
        assert abs(r.cosine - sum(w * own.get(r.b, {}).get(term, 0.0) for term, w in own.get(r.a, {}).items())) < 1e-12


def test_words_are_counted_in_parts_of_so_many_texts(spark, monkeypatch):
    from tessera.operators import similarity

    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 3} x{i}") for i in range(60)] + [(60, None)], "id long, text string")
    monkeypatch.setattr(similarity, "COUNTED", 10)  # else Spark fills a task by the bytes of its texts, and words take many times that
    counted = similarity._counted(docs, 61, "id", "text", False, spark.createDataFrame([(3,), (3,), (60,)], "id long"))
    assert 3 < len(counted.inputFiles()) <= 7
    got = {r.id: (r.asked, sorted(map(tuple, r.terms))) for r in counted.collect()}
    assert got == {i: (i == 3, [(f"w{i % 3}", 2), (f"x{i}", 1)]) for i in range(60)}


def test_postings_are_made_where_their_block_is(spark):
    from tessera.operators.text_index import TextIndex

    made = TextIndex.__new__(TextIndex)
    made.fields = ["text"]
    rows = spark.createDataFrame([(1, "one two two"), (2, "two"), (5000, "two one")], "id long, text string")
    got = made._inverted(rows, "id")
    assert sorted(map(tuple, got.collect())) == [(0, 1, "text", "one", 1), (0, 1, "text", "two", 2), (0, 2, "text", "two", 1), (4, 5000, "text", "one", 1), (4, 5000, "text", "two", 1)]
    plan = got.groupBy("block", "term", "field").agg(F.collect_list("key"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_a_snapshot_makes_criteria_once(spark):
    plan = registry.QUERIES["snapshot_whole"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "c_what" in plan  # distinct suppliers of an order are counted before, for all parts


def test_a_snapshot_gathers_no_table_on_the_driver(spark):
    for name in ("snapshot_whole", "top_themes"):  # their files are small, so Spark would send them to all tasks by way of the driver
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_asked_vectors_leave_for_their_lists_in_bounded_batches():
    import numpy as np
    import pyarrow as pa

    from tessera.operators import vector_index as V

    g = np.random.default_rng(1)
    model = V.Model(8, V.directions(g.normal(size=(100, 8))), [], np.zeros((100, 7)))
    asked = pa.RecordBatch.from_pydict({"key": pa.array(np.arange(1000)), "v": pa.array(list(g.normal(size=(1000, 8))), pa.list_(pa.float64()))})
    sent = list(V._probes(model, 60)(iter([asked])))
    assert max(b.num_rows for b in sent) <= V.SENT and sum(b.num_rows for b in sent) == 60_000
    assert [k for b in sent for k in b.column("key").to_pylist()] == np.repeat(np.arange(1000), 60).tolist()
