"""Small fixtures: boundaries, nulls, cycles, merges, readers."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import dashboard, graph, ingest, search, similarity, temporal
from tessera.sources import generators, readers, shards, stores


def test_closure_ends_on_cycles_and_at_its_depth(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert graph.closure(seed, ring).count() == 3
    line = spark.createDataFrame([(str(i), str(i + 1)) for i in range(13)], "src string, dst string")
    seen = graph.closure(spark.createDataFrame([("0",)], "node string"), line)
    assert sorted((r.level, r.node) for r in seen.collect()) == [(i, str(i)) for i in range(11)]
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0  # each level reads what the one before wrote


def test_as_of_boundaries(spark):
    v = spark.sql("SELECT 1 AS id, timestamp_ntz '2024-01-01' AS tx_from, timestamp_ntz '2024-02-01' AS tx_to")
    at = lambda t: temporal.as_of(v, F.lit(t).cast("timestamp_ntz")).count()
    assert (at("2024-01-01"), at("2024-01-31"), at("2024-02-01")) == (1, 1, 0)


def test_merge_is_idempotent_and_null_safe(spark):
    now = F.lit("2024-03-01").cast("timestamp_ntz")
    old = spark.sql("SELECT id, x, timestamp_ntz '2024-01-01' AS tx_from, CAST(NULL AS timestamp_ntz) AS tx_to FROM VALUES (1, 'a'), (2, NULL), (3, 'c') t(id, x)")
    dump = spark.createDataFrame([(1, "b"), (2, None), (4, "d")], "id int, x string")
    new = temporal.merge(old, dump, "id", ["x"], now)
    rows = {(r.id, r.x, r.tx_to is None) for r in new.collect()}
    assert rows == {(1, "a", False), (1, "b", True), (2, None, True), (3, "c", True), (4, "d", True)}
    again = temporal.merge(new, dump, "id", ["x"], now)
    assert sorted(map(str, again.collect())) == sorted(map(str, new.collect()))
    assert temporal.invariants(new, "id").count() == 0


def test_criteria_filter_and_scores_on_padded_and_missing_values(spark):
    rows = spark.createDataFrame([(i, "Level 1") for i in range(4)], "id int, level string")
    criteria = spark.createDataFrame([(0, None, None), (1, "", None), (2, " YES ", None), (3, "no", None)], "id int, c string, p string")
    parent = spark.createDataFrame([], "parent_id int, child_id int")
    assert {r.id for r in graph.criteria_all_no(rows, criteria, parent, ["c"], []).collect()} == {0, 1, 3}
    assert criteria.select(F.sum(dashboard.score(["c"])).alias("s")).first().s == 0


def test_time_zoo(spark):
    raw = ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05.999", "2024-01-02", "02-Jan-2024 03:04:05 PM", "junk", " ", None]
    got = [r.t for r in spark.createDataFrame([(x,) for x in raw], "x string").select(F.date_format(X.coerce_time(F.col("x")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 00:00:00", "2024-01-02 15:04:05", None, None, None]


def test_uneven_lists_and_name_sets(spark):
    one = spark.range(1)
    assert one.select(F.size(X.zipped(F.lit("a, b,c"), F.lit("1,2")))).first()[0] == 2
    assert one.select(X.name_set(F.array(F.lit(" b"), F.lit("a"), F.lit("a"), F.lit("")))).first()[0] == ["a", "b"]


def test_uuid5(spark):
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    texts = ["CTRL-0000000001", "é", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(X.uuid5(F.col("x"), space)).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(space), x)) for x in texts]


def test_pair_score_means_over_all_features(spark):
    row = spark.range(1).select(similarity.pair_score([(F.lit(1.0), F.lit(None).cast("double")), (F.lit(-1.0), F.lit(2.0)), (F.lit(None).cast("double"), F.lit(None).cast("double"))]).alias("s"))
    assert row.first().s == pytest.approx(1 / 3, abs=1e-4)


def test_fusion_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    assert search.fuse([a, b], "id").collect() == search.fuse([b, a], "id").collect()
    assert search.fuse([a, b], "id").first().id == 2


def test_query_mode():
    assert (search.mode("ctrl-12"), search.mode("CTL_3"), search.mode("fraud")) == ("id", "id", "hybrid")


def test_spanning_forest(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.7), (4, 5, 0.5)], "a long, b long, score double")
    assert {(r.a, r.b) for r in similarity.spanning_forest(edges).collect()} == {(1, 2), (2, 3), (4, 5)}


def test_nearest_in_blocks_equals_one_block(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = lambda block: sorted((r.key, r.other, r.score) for r in similarity.nearest(v, "vec_id", "embedding", 5, block=block).collect())
    assert rows(7) == rows(100000)


def test_readers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "v": "a"}\n\nnot json\n{"id": 1, "v": "b"}\n')
    good, bad = readers.read_jsonl_lenient(spark, f"{tmp_path}/x.jsonl", "id int, v string")
    assert good.count() == 2 and bad.count() == 1
    assert [tuple(r) for r in readers.duplicates(good, "id").collect()] == [(1, 2)]
    (tmp_path / "w.csv").write_text("".join(f"preamble {i}\n" for i in range(10)) + ",h1,h2\n,a,1\n,b,2\n")
    assert {tuple(r) for r in readers.read_wide_csv(spark, f"{tmp_path}/w.csv", "h1 string, h2 int").collect()} == {("a", 1), ("b", 2)}
    one = readers.write_version(good, f"{tmp_path}/store")
    two = readers.write_version(good.limit(1), f"{tmp_path}/store")
    assert readers.read_version(spark, f"{tmp_path}/store").count() == 1
    assert readers.read_version(spark, f"{tmp_path}/store", one).count() == 2
    assert [r.name for r in readers.list_versions(spark, f"{tmp_path}/store").collect()] == [one, two]
    dated = spark.createDataFrame([("2024-01-01", 1), ("2024-02-01", 2), ("latest", 3)], "date string, x int")
    assert [r.x for r in readers.latest_partition(dated).collect()] == [2]
    readers.write_csv_tables({"t": good}, f"{tmp_path}/csv")
    readers.write_jsonl(good, f"{tmp_path}/out.jsonl")
    assert readers.read_jsonl(spark, f"{tmp_path}/out.jsonl", "id int, v string").count() == 2


def test_violations_and_unlinked(spark):
    rows = spark.createDataFrame([("CTRL-0000000001", 1), ("bad", None)], "id string, x int")
    rules = {"id": F.col("id").rlike(r"^CTRL-\d{10}$"), "x": F.col("x") > 0}
    assert {tuple(r) for r in ingest.violations(rows, "id", rules).collect()} == {("bad", "id"), ("bad", "x")}


def test_versions_stream(spark, tmp_path):
    from tessera.streaming import versions

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"id": 1, "x": "a", "at": "2024-01-01 00:00:00"}\n{"id": 2, "x": "b", "at": "2024-01-01 00:00:00"}\n')
    folder = f"{tmp_path}/store"
    versions.ingest(spark, f"{tmp_path}/in", "id int, x string, at timestamp_ntz", folder, f"{tmp_path}/cp", "id", ["x"], "at").awaitTermination()
    (tmp_path / "in/2.json").write_text('{"id": 1, "x": "c", "at": "2024-01-02 00:00:00"}\n')
    versions.ingest(spark, f"{tmp_path}/in", "id int, x string, at timestamp_ntz", folder, f"{tmp_path}/cp", "id", ["x"], "at").awaitTermination()
    rows = {(r.id, r.x, r.tx_to is None) for r in readers.read_version(spark, folder).collect()}
    assert rows == {(1, "a", False), (1, "c", True), (2, "b", True)}


def test_a_batch_that_comes_again_is_merged_once(spark, tmp_path):
    from tessera.streaming import versions

    merge = versions.merge_batch(f"{tmp_path}/store", "id", ["x"], "at", "one")
    rows = lambda x, day: spark.sql(f"SELECT 1 AS id, '{x}' AS x, timestamp_ntz '2024-01-0{day}' AS at")
    for number, x in ((0, "a"), (1, "b"), (1, "b"), (0, "a")):
        merge(rows(x, number + 1), number)
    assert stores.list_versions(spark, f"{tmp_path}/store").count() == 2
    versions.merge_batch(f"{tmp_path}/store", "id", ["x"], "at", "another")(rows("c", 5), 0)
    assert sorted((r.x, r.tx_to is None) for r in readers.read_version(spark, f"{tmp_path}/store").collect()) == [("a", False), ("b", False), ("c", True)]


def test_version_folders_restore_compare_and_seed(spark, tmp_path):
    folder = f"{tmp_path}/store"
    assert stores.list_versions(spark, folder).count() == 0
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z"), (4, "w"), (5, "u")], "id int, v string")
    assert stores.seed_version(a, folder) and not stores.seed_version(b, folder)
    one = stores.current(spark, folder)[1]
    two = stores.write_version(b, folder)
    got = stores.compare_versions(stores.read_version(spark, folder, one), stores.read_version(spark, folder), "id").first()
    assert tuple(got) == (3, 4, 2, 1, 1, 1, 33.33)
    assert stores.compared_commits(spark, folder, one, two).first().later == two
    stores.restore_version(spark, folder, one)
    assert stores.read_version(spark, folder).count() == 3 and stores.list_versions(spark, folder).count() == 3
    with pytest.raises(ValueError):
        stores.restore_version(spark, folder, "none")
    with pytest.raises(FileNotFoundError):
        stores.read_version(spark, f"{tmp_path}/nothing")


def test_wide_csv_in_several_parts_and_files(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    for name in "ab":
        (tmp_path / f"csv/{name}.csv").write_text("".join(f"preamble {i}\n" for i in range(10)) + ",h1,h2\n" + "".join(f",{name}{i},{i}\n" for i in range(400)) + "\n")
    bound = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("600", bound):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {tuple(r) for r in readers.read_wide_csv(spark, f"{tmp_path}/csv", "h1 string, h2 int").collect()}
            assert got == {(f"{name}{i}", i) for name in "ab" for i in range(400)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bound)


def test_arrow_shards_make_a_pool(spark, tmp_path):
    import pyarrow as pa

    texts = {0: ["a", None, "b"], 2: [" ", "e"], 10: ["f", "g"], 1: ["c", "d"]}
    for shard, rows in texts.items():
        table = pa.table({"text": pa.array(rows, pa.string())})
        new = pa.ipc.new_file if shard % 2 else pa.ipc.new_stream
        with new(f"{tmp_path}/part-7-{shard:05d}.arrow", table.schema) as out:
            out.write_table(table, max_chunksize=1)
    pool = shards.text_pool(shards.read_arrow_shards(spark, f"{tmp_path}/*.arrow", "text string"), "text")
    assert [tuple(r) for r in pool.orderBy("position").collect()] == list(enumerate("abcdefg"))
    got = [tuple(r) for r in shards.scattered(pool, ["what", "why", "where"]).orderBy("entity").collect()]
    assert got == [(0, "a", "b", "c"), (1, "d", "e", "f"), (2, "g", None, None)]
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "row long, v array<double>")
    index = spark.createDataFrame([("k", 0), ("k", 1), ("l", 7)], "id string, row long")
    assert sorted(map(tuple, shards.indexed_vectors(vectors, index, "id", ["v"]).collect())) == [("k", [2.0]), ("l", None)]


def test_reading_with_limits_and_keys(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f'{{"id": {i}, "v": "{i}"}}\n' for i in (3, 1, 2)))
    assert [r.id for r in readers.read_jsonl_unique(spark, f"{tmp_path}/x.jsonl", "id int, v string", "id", 2).collect()] == [1, 2]
    (tmp_path / "y.jsonl").write_text('{"id": 1, "v": "a"}\n{"id": 1, "v": "b"}\n')
    with pytest.raises(ValueError):
        readers.read_jsonl_unique(spark, f"{tmp_path}/y.jsonl", "id int, v string", "id")
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    assert readers.scroll(rows, "id", 10, 9999).count() == 500 and readers.scroll(rows, "id", 997).count() == 2 and readers.scroll(rows, "id", limit=0).count() == 1
    assert readers.retrieve(rows, "id", list(range(600))).count() == 500 and readers.facet_values(rows, F.col("id"), 1000).count() == 100
    assert readers.point(rows, "id", 5).first().v == 5 and readers.delete_by_key(rows, rows.where("v = 0"), "id").count() == 857
    target = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string")
    new = spark.createDataFrame([(1, "X", "Y", ["y"]), (9, "n", "n", ["x"])], "id int, x string, y string, changed array<string>")
    assert sorted(map(tuple, readers.update_fields(target, new, "id").collect())) == [(1, "a", "Y"), (2, "c", "d")]
    ids = spark.createDataFrame([("UPL-2024-0009",), ("UPL-2024-0010",), ("UPL-2023-12345",), ("X-2024-9999",), (None,)], "id string")
    assert (readers.next_id(ids, "id", "UPL", 2024), readers.next_id(ids, "id", "UPL", 2023), readers.next_id(ids, "id", "UPL", 2025)) == ("UPL-2024-0011", "UPL-2023-12346", "UPL-2025-0001")


def test_generated_rows_keep_their_shares(spark):
    profile = {"level": {"Level 1": 0.2, "Level 2": 0.8}, "status": {"Active": 3, "Expired": 1}}
    rows = generators.generated(spark, 20000, profile, 7)
    assert rows.where("level = 'Level 1'").count() == pytest.approx(4000, rel=0.1) and rows.where("status = 'Active'").count() == pytest.approx(15000, rel=0.05)
    assert rows.repartition(3).orderBy("id").limit(50).collect() == generators.generated(spark, 50, profile, 7).orderBy("id").collect()
    later = generators.delta(rows, "id", "status", changed=0.1, gone=0.05, new=0.02)
    kinds = {r.change: r.n for r in temporal.delta(rows, later, "id", ["level", "status"]).groupBy("change").agg(F.count("*").alias("n")).collect()}
    assert kinds["disappeared"] == pytest.approx(1000, rel=0.2) and kinds["changed"] == pytest.approx(2000, rel=0.2) and kinds["new"] == pytest.approx(400, rel=0.3)


def test_invariants_report_each_kind_of_violation(spark):
    rows = spark.sql("""SELECT id, CAST(a AS timestamp_ntz) AS tx_from, CAST(b AS timestamp_ntz) AS tx_to FROM VALUES
      (1, '2024-01-01', NULL), (1, '2024-02-01', NULL), (2, '2024-01-01', '2024-03-01'), (2, '2024-02-01', NULL), (3, '2024-02-01', '2024-01-01'), (4, '2024-01-01', '2024-02-01'), (4, '2024-02-01', NULL) t(id, a, b)""")
    assert {tuple(r) for r in temporal.invariants(rows, "id").collect()} == {("several current", 1), ("overlap", 1), ("overlap", 2), ("ends early", 3)}


def test_tree_edges_follow_a_dump(spark):
    edges = spark.sql("SELECT parent_id, child_id, timestamp_ntz '2024-01-01' AS tx_from, CAST(NULL AS timestamp_ntz) AS tx_to FROM VALUES ('a', 'b'), ('a', 'c'), ('b', 'd'), ('c', 'e'), ('x', 'y') t(parent_id, child_id)")
    dump = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("b", "f")], "parent_id string, child_id string")
    nodes = spark.createDataFrame([(n,) for n in "abcdfx"], "node_id string")
    got = {(r.parent_id, r.child_id, r.tx_to is None, r.tx_from.month) for r in temporal.merge_children(edges, dump, nodes, F.lit("2024-05-01").cast("timestamp_ntz")).collect()}
    # b's children changed, e and y went, so c's and x's only edges end; a's stay
    assert got == {("a", "b", True, 1), ("a", "c", True, 1), ("b", "d", False, 1), ("b", "d", True, 5), ("b", "f", True, 5), ("c", "e", False, 1), ("x", "y", False, 1)}


def test_pages_by_cursor_are_all_rows_once(spark):
    """Ties, nulls and both directions; a cursor that doesn't fit gives the first page."""
    from tessera.operators import explore

    rows = [(i, None if i % 5 == 0 else i % 3, None if i % 7 == 0 else f"n{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a int, b string").repartition(3)
    for order in (["a", "-b", "id"], ["-a", "b", "-id"]):
        want = [r.id for r in df.orderBy(*explore._sorted_by(order)).collect()]
        got, after = [], None
        while True:
            page = explore.page_after(df, order, after, 9).orderBy(*explore._sorted_by(order)).collect()
            got += [r.id for r in page]
            assert {r.total for r in page} == {40} and len({(r.has_more, r.next_cursor) for r in page}) == 1
            after = page[0].next_cursor
            if not page[0].has_more:
                break
        assert got == want and after is None
        for broken in ("?", "[1, 2]", '{"a": 1}', '["1"]', "[1, 2, 3]"):
            assert sorted(r.id for r in explore.page_after(df, order, broken, 9).collect()) == sorted(want[:9])


def test_long_version_over_two_later_ones(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2020-01-01', TIMESTAMP_NTZ'2020-12-01'), (1, TIMESTAMP_NTZ'2020-02-01', TIMESTAMP_NTZ'2020-03-01'), (1, TIMESTAMP_NTZ'2020-04-01', TIMESTAMP_NTZ'2020-05-01'), (2, TIMESTAMP_NTZ'2020-01-01', TIMESTAMP_NTZ'2020-02-01'), (2, TIMESTAMP_NTZ'2020-02-01', NULL) AS v(id, tx_from, tx_to)")
    assert [tuple(r) for r in temporal.invariants(rows, "id").collect()] == [("overlap", 1)] * 2


def test_bitmap_facets_equal_sets(spark, tmp_path):
    """Ids on both sides of zero and of buckets' ends, added rows, repeated and missing ones."""
    import random

    from tessera.operators.bitmap_facets import BitmapFacets, ids_of

    rng = random.Random(3)
    ids = [0, 1, 2, -1, 32767, 32768, 32769, -32767, -32768, -32769, 10**12, *(rng.randrange(-10**5, 10**5) for _ in range(300))]
    rows = [(f, rng.choice("xyz"), i) for i in ids for f in "ab" if rng.random() < 0.8]
    odd = [("a", None, 5), ("a", "x", None), *rows[:20]]
    frame = lambda part: spark.createDataFrame(part, "facet string, value string, id bigint")
    kept = BitmapFacets.build(frame(rows[:200] + odd), f"file://{tmp_path}/facets")
    kept.add(frame(rows[150:]))
    has = lambda f, values: {i for g, v, i in rows if g == f and v in values}
    got = lambda df: sorted(r.id for r in ids_of(df).collect())
    assert got(kept.selected({"a": "xy", "b": "z"})) == sorted(has("a", "xy") & has("b", "z"))
    assert got(kept.selected({"a": "x", "b": "z"}, every=False)) == sorted(has("a", "x") | has("b", "z"))
    assert got(kept.selected({"a": "x", "none": "z"})) == []
    among = has("a", "x")
    want = {(f, v): len(has(f, v) & among) for f in "ab" for v in "xyz"}
    assert {(r.facet, r.value): r.n for r in kept.counts(kept.selected({"a": "x"})).collect()} == {k: n for k, n in want.items() if n}
    empty = BitmapFacets.build(frame([]), f"file://{tmp_path}/none")
    assert empty.counts().count() == 0 and got(empty.selected({"a": "x"})) == []


def test_forest_equals_the_plain_way(spark):
    pairs = similarity.nearest(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), "vec_id", "embedding", 3).select(F.col("key").alias("a"), F.col("other").alias("b"), "score")
    top: dict = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    want = set()
    for score, a, b in sorted({(-r.score, min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()}):
        if root(a) != root(b):
            top[root(a)] = root(b)
            want.add((a, b))
    assert {(r.a, r.b) for r in similarity.spanning_forest(pairs).collect()} == want


RULES = ingest.RecordRules(
    key="control_id", pattern=r"^CTRL-\d{10}$", parent="parent_control_id",
    fields={"control_id": "string", "parent_control_id": "string?", "sox_relevant": "boolean?", "admins": "strings", "admin_gpns": "strings", "related_functions": "entries"},
    nested={"related_functions": ["id", "comment"]}, parallel=[("admins", "admin_gpns")])


def test_record_rules_name_all_that_is_wrong(spark):
    import json

    good = {"control_id": "CTRL-0000000001", "parent_control_id": None, "sox_relevant": True, "admins": ["a"], "admin_gpns": ["1"], "related_functions": [{"id": "f", "comment": None}]}
    row = lambda n, **kw: json.dumps({**good, "control_id": f"CTRL-{n:010d}", **kw})
    lines = {
        1: row(1), 2: row(2, parent_control_id="CTRL-0000000001"), 3: "{not json", 4: "[1]", 5: row(5, control_id="CTRL-5"), 6: row(6, parent_control_id="x"),
        7: row(7, sox_relevant="yes"), 8: row(8, admins=["a", None], admin_gpns=["1", "2"]), 9: row(9, admins=["a", "b"]), 10: row(10, related_functions=[{"id": None, "comment": None}]),
        11: row(11, related_functions=[]), 12: row(12, extra=1), 13: json.dumps({k: v for k, v in json.loads(row(13)).items() if k != "admins"}), 14: row(1), 15: row(15, parent_control_id="CTRL-9999999999"),
        16: "  ", 17: row(17, related_functions=[{"id": "f", "comment": None, "more": 1}]), 18: row(18, related_functions=[{"id": 3, "comment": None}]), 19: row(19, control_id=7), 20: row(20, related_functions=None),
    }
    got = ingest.record_violations(spark.createDataFrame(list(lines.items()), "line int, value string"), RULES)
    assert {(r.line, r.rule, r.field) for r in got.collect()} == {
        (3, "json", ""), (4, "json", ""), (5, "pattern", "control_id"), (6, "parent", "parent_control_id"), (6, "reference", "parent_control_id"), (7, "type", "sox_relevant"), (8, "type", "admins"),
        (9, "parallel", "admins"), (10, "entry", "related_functions"), (12, "unknown", "extra"), (13, "missing", "admins"), (14, "duplicate", "control_id"), (15, "reference", "parent_control_id"),
        (17, "entry", "related_functions"), (18, "entry", "related_functions"), (19, "type", "control_id"), (20, "type", "related_functions")}


def test_record_rules_parse_a_record_once_a_pass(spark):
    lines = spark.createDataFrame([(1, '{"control_id": "CTRL-0000000001"}')], "line int, value string")
    plan = ingest.record_violations(lines, RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") <= 3  # what is wrong with each, keys and the first line of each key
    assert plan.count("schemaOfVariant(") <= len(RULES.fields) + 1 and "json_object_keys" not in plan


def test_record_rules_of_keys_named_many_times(spark):
    import json

    row = lambda n, up=None: json.dumps({"control_id": n, "parent_control_id": up, "sox_relevant": None, "admins": [], "admin_gpns": [], "related_functions": []})
    c = lambda n: f"CTRL-{n:010d}"
    lines = [(0, row(c(1))), *((i, row(c(i + 1), c(1))) for i in range(1, 50)), *((i, row(c(7), c(999))) for i in range(50, 60)), (60, '{"control_id": null}'), (61, '[{"control_id": "x"}]'), (62, '"control_id"'), (63, "null")]
    got = sorted((r.line, r.key, r.rule, r.field) for r in ingest.record_violations(spark.createDataFrame(lines, "line int, value string"), RULES).where("line < 60 OR line > 60").collect())
    assert got == sorted([(i, c(7), rule, name) for i in range(50, 60) for rule, name in (("duplicate", "control_id"), ("reference", "parent_control_id"))] + [(i, None, "json", "") for i in (61, 62, 63)])


def test_relations_filter_edges_before_they_are_shuffled(spark):
    from tessera.operators import explore
    from tessera.plans import registry

    ids = spark.range(0, 100_000, 50)
    kept = explore.near_ids(ids, "id")(spark.range(100_000))
    assert kept.join(ids, "id").count() == 2000 and kept.join(ids, "id", "left_anti").count() < 100
    assert explore.near_ids(ids, "id")(spark.range(100).select(F.col("id").cast("int"))).count() == 2  # of another width
    assert explore.near_ids(ids, "id")(spark.range(100).select(F.col("id").cast("string"))).count() == 100  # left to the join
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as over tables that are large
    try:
        plan = registry.QUERIES["relations_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    semi = [line for line in plan if "LeftSemi" in line]
    assert len(semi) == 5 and all("BroadcastHashJoin" in line for line in semi)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for at, line in enumerate(plan):
        if "LeftSemi" in line:  # no exchange of edges below, but for the map
            below = [x for x in plan[at + 1:] if "Exchange hashpartitioning(" in x and depth(x) > depth(line)]
            assert "_word" in below[0]


def test_lists_brought_up_to_date_equal_a_rebuild(spark):
    import random

    rng = random.Random(2)
    vector = lambda: [float(rng.randrange(-3, 4)) for _ in range(4)]
    before = {i: vector() for i in range(80)}
    now = {i: v for i, v in before.items() if i not in (3, 9)} | {5: vector(), 70: vector(), 100: vector(), 101: vector()}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, v array<double>")
    changed = spark.createDataFrame([(i,) for i in (3, 9, 5, 70, 100, 101)], "id long")
    old = similarity.nearest(frame(before), "id", "v", 6, block=30)
    new, touched = similarity.updated_nearest(old, frame(now), changed, "id", "v", 6, block=30)
    rows = lambda df: {(r.key, r.other): (r.score, r["rank"]) for r in df.collect()}
    want = rows(similarity.nearest(frame(now), "id", "v", 6))
    assert rows(new) == want
    was, names = rows(old), {r.key for r in touched.collect()}
    assert {k for (k, o) in set(was) ^ set(want)} <= names | {3, 9} and len(names) < 78  # not all are compared again
    modes = [similarity.rebuild_mode(*x) for x in ((100, 0, 0), (100, 3, 10), (100, 100, 0), (10**6, 3, 30_000), (5, 0, 0, True))]
    assert modes == ["skip", "incremental", "full", "full", "full"]


def test_versions_of_pairs_close_and_open(spark):
    old = spark.sql("""SELECT key, other, score, category, rank, timestamp_ntz '2024-01-01' AS tx_from, CAST(NULL AS timestamp_ntz) AS tx_to
      FROM VALUES (1L, 2L, 0.9D, 'n', 1), (1L, 3L, 0.7D, 'w', 2), (2L, 1L, 0.9D, 'n', 1) t(key, other, score, category, rank)""")
    pairs = spark.createDataFrame([(1, 2, 0.9, "n", 1), (1, 4, 0.8, "w", 2)], "key long, other long, score double, category string, rank int")
    got = similarity.pair_versions(old, spark.createDataFrame([(1,)], "key long"), pairs, F.lit("2024-02-01").cast("timestamp_ntz"))
    assert {(r.key, r.other, r.tx_from.month, r.tx_to is None) for r in got.collect()} == {(1, 2, 1, True), (1, 3, 1, False), (1, 4, 2, True), (2, 1, 1, True)}


def test_canonical_values(spark):
    pairs = [("1", "number:1.0"), ("1.0", "number:1.0"), ('"1"', "string:1"), ("true", "boolean:true"), ("null", "null"), ("nope{", None), (None, None)]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in pairs], "x string").select(X.canonical_value(F.col("x"))).collect()]
    assert got == [b for _, b in pairs]
    a, b = (spark.createDataFrame([(t,)], "x string").select(X.canonical_value(F.col("x"))).first()[0] for t in ('{"a": 1, "b": [2]}', '{"b": [2], "a": 1}'))
    assert a == b and a.startswith("object:")
