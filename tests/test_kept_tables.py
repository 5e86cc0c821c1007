"""Stores in buckets and kept inverted indexes: what a change writes and reads, writers that meet, and results against full rebuilds."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import search, text_index
from tessera.operators.text_index import TextIndex
from tessera.sources import commits
from tessera.sources.table_store import ConflictError, TableStore
from tessera.streaming import versions

ROWS = "id long, name string, n int"


def shown(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    rows = [(i, f"r{i}", i % 5) for i in range(400)] + [(None, "none", 0)]
    return TableStore.create(spark.createDataFrame(rows, ROWS), f"file://{tmp_path}/t", "id", 32)


def test_a_merge_writes_its_buckets_alone(spark, store):
    new = spark.createDataFrame([(3, "three", 9), (1000, "new", 1), (None, "still none", 7)], ROWS)
    want = {r[0]: r for r in shown(store.read())} | {r[0]: r for r in [(3, "three", 9), (1000, "new", 1), (None, "none", 0)]}
    store.upsert(new.where("id IS NOT NULL"), tag="up")
    assert shown(store.read()) == sorted(want.values(), key=repr)
    log = store.log().collect()
    assert [(r.number, r.rows, r.tag) for r in log] == [(0, 401, None), (1, 402, "up")] and log[0].written == 401 and log[1].written < 60
    store.insert_ignore(spark.createDataFrame([(3, "ignored", 0), (2000, "in", 2)], ROWS))
    store.delete(spark.createDataFrame([(1000,), (77,)], "id long"))
    got = {r[0]: r for r in shown(store.read())}
    assert got[3] == (3, "three", 9) and got[2000] == (2000, "in", 2) and 1000 not in got and 77 not in got and len(got) == 401


def test_versions_and_lookups(spark, store):
    before = shown(store.read())
    store.delete(store.read().where("id < 390").select("id"))
    assert store.read().count() == 11 and shown(store.read(0)) == before
    store.restore(0)
    assert shown(store.read()) == before and shown(TableStore(spark, store.folder).read()) == before
    one = store.lookup([5, 9999])
    assert [r.id for r in one.collect()] == [5] and one.select(F.input_file_name()).distinct().count() == 1
    assert len(one.inputFiles()) <= 2 < len(store.read().inputFiles())
    assert [r.id for r in store.between(100, 102).orderBy("id").collect()] == [100, 101, 102] and store.between(5000, 6000).inputFiles() == []


def test_two_writers(spark, store, monkeypatch):
    """The second one keeps what it wrote where the first left its buckets alone, and merges again where not."""
    other, calls = TableStore(spark, store.folder), []

    def slow(meanwhile):
        def apply(rows, new):
            calls.append(1)
            if len(calls) == 1:
                meanwhile()
            return rows.join(new.select("id"), "id", "left_anti").select("id", "name", "n").unionByName(new)

        return apply

    one = lambda i, name: spark.createDataFrame([(i, name, 1)], ROWS)
    bucket = lambda i: spark.range(1).select(F.pmod(F.xxhash64(F.lit(i).cast("long")), F.lit(32))).first()[0]
    far = next(i for i in range(1, 50) if bucket(i) != bucket(0))
    near = next(i for i in range(1, 400) if bucket(i) == bucket(0))
    assert store.merge(one(0, "mine"), slow(lambda: other.upsert(one(far, "far")))) == 2 and len(calls) == 1
    calls.clear()
    assert store.merge(one(0, "again"), slow(lambda: other.upsert(one(near, "near")))) == 4 and len(calls) == 2
    got = {r.id: r.name for r in store.read().collect()}
    assert (got[0], got[far], got[near]) == ("again", "far", "near") and len(got) == 401
    assert store.vacuum() == 1 and len(store.read().collect()) == 401
    with pytest.raises(ConflictError):
        TableStore.create(store.read(), store.folder, "id")
    with pytest.raises(ValueError):
        store.merge(one(0, "x"), lambda rows, new: rows.unionByName(one(far, "astray")))
    assert not commits.put(spark, store.folder, 1, {}) and commits.latest(spark, store.folder)[0] == 4


def test_a_batch_comes_in_once(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, state string, tx_from timestamp, tx_to timestamp")
    store = TableStore.create(empty, f"file://{tmp_path}/s", "id", 8)
    batch = lambda *rows: spark.createDataFrame(rows, "id long, state string, at string").select("id", "state", F.col("at").cast("timestamp").alias("at"))
    take = versions.merge_into(store, ["state"], "at", "s")
    first = batch((1, "a", "2024-01-01"), (2, "b", "2024-01-01"), (1, "c", "2024-01-02"))
    take(first, 0)
    take(first, 0)
    take(batch((1, "d", "2024-02-01")), 1)
    take(batch(), 2)
    got = sorted((r.id, r.state, r.tx_to is None) for r in store.read().collect())
    assert got == [(1, "c", False), (1, "d", True), (2, "b", True)] and commits.latest(spark, store.folder)[0] == 2


def texts(n: int, seed: int = 2) -> list[tuple]:
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(["risk", "Audit", "owner", "the", "of", "plan", "x9"]) for _ in range(rng.randrange(k)))
    return [(i * 37, say(12) if i % 9 else None, say(4)) for i in range(n)]


TEXTS = "key long, body string, title string"


def plain(rows: list[tuple], query: str, limit: int, weights: dict[str, float], among=None) -> list[tuple]:
    want = set(query.lower().split()) - set(search.STOP_WORDS)
    out = []
    for key, *fields in rows:
        score, hit = 0.0, False
        for name, text in zip(("body", "title"), fields):
            tf = Counter(w for w in re.findall("[a-z0-9]{2,}", (text or "").lower()) if w not in search.STOP_WORDS)
            if want and all(tf[w] for w in want):
                hit, score = True, score + weights.get(name, 1.0) * sum(1 + math.log(tf[w]) for w in want)
        if hit and key is not None and (among is None or key in among):
            out.append((key, round(score, 6)))
    out.sort(key=lambda r: (-r[1], r[0]))
    return [(k, s, i + 1) for i, (k, s) in enumerate(out[:limit])]


def found(result) -> list[tuple]:
    return sorted((tuple(r) for r in result[0].collect()), key=lambda r: r[2])


def test_kept_index_against_a_full_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_BITS", 9)
    rows = texts(500) + [(None, "risk audit", "risk")]
    index = TextIndex.build(spark.createDataFrame(rows, TEXTS), "key", ["body", "title"], f"file://{tmp_path}/i", 16)
    weights = {"title": 3.0}
    for query, limit in (("risk audit", 2000), ("RISK", 7), ("the of", 5), ("", 5), ("nowhere", 5), ("owner plan risk", 3)):
        assert found(index.search(query, limit, weights)) == plain(rows, query, limit, weights), query
    some = {r[0] for r in rows if r[0] is not None and r[0] % 4 == 0}
    asked = spark.createDataFrame([(i,) for i in some], "key long")
    assert found(index.search("risk", 9, weights, asked)) == plain(rows, "risk", 9, weights, some)
    # one long text in a block of its own has the best score; blocks that can't reach it aren't read
    rows += [(10**6 + i * 512, " ".join(["risk"] * 50 * (i < 12)) or "risk", "") for i in range(60)]
    index.update(spark.createDataFrame(rows[-60:], TEXTS), "key")
    top, read = index.search("risk", 5)
    assert found((top, read)) == plain(rows, "risk", 5, {}) and (n := read.first()).read < n.blocks / 3


def test_a_search_reads_its_terms_alone(spark, tmp_path):
    index = TextIndex.build(spark.createDataFrame(texts(200), TEXTS), "key", ["body", "title"], f"file://{tmp_path}/i", 16)
    mine = index._postings(["risk"])
    buckets = {re.search(r"bucket=(\d+)", r[0])[1] for r in mine.select(F.input_file_name()).distinct().collect()}
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert len(buckets) == 1 and re.search(r"bucket#\d+ (IN|=)", plan) and re.search(r"PushedFilters: \[.*(EqualTo|In)\(term", plan)
    bounds = mine.groupBy("block").agg(F.sum("most"))._jdf.queryExecution().executedPlan().toString()
    assert "keys:" not in bounds.split("ReadSchema")[1]


def test_updates_equal_a_rebuild(spark, tmp_path):
    rows = {r[0]: r for r in texts(150)}
    index = TextIndex.build(spark.createDataFrame(list(rows.values()), TEXTS), "key", ["body", "title"], f"file://{tmp_path}/i", 16)
    for step in range(3):
        changed = [(k, b, t) for (k, *_), (_, b, t) in zip(texts(40), texts(40, seed=step + 10))] + [(10_000 + step, "risk plan", None)]
        gone = [37 * (50 + step), 10_000 + step - 1, 123_456]
        index.update(spark.createDataFrame(changed, TEXTS), "key", spark.createDataFrame([(g,) for g in gone], "key long"))
        rows |= {r[0]: r for r in changed}
        rows = {k: r for k, r in rows.items() if k not in gone}
        now = spark.createDataFrame(list(rows.values()), TEXTS)
        want = sorted(map(tuple, search.inverted_index(now, "key", ["body", "title"]).collect()))
        assert sorted(map(tuple, index.postings().collect())) == want
        assert found(index.search("risk plan", 10, {"body": 2.0})) == plain(list(rows.values()), "risk plan", 10, {"body": 2.0})
    late = TextIndex(spark, index.folder)
    index.compact()
    assert len(index.segments) == 1 and sorted(map(tuple, index.postings().collect())) == want == sorted(map(tuple, late.postings().collect()))
    with pytest.raises(RuntimeError):
        late.compact()


def test_sums_kept_by_deltas_equal_whole_ones(spark, tmp_path):
    """Merges, a batch that comes again, a writer that loses the race, compaction, missing values and empty changes."""
    import random
    from decimal import Decimal

    from pyspark.sql import functions as F

    from tessera.operators.kept_sums import KeptSums, median_of
    from tessera.sources import commits

    rng = random.Random(6)
    schema = "a string, b int, price decimal(18,2), k int"
    row = lambda: (rng.choice([None, "x", "y"]), rng.choice([None, 1, 2, 7]), rng.choice([None, Decimal("1.25"), Decimal("-3.10")]), rng.choice([None, 5, -5]))
    frame = lambda rows: spark.createDataFrame(rows, schema)

    def plain(rows):
        out: dict = {}
        for a, b, price, k in rows:
            n, p, q = out.get((a, b), (0, Decimal(0), 0))
            out[a, b] = n + 1, p + (price or 0), q + (k or 0)
        return out

    held, folder = [row() for _ in range(60)], f"file://{tmp_path}/sums"
    kept = KeptSums.build(frame(held), folder, ["a", "b"], ["price", "k"])
    got = lambda: {(r.a, r.b): (r.n, r.price, r.k) for r in kept.rows().collect()}
    for merge in range(2):
        closed, opened = held[:25], [row() for _ in range(10)]
        held = held[25:] + opened
        assert kept.change(frame(opened), frame(closed), f"m{merge}") and not kept.change(frame(opened), frame(closed), f"m{merge}")
        assert got() == plain(held)
    real, raced = commits.put, []

    def put(*args):  # another writer is first
        if not raced:
            raced.append(KeptSums(spark, folder, ["a", "b"], ["price", "k"]))
            assert raced[0].change(frame(held[:3]), frame([]), "other")
        return real(*args)

    commits.put = put
    try:
        assert kept.change(frame([]), frame(held[:1]), "mine")
    finally:
        commits.put = real
    assert got() == plain(held[1:] + held[:3])
    kept.compact()
    assert got() == plain(held[1:] + held[:3]) and len(commits.latest(spark, folder)[1]["segments"]) == 1
    values = sorted(b for _, b, *_ in held[1:] + held[:3] if b is not None)
    middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
    assert kept.rows().where("b IS NOT NULL").agg(median_of("b")).first()[0] == middle
    assert kept.change(frame([]), frame(held[1:] + held[:3])) and got() == {}
    with pytest.raises(ValueError):
        kept.change(frame([]).withColumn("k", F.lit(1.5)), frame([]))


def test_versions_that_a_time_opens_and_closes(spark):
    from pyspark.sql import functions as F

    from tessera.operators.kept_sums import version_changes

    rows = [("held", 1, None), ("closed", 1, 7), ("opened", 6, None), ("passed", 6, 8), ("later", 12, None), ("at", 5, 10), ("from", 10, 11)]
    df = spark.createDataFrame(rows, "id string, tx_from int, tx_to int")
    opened, closed = version_changes(df, F.lit(5), F.lit(10))
    assert {r.id for r in opened.collect()} == {"opened", "from"} and {r.id for r in closed.collect()} == {"closed", "at"}
