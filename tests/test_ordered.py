"""Uploads in order: out of order, repeated, missing and discarded ones, over a restart."""

from __future__ import annotations

import json
import random

from tessera.streaming import ordered

SCHEMA = "source string, number long, ref string, discarded boolean"


def test_uploads_wait_for_their_predecessor(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"file://{source}")
        query = ordered.in_order(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(((r.source, r.number, r.ref) for r in spark.read.schema(ordered.RELEASED).parquet(f"file://{tmp_path}/out").collect()), key=lambda r: r[:2])

    def put(name, *rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("source", "number", "ref", "discarded"), r))) for r in rows))

    put("1.json", ("a", 2, "a2"), ("a", 1, "a1"), ("a", 1, "a0"), ("b", 2, "b2"), ("a", 4, "a4"), (None, 1, "x"), ("a", 0, "x"), ("a", None, "x"))
    first = [("a", 1, "a0"), ("a", 2, "a2")]
    assert run() == first  # b's first and a's third are missing
    put("2.json", ("a", 3, None, True), ("a", 2, "again"), ("a", 4, "again"), ("b", 3, "b3"))
    put("3.json", ("b", 1, "b1"), ("c", 1, None))
    assert run() == sorted([*first, ("a", 4, "a4"), ("b", 1, "b1"), ("b", 2, "b2"), ("b", 3, "b3"), ("c", 1, None)], key=lambda r: r[:2])


def test_any_arrival_order_releases_all():
    rng = random.Random(2)
    for _ in range(50):
        numbers = list(range(1, 12))
        rng.shuffle(numbers)
        after, waiting, out = 1, {}, []
        for n in numbers:
            waiting[n] = (str(n), n % 4 == 0)
            after, more = ordered.advanced(after, waiting)
            assert all(k < after for k, _ in more)
            out += more
        assert [k for k, _ in out] == [n for n in range(1, 12) if n % 4] and after == 12 and not waiting
