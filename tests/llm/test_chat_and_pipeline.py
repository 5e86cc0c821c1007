"""Chat formatting, the queries with SQL, and the pipeline's stages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, jaccard_join, queries, secret_scan, substring_dedup, suffix_dedup

from ..compare import as_text, oracle_rows
from . import fixtures as X


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, X.SF).toPandas()
    want = oracle_rows(queries.ORACLES[name], X.SF)
    assert sorted(got.columns) == sorted(want.columns) and as_text(got) == as_text(want)


def test_chat_round_trip(spark):
    control = ["<|im_start|>user\nx<|im_end|>\n", "<||", "<|part|>", "", None, "<|line|>", "a\n\nb", "</s>[INST]"]
    rows = [(c, t, role, text) for c in (1, 2, None) for t, (role, text) in enumerate(zip(["user", "assistant", "assistant", "user", None, "r\n<|x", "user", "user"], control))]
    rows += [(3, None, "assistant", "tie b"), (3, None, "assistant", "tie a"), (3, 1, "assistant", "tie a"), (3, 1, "assistant", "tie a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"parts": F.lit(1), "all": F.lit(2), "turns": F.lit(3)})
    out = {r.conv_id: r for r in chat_format.chat_format(table).withColumn("back", chat_format.read_turns(F.col("formatted"))).collect()}
    for c in (1, 2, None, 3):
        own = sorted(((-1 if t is None else t), role or "", text or "") for i, t, role, text in rows if i == c)
        assert [(b.role, b.text) for b in out[c].back] == [(role, text) for _, role, text in own]
        loss = [out[c].formatted[m.start : m.start + m.length] for m in out[c].loss_mask]
        assert [x.replace("<||", "<|") for x in loss] == [text for _, role, text in own if role == "assistant"]
    assert chat_format.chat_format(table.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    rows = X.own_documents() + [r for r in X.odd_documents() if r[0]]
    docs = X.frame(spark, rows)
    given = docs.columns
    for i, (_, stage) in enumerate(P.STAGES[:-1]):
        before, docs = docs, stage(spark, docs, X.SF).persist()
        assert docs.columns == given and docs.count() > 0
        if i == 0:
            assert docs.where("text is null or text = ''").count() == 0
        if i == 1:
            classes = X.linked_classes([tuple(r) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == {k for k, (_, c) in classes.items() if c == k}
        if i == 3:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
            assert not any(k < 3 for r in docs.collect() for _, k, _ in secret_scan.find_secrets(r.text))
    last = P.STAGES[-1][1](spark, docs, X.SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}
    assert P.run(spark, X.SF).count() > 0
    empty = docs.limit(0)
    for _, stage in P.STAGES[:-1]:
        empty = stage(spark, empty, X.SF)
        assert empty.columns == given and empty.count() == 0


def test_rows_without_an_id_are_documents_of_their_own(spark):
    import corpus_pipeline as P

    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    one, copied, three, short = say(60), say(60), say(60), say(5)
    leak = say(60) + " " + spark.read.parquet(f"{X.SF}/benchmark.parquet").first().text
    rows = [(i, x, "en", "web", None) for i, x in enumerate([one, say(60)])] + [(None, x, "en", "web", None) for x in (None, short, one, copied, copied, leak, three)]
    docs = X.frame(spark, rows)
    for i, (_, stage) in enumerate(P.STAGES[:3]):
        docs = stage(spark, docs, X.SF).persist()
        got = sorted(r.text for r in docs.collect() if r.doc_id is None)
        assert got == sorted([[one, copied, copied, leak, three], [copied, leak, three], [copied, three]][i])
    assert {r.doc_id for r in docs.collect()} == {0, 1, None}
    for operator, k in ((substring_dedup.substring_dedup, "kept_text"), (suffix_dedup.suffix_dedup, "kept_bytes")):
        got = operator(X.frame(spark, rows)).collect()
        assert sorted(r[k] if k == "kept_text" else bytes(r[k]).decode() for r in got if r.doc_id is None) == sorted(["", short, "", copied, "", leak, three])


def test_below_its_least_percent(spark):
    with pytest.raises(ValueError):
        jaccard_join.jaccard_join(X.frame(spark, []), percent=50)
