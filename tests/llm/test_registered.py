"""The registered queries over the given tables against the plain way, digests included."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import decontaminate, quality_rules, queries, secret_scan

from . import fixtures as X
from .test_texts import all_costs, base_spans, drawn, edits_inside, least_determinant, repeats


@pytest.fixture(scope="module")
def texts() -> dict[int, str]:
    return {r[0]: r[1] or "" for r in X.own_documents()}


@pytest.fixture(scope="module")
def ids(texts) -> dict[int, list[int]]:
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    return {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def run(spark, name: str) -> dict:
    return X.by_id(queries.QUERIES[name](spark, X.SF).collect())


def test_op2(spark, texts):
    got = run(spark, "op2_secret_scan")
    assert set(got) == set(texts)
    for i, text in texts.items():
        base = base_spans(text)
        shown = [f"{kind}:{a}:{b}" for a, _, kind, b in base]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[2] == k for x in base) for k in ("assign", "access", "hex"))
        assert got[i].base_sha256 == X.sha(",".join(shown))
        spans = [s for s in got[i].spans.split(",") if s]
        assert [s for s in spans if not s.startswith("guess")] == shown
        # values in a credential context, weighed over every segmentation; at an assign span up to the next key
        want, at = set(), 0
        while m := secret_scan.CONTEXT.search(text, at):
            start, at = m.span(2)
            close = [b for a, _, kind, b in base if kind == "assign" and a <= start < b]
            if close:
                then = re.search(r"&(amp;)?[\w.\[\]-]+=", text[close[0] : at], re.ASCII)
                at = close[0] + then.start() if then else at
            value = text[start:at].rstrip(".?)" if close else ".!?)")
            if (start + len(value) > close[0] if close else len(value) >= 6) and all_costs(value) >= min(secret_scan.LEAST_COST, len(value)):
                want.add((start, start + len(value)))
        assert {tuple(map(int, s.split(":")[1:])) for s in spans if s.startswith("guess")} == want


def test_op3(spark, texts, ids):
    got = run(spark, "op3_bpe")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(got) == set(texts)
    for i, own in ids.items():
        assert got[i].n_tokens == len(own)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(own)}I", *own)).hexdigest()
        assert got[i].decoded_sha256 == X.sha(library.decode(own, skip_special_tokens=False))


def test_op6(spark, ids):
    got, start = run(spark, "op6_token_files"), 0
    for i in sorted(ids):
        own = [*ids[i], 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)))
        start += len(own)


def test_op9(spark):
    rows = X.own_documents()
    got = run(spark, "op9_suffix_dedup")
    for i, (data, gone) in X.repeated_bytes(rows, 50).items():
        runs = sum(1 for at, g in enumerate(gone) if g and (at == 0 or not gone[at - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(data), sum(gone), runs, X.sha(kept)), i


def flat(text: str) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_op8(spark, texts):
    """Every text that holds an item word for word is found; every passage found is as near as it says."""
    items = {r.item_id: r.text for r in spark.read.parquet(f"{X.SF}/benchmark.parquet").collect()}
    got = queries.QUERIES["op8_decontaminate"](spark, X.SF).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert {(i, k) for i, t in texts.items() for k, item in items.items() if flat(item) in flat(t)} <= found
    for r in got:
        own, passage = flat(items[r.item_id]), flat(texts[r.doc_id][r.start : r.end])
        whole = edits_inside(own, passage)
        assert whole == r.edits or min(edits_inside(part.decode(), passage) for part in decontaminate.parts(own.encode())) <= r.edits <= len(own) * decontaminate.RATE


def verdicts(rows: list[tuple]) -> dict[int, bool]:
    """Whether each document is kept, the plain way: base rules, and distances by its group's estimate, drawn to its language's and to that of all texts."""
    stats = {r[0]: (*repeats(r[1]), len([x for x in (r[1] or "").split("\n") if X.WORD.search(x)])) for r in rows}
    failed = {i: s[0] < 20 or 100 * s[4] > 30 * s[0] for i, s in stats.items()}
    half_up = lambda v: np.floor(v * 1000 + 0.5)
    vector = {i: half_up(np.array([np.log(max(s[1], 1) / max(s[0], 1)), np.sqrt(s[2] / max(s[0], 1)), np.sqrt(s[3] / max(s[5], 1)), np.sqrt(s[4] / max(s[0], 1))])) for i, s in stats.items()}
    group = {r[0]: (r[2] or "", r[3] or "") for r in rows}
    passed = [i for i in stats if not failed[i]]
    own = lambda i: [j for j in passed if group[j] == group[i]]
    lang = lambda i: [j for j in passed if group[j][0] == group[i][0]]
    out = {i: False for i in stats}
    if passed:
        fit = lambda members: (len(members), *least_determinant(np.stack([vector[j] for j in members])))
        _, middle, scatter = fit(passed)
        whole = middle, np.linalg.inv(scatter)
        langs = {group[i][0]: drawn(fit(lang(i)), whole) for i in {group[i][0]: i for i in passed}.values()}
        groups = {group[i]: drawn(fit(own(i)), langs[group[i][0]]) for i in {group[i]: i for i in passed}.values()}
    for i in passed:
        center, precision = groups[group[i]]
        d = vector[i] - center
        out[i] = bool(d @ precision @ d <= quality_rules.CUTOFF)
    return out


def test_op10_and_its_stage(spark):
    import corpus_pipeline as P

    rows = X.own_documents()
    want = verdicts(rows)
    assert {i: r.kept for i, r in run(spark, "op10_quality_rules").items()} == want and set(want.values()) == {True, False}
    left = P.quality_stage(spark, X.frame(spark, rows), X.SF).collect()
    assert {r.doc_id for r in left} == {i for i, kept in want.items() if kept}


def test_benchmark_stage_keeps_what_quotes_nothing(spark, texts):
    import corpus_pipeline as P

    items = [flat(r.text) for r in spark.read.parquet(f"{X.SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in P.benchmark_stage(spark, X.frame(spark, X.own_documents()), X.SF).collect()}
    least = decontaminate.PART + decontaminate.STRIDE - 1
    parts = {item[a : a + least] for item in items for a in range(len(item) - least + 1)}
    grams = [{item[a : a + decontaminate.Q] for a in range(len(item))} for item in items]
    for i, t in ((i, flat(t)) for i, t in texts.items()):
        quoted = any(item in t for item in items) or any(t[a : a + least] in parts for a in range(len(t) - least + 1))
        assert not (quoted and i in kept)
        own = {t[a : a + decontaminate.Q] for a in range(len(t))}
        if i not in kept:  # something of an item is there
            assert any(len(own & g) >= 10 for g in grams)
