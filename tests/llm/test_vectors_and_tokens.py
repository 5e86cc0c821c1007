"""Centroid clusters, SimHash classes and token alignment against the plain way, on given and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import centroid_cluster, queries, simhash_join, token_align

from ..compare import as_text, oracle_rows
from . import fixtures as X

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_clusters(rows: list[tuple], dim: int, k: int, rounds: int) -> list[tuple]:
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: ("~" if r[0] is None else X.sha(f"2:{r[0]}"), r[1]))
    cents = [v for _, v in kept[:k]]
    near = lambda v: min((sum((p - q) ** 2 for p, q in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        cents = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if groups[n] else c for n, c in enumerate(cents)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in last:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), tuple(cents[n])) for i, d, n in last), key=repr)


def odd_vectors() -> list[tuple]:
    rng = random.Random(3)
    say = lambda n=6: [rng.uniform(-1, 1) for _ in range(n)]
    hot = say()
    rows = [(i, say(), i % 3) for i in range(60)] + [(100 + i, hot, 0) for i in range(40)]
    rows += [(200, None, 1), (201, [], 1), (202, say(5), 1), (203, [*say(5), None], 1), (204, [*say(5), float("nan")], 1), (205, [*say(5), float("-inf")], 1)]
    return rows + [(None, say(), None), (None, hot, None), (7, say(), 2), (7, say(), 2), (300, [300.0, -300.0, 0.0, 1.5, 2.0, -1.0], 2)]


@pytest.mark.parametrize("k", [1, 4, 500])
def test_clusters_of_odd_vectors(spark, k, monkeypatch):
    monkeypatch.setattr(centroid_cluster, "ROWS", 16)
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({c: F.lit("x") for c in ("cluster", "vector", "ids", "d")})
    got = centroid_cluster.centroid_cluster(df, dim=6, k=k, rounds=3).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance, int(r.cluster_inertia), int(r.inertia), tuple(r.centroid)) for r in got), key=repr) == plain_clusters(rows, 6, k, 3)


def test_clusters_of_empty_tables(spark):
    for rows in ([], [(1, None, None), (None, [1.0], 2)]):
        assert centroid_cluster.centroid_cluster(spark.createDataFrame(rows, VECTORS)).count() == 0


def test_op11_against_sql(spark):
    got = queries.QUERIES["op11_centroid_clusters"](spark, X.SF).toPandas()
    assert as_text(got) == as_text(oracle_rows(centroid_cluster.ORACLE, X.SF)) and len(got)


def plain_fingerprint(text: str | None) -> int:
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in X.words(text)]
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps: dict[int, int], bits: int = 3) -> dict:
    """The smallest id that links lead to."""
    distinct = np.array(sorted(set(fps.values())), np.uint64)
    top = list(range(len(distinct)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct ^ distinct[i]) <= bits).tolist():
            p, q = sorted((root(i), root(j)))
            top[q] = p
    at = {int(f): i for i, f in enumerate(distinct)}
    least = {}
    for i in sorted(fps, key=X.order):
        least.setdefault(root(at[fps[i]]), i)
    return {i: least[root(at[f])] for i, f in fps.items()}


def test_simhash_of_given_and_odd_documents(spark):
    rows = X.own_documents() + X.odd_documents()
    got = X.by_id(simhash_join.simhash_join(X.frame(spark, rows).withColumns({c: F.lit("x") for c in ("fp", "key", "root", "sets")})).collect())
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows}
    want = plain_classes(fps)
    assert {i: (r.fp % 2**64, r.component_id) for i, r in got.items()} == {i: (f, want[i]) for i, f in fps.items()}
    assert len(set(want.values())) < len(want) and want[100_000] == want[100_001]


def test_simhash_query(spark):
    got = queries.QUERIES["op12_simhash_dups"](spark, X.SF).collect()
    fps = {r[0]: plain_fingerprint(r[1]) for r in X.own_documents()}
    want = plain_classes(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}
    assert simhash_join.simhash_join(spark.createDataFrame([], X.SCHEMA)).count() == 0
    nulls = simhash_join.simhash_join(X.frame(spark, [(None, None, None, None, None)] * 3)).collect()
    assert [(r.doc_id, r.fp, r.component_id) for r in nulls] == [(None, 0, None)] * 3


@pytest.mark.parametrize("paired, crowded", [(256, 1024), (4, 6), (4, 10**6)])
def test_links_of_long_lists(spark, monkeypatch, paired, crowded):
    """Balls of near fingerprints, random ones, and pairs at each distance: the same classes as by comparing all."""
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for center in fps[:6]:
        for _ in range(120):
            f = center
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                f ^= 1 << b
            fps.append(f)
    for center in fps[6:60]:
        for k in (3, 4, 5):
            f = center
            for b in rng.sample(range(64), k):
                f ^= 1 << b
            fps.append(f)
    fps += [fps[0] ^ x << 40 for x in range(300)]  # all agree at six positions
    for name, x in (("PAIRED", paired), ("CROWDED", crowded), ("HELD", 512)):
        monkeypatch.setattr(simhash_join, name, x)
    signed = sorted({f - (f >> 63 << 64) for f in fps})
    links = simhash_join.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all(bin((r.a ^ r.b) % 2**64).count("1") <= 3 for r in links)
    ids = {i: f % 2**64 for i, f in enumerate(signed)}
    number, top = {f: i for i, f in ids.items()}, dict(zip(ids, ids))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for r in links:
        p, q = sorted((root(number[r.a % 2**64]), root(number[r.b % 2**64])))
        top[q] = p
    assert {i: root(i) for i in ids} == plain_classes(ids)


def test_long_text_is_hashed_in_pieces(monkeypatch):
    text = X.own_documents(1)[0][1] * 3
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = simhash_join.fingerprints(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(simhash_join, "HELD", 7)
    assert (simhash_join.fingerprints(raw, np.array([0, len(raw)])) == whole).all() and int(whole[0]) == plain_fingerprint(text)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_alignment(libraries, texts: list[str | None]) -> list[tuple]:
    """Whole texts through the libraries: groups of each text, then counts over all."""
    a, b = libraries
    byte = token_align.byte_level()
    out = []
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False) if text else None
        y = b.encode(text) if text else []
        left = [bytes(byte[c] for c in t) for t in x.tokens] if x else []
        ids = x.ids if x else []
        right = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        groups = []
        if text and b"".join(left) == b"".join(right) == (" " + text).encode():
            i = j = at_a = at_b = 0
            own_a, own_b = [], []
            while i < len(left) or j < len(right):
                if at_a <= at_b and i < len(left):
                    own_a.append(ids[i])
                    at_a, i = at_a + len(left[i]), i + 1
                else:
                    own_b.append(y[j])
                    at_b, j = at_b + len(right[j]), j + 1
                if at_a == at_b and own_a and own_b:
                    groups.append((own_a, own_b))
                    own_a, own_b = [], []
        out.append(groups)
    count = Counter()
    for groups in out:
        count.update({(p, q) for x, y in groups for p in x for q in y})
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    rows = []
    for groups in out:
        links = [(p, q) for x, y in groups for p in x for q in y]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), shown))
    return rows, count


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@pytest.mark.parametrize("table", [token_align.TABLE, 100, 0])
def test_alignment_of_given_and_odd_documents(spark, libraries, table):
    more = ["  two  spaces ", " lead", "trail ", "a\n\n b\n c", "tab\tx \t y", "▁mark", "x ▁ y", "nb sp  a", "<s> </s> <|endoftext|> <0x41>", "aaa aa a aaaa" * 30, "　wide", "x" * 3000, "\x1c \x1d a", "don't I'll 's 't", "same words\rhere"]
    rows = X.own_documents(60) + X.odd_documents() + [(300_000 + i, t, None, None, None) for i, t in enumerate(more)] + X.odd_documents()[12:14]
    df = X.frame(spark, rows).withColumns({c: F.lit("x") for c in ("h", "code", "n_a", "groups")})
    got, pairs = token_align.token_align(df, table=table)
    want, count = plain_alignment(libraries, [r[1] for r in rows])
    assert sorted(((r.doc_id, *(r[c] for c in NAMES)) for r in got.collect()), key=repr) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == count


def test_alignment_forgets_and_begins_anew(spark, libraries, monkeypatch):
    """Parts that are held no longer are encoded again."""
    parts = token_align.Parts(token_align.Vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))
    monkeypatch.setattr(token_align, "HELD_TEXT", 40)
    weights = token_align.Weights(*(np.ones(len(parts.known.same), np.int64) for _ in range(2)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    sums = token_align._Sums(parts, weights)
    texts = [r[1] for r in X.own_documents(6)]
    want, _ = plain_alignment(libraries, texts)
    for text, w in zip(texts, want):
        flat, first = parts.of([text])
        assert tuple(parts.counts[flat, :4].sum(0).tolist()) == w[:4] and len(sums.now()[0]) == len(parts.counts)
        assert b";".join(parts.shown[k] for k in flat.tolist()).decode() == w[-1]
    assert parts.age > 2


def test_op13(spark, libraries):
    rows = X.own_documents()
    want, _ = plain_alignment(libraries, [r[1] for r in rows])
    got = X.by_id(queries.QUERIES["op13_token_align"](spark, X.SF).collect())
    for r, w in zip(rows, want):
        g = got[r[0]]
        assert (*(g[c] for c in NAMES[:-1]), g.groups_sha256) == (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")
    empty = token_align.token_align(spark.createDataFrame([], X.SCHEMA))
    assert [x.count() for x in empty] == [0, 0]
