"""The operators on documents against the plain way, on given and odd rows."""

from __future__ import annotations

import functools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, license_scan, quality_rules, secret_scan, substring_dedup, suffix_dedup, superkmer, token_files

from ..compare import as_text, oracle_rows
from . import fixtures as X

ROWS = X.own_documents(120) + X.odd_documents()
EMPTY_OK = [substring_dedup.substring_dedup, secret_scan.secret_scan, bpe.bpe_encode, jaccard_join.jaccard_join, license_scan.license_scan, suffix_dedup.suffix_dedup, quality_rules.quality_rules, secret_scan.mask_secrets]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names clash with those that the operators use."""
    out = X.frame(spark, ROWS).withColumns({c: F.lit("x") for c in ("spans", "sid", "n", "item", "ids", "bucket", "packed", "hub", "_text", "_lang", "rows", "x0", "kept")})
    return out.persist()


@pytest.mark.parametrize("operator", EMPTY_OK)
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], X.SCHEMA)).count() == 0


@pytest.mark.parametrize("operator", EMPTY_OK)
def test_only_nulls(spark, operator):
    operator(X.frame(spark, [(None, None, None, None, None)] * 2)).collect()


def test_substring_dedup(docs):
    got = X.by_id(substring_dedup.substring_dedup(docs).collect())
    want = X.repeated_words(ROWS, 20)
    assert set(got) == set(want)
    for i, (w, gone) in want.items():
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text, got[i].kept_sha256) == (len(w), sum(gone), kept, X.sha(kept)), i


def test_substring_dedup_of_many_small_alphabets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60))), None, None, None) for i in range(60)]
    got = X.by_id(substring_dedup.substring_dedup(X.frame(spark, rows), k=6).collect())
    for i, (w, gone) in X.repeated_words(rows, 6).items():
        assert got[i].n_removed == sum(gone)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a b c d e f g h", None, None, None)] * 2 + [(2, "z a b c d e y", None, None, None)]
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(X.frame(spark, rows), k=4).collect())
    assert got == [(1, 0), (1, 0), (2, 5)]
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(X.frame(spark, rows), k=5).collect())
    assert got == [(1, 0), (1, 0), (2, 10)]


def test_suffix_dedup(docs):
    got = X.by_id(suffix_dedup.suffix_dedup(docs).collect())
    want = X.repeated_bytes(ROWS, 50)
    assert set(got) == set(want)
    for i, (data, gone) in want.items():
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept_bytes)) == (len(data), sum(gone), spans, kept), i


def test_suffix_dedup_of_many_small_alphabets(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(90))), None, None, None) for i in range(50)]
    got = X.by_id(suffix_dedup.suffix_dedup(X.frame(spark, rows), k=8, minimiser=4).collect())
    for i, (_, gone) in X.repeated_bytes(rows, 8).items():
        assert got[i].n_removed == sum(gone)


@pytest.mark.parametrize("within", [False, True])
def test_a_hot_bucket_is_folded_as_it_comes(within):
    """The same spans whether a bucket's parts are folded on the way or not, and few strings held."""
    rng = random.Random(7)
    spec = superkmer.Spec(6, 3, within, within)
    repeats = (substring_dedup.repeats_by_sort if within else suffix_dedup.repeats_by_suffixes)(6)
    say = [" ".join(rng.choice("ab") for _ in range(9)) + " " if within else "".join(rng.choice("abc") for _ in range(9)) for _ in range(5)]
    parts = []
    for _ in range(40):
        doc = np.array(sorted(rng.randrange(60) for _ in range(8)), np.int64)
        text = [rng.choice(say) for _ in doc]
        count = np.full(8, 4, np.int32)
        more = np.array([len(t) for t in text], np.int32) - count - 5
        start = np.array([rng.randrange(0, 50, 10) for _ in doc], np.int32)
        parts.append(superkmer.pack([np.diff(doc, prepend=0), start, count, more, np.zeros(8, np.uint32)], "".join(text).encode()))
    batch = pa.RecordBatch.from_pydict({"bucket": pa.array([0] * len(parts), pa.int32()), "packed": pa.array(parts, pa.binary())})
    found = []
    for limit in (1 << 30, 300):
        spans = set()
        for out in superkmer.gatherer(spec, 1, 1, repeats, limit)(iter([batch])):
            for packed in out.column("packed").to_pylist():
                doc, start, count = superkmer.unpack(packed, superkmer.SPANS)[0]
                spans |= {(d, s + i) for d, s, c in zip(np.cumsum(doc).tolist(), start.tolist(), count.tolist()) for i in range(c)}
        found.append(spans)
    assert found[0] == found[1] and found[0]


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    kinds = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, lambda m: len(m[2]) >= 12), ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16)]
    return sorted((m.start(), k, kind, m.end()) for k, (kind, pattern, flags, long) in enumerate(kinds) for m in re.finditer(pattern, text, flags) if long(m))


def test_secret_scan(docs):
    got = X.by_id(secret_scan.digests(secret_scan.secret_scan(docs)).collect())
    for i, text, *_ in ROWS:
        base = base_spans(text or "")
        shown = [f"{kind}:{a}:{b}" for a, _, kind, b in base]
        assert [getattr(got[i], f"n_{k}") for k in ("assign", "access", "hex")] == [sum(x[2] == k for x in base) for k in ("assign", "access", "hex")]
        assert got[i].base_sha256 == X.sha(",".join(shown))
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("guess")] == shown


@functools.lru_cache(maxsize=1)
def word_ranks() -> dict[str, int]:
    import json

    vocabulary = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))["model"]["vocab"]
    out = {}
    for w in [*secret_scan.WORDS, *(t[:-4] for t in sorted(vocabulary, key=vocabulary.get) if t.endswith("</w>") and len(t) >= 7 and t[:-4].isalpha())]:
        out.setdefault(w, len(out) + 1)
    return out


def is_date(s: str) -> bool:
    parts = [re.fullmatch(r"(\d{4})[-/._]?(\d\d)[-/._]?(\d\d)", s), re.fullmatch(r"(\d\d)[-/._]?(\d\d)[-/._]?(\d{4})", s)]
    fits = [p and tuple(map(int, p.groups()[::turn])) for p, turn in zip(parts, (1, -1))]
    return any(f and 1900 <= f[0] < 2100 and 1 <= f[1] <= 12 and 1 <= f[2] <= 31 for f in fits)


def walk_turns(s: str) -> int | None:
    """The directions of a keyboard walk, one after the other counted anew, or None."""
    rows = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
    shifted = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
    where = [next(((x + y / 2, y) for y, row in enumerate(rows) if (x := row.find(shifted.get(c, c))) >= 0), None) for c in s]
    if None in where or len(s) < 3:
        return None
    moves = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(where, where[1:])]
    if any(m == (0, 0) or max(map(abs, m)) > 1 for m in moves):
        return None
    return 1 + sum(a != b for a, b in zip(moves, moves[1:]))


@functools.lru_cache(maxsize=None)
def segment_cost(s: str) -> float:
    """The least guesses of a value as one segment that isn't brute force, the plain way."""
    ranks, low, costs = word_ranks(), s.lower(), [np.inf]
    plain = "".join(dict(zip("013457@$!", "oieastasi")).get(c, c) for c in low)
    word = low if low in ranks else plain
    if len(s) >= 3 and word in ranks:
        upper = sum(c.isupper() for c in s)
        shape = 0 if not upper else np.log10(2) if upper == len(s) or (upper == 1 and s[0].isupper()) else np.log10(1 + sum(math.comb(len(s), k) for k in range(1, upper + 1)))
        costs.append(np.log10(ranks[word] + 1) + shape + np.log10(2) * sum(a != b for a, b in zip(low, word)))
    if re.fullmatch(r"(19|20)\d\d", s):
        costs.append(np.log10(120))
    if is_date(s):
        costs.append(np.log10(365 * 120) + (len(s) > 8) * np.log10(4))
    if (turns := walk_turns(low)) is not None:
        costs.append(np.log10(47) + turns * np.log10(4) + np.log10(len(s)))
    unit = (s + s).find(s, 1)  # the least rotation that gives s again: its unit
    if unit < len(s):
        costs.append(all_costs(s[:unit]) + np.log10(len(s) // unit + 1))
    return min(costs)


def all_costs(value: str) -> float:
    """The least cost over all segmentations, by trying each of them from every place."""
    best = [0.0]
    for end in range(1, len(value) + 1):
        best.append(min(best[at] + np.log10(2) * (at > 0) + min(end - at, segment_cost(value[at:end])) for at in range(end)))
    return best[-1]


@pytest.mark.parametrize("value", ["", "password", "P4ssw0rd!", "2024-01-31", "qwertyui", "aaaaabab", "xK9#mPq2", "summer2019x", "zzTop12", "1919901231", "zxcvbnmonkey", "xummersummersummers", "19991999-12-3112", "mamamamaMa", "qazwsxqazwsxqazw", "!QAZxsw2", "aaaa1aaaa1aaaa1a", "aşkŞaşk"])
def test_guess_cost_is_the_least(value):
    assert secret_scan.cost(value) == pytest.approx(all_costs(value))


@pytest.mark.parametrize("n", [100, 129, 300, 5000])
def test_long_values_are_weighed_whole(n):
    """One letter or one word over and over stays cheap, a random value dear, whatever the length."""
    rng = random.Random(n)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789#%") for _ in range(n))
    assert secret_scan.cost("a" * n) == pytest.approx(min(1 + np.log10(n + 1), n))
    assert secret_scan.cost(("summer" * n)[:n]) < secret_scan.LEAST_COST
    assert secret_scan.cost(noise) > 0.7 * n
    assert not secret_scan.find_secrets(f"pwd: {'z' * n}") and secret_scan.find_secrets(f"pwd: {noise}")


def test_guess_cost_of_random_values_is_the_least():
    """Values made of words, dates, walks, repeats and noise, against every segmentation; with a limit, what is below it."""
    rng = random.Random(31)
    bits = ["summer", "Pass", "1990-12-31", "31121990", "20", "19", "qwer", "zxcv", "asdfds", "ababab", "xyzxyz", "7", "K", "#", "q1w2", "monkey", "aa", "_"]
    for turn in range(150):
        if turn % 3:
            value = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 6)))
        else:
            value = "".join(rng.choice(["ab", "qwsa", "1290"][turn % 9 // 3]) for _ in range(rng.randrange(1, 22)))
        want = all_costs(value)
        assert secret_scan.cost(value) == pytest.approx(want), value
        assert secret_scan.cost(value, limit=5.0) == pytest.approx(min(want, 5.0)), value


@pytest.mark.parametrize("unit", [63, 64, 65, 66, 127, 500])
def test_repeats_have_units_of_any_length(unit):
    rng = random.Random(unit)
    one = "".join(rng.choice("bcdfghjkmnpqrtvxzBCDFGHJKLMNP") for _ in range(unit))
    assert secret_scan.cost(one * 20) == pytest.approx(secret_scan.cost(one) + np.log10(21))
    assert secret_scan.cost("%" + one * 3 + "%") <= 1 + secret_scan.cost(one) + np.log10(4) + 1 + 2 * np.log10(2) + 1e-9


def test_runs_are_all_of_them():
    rng = random.Random(6)
    for _ in range(300):
        value = "".join(rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(0, 24)))
        want = set()
        for unit in range(1, len(value) // 2 + 1):
            same = [value[i] == value[i + unit] for i in range(len(value) - unit)]
            for a in range(len(same)):
                if same[a] and (a == 0 or not same[a - 1]):
                    b = next((j for j in range(a, len(same)) if not same[j]), len(same)) + unit
                    own = value[a : a + unit]
                    if b - a >= 2 * unit and (own + own).find(own, 1) == unit:
                        want.add((a, b, unit))
        found = secret_scan.runs(value)
        assert len(found) == len(set(found)) and set(found) == want, value


def test_guess_spans_are_weighed():
    """What follows a base span in its value is a secret's rest only where the whole is dear, and up to the next key."""
    text = "GET /x?token=abcdefabcdef&page=2&lang=english&sort=date"
    assert secret_scan.masked(text, secret_scan.find_secrets(text)) == "GET /x?[SECRET]&page=2&lang=english&sort=date"
    text = "x?secret=aaaaaaaaaaaaaaaa#top"
    assert secret_scan.masked(text, secret_scan.find_secrets(text)) == "x?[SECRET]#top"
    text = "x?secret=aaaaaaaaaaaaaaaa&amp;pwd=xK9#mPq27&page=2"
    assert "xK9" not in secret_scan.masked(text, secret_scan.find_secrets(text))
    assert not secret_scan.find_secrets("pwd: 1919901231") and not secret_scan.find_secrets("pwd: zxcvbnmonkey")


def test_planted_credentials_are_found_and_words_are_not():
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#%"
    secret = ["".join(rng.choice(letters) for _ in range(rng.randrange(9, 40))).strip("!") + "x" for _ in range(300)]
    caught = sum(bool(secret_scan.find_secrets(f"the passphrase is {x} for now")) for x in secret)
    assert caught >= 0.99 * len(secret)
    for plain in ("required", "information", "important", "Authorization", "summer2019", "20240131", "qwertyuiop"):
        assert not secret_scan.find_secrets(f"the password is {plain} for now")


def test_guessable_values_are_no_secrets():
    assert secret_scan.cost("Password123") < secret_scan.LEAST_COST < secret_scan.cost("vT7#qLz92pX")
    assert [k for _, k, _ in secret_scan.find_secrets("pwd: vT7#qLz92pX and pwd: letmein")] == [3]


@pytest.mark.parametrize("text", ["password=CorrectHorse12&Battery99!", "x token: 'abcdefABCDEF12@tail' y", "secret=abcdefghijkl#m", "password=CorrectHorse12!", "pwd: xK9#mP", "pwd=ab&token=ABCDEFGHIJKLMN"])
def test_no_rest_of_a_value_stays(text):
    found = secret_scan.find_secrets(text)
    assert not re.search(r"[&@#!]|Battery|tail|xK9|ab&", secret_scan.masked(text, found))
    assert [(a, kind, b) for a, k, b in found if (kind := secret_scan.KINDS[k]) != "guess"] == [(a, kind, b) for a, _, kind, b in base_spans(text)]


def test_masking(spark):
    out = X.by_id(secret_scan.mask_secrets(X.frame(spark, ROWS)).collect())
    assert out[100_000].text is None
    assert out[100_022].text == secret_scan.MASK and out[100_022].n_chars == len(secret_scan.MASK)
    clean = [r for r in ROWS if r[1] and not secret_scan.find_secrets(r[1])]
    assert all(out[r[0]].text == r[1] for r in clean)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    out.no_truncation()
    out.no_padding()
    return out


def test_bpe_equals_the_library(docs, library):
    got = X.by_id(bpe.bpe_decode(bpe.bpe_encode(docs)).collect())
    for i, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == ids, i
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False), i
    assert sorted(map(str, bpe.bpe_encode(docs, with_decoded=True).collect())) == sorted(map(str, got.values()))


def test_token_files(spark, docs, library, tmp_path):
    folder = f"{tmp_path}/files"
    token_files.write_token_files(docs, folder, record_ids=3000)
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: X.order(r.doc_id))
    start = 0
    for (i, text, *_), got in zip(sorted(ROWS, key=lambda r: X.order(r[0])), rows, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert (got.doc_id, got.start, got.n_tokens, zlib.crc32(bytes(got.ids))) == (i, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [-7, -7, 0, 1 << 40], list(range(0, 100000, 37)), [1 << 62] * 300])
def test_elias_fano(values):
    packed = token_files.EliasFano.loads(token_files.EliasFano.of(np.array(values, np.int64)).dumps())
    assert packed.values().tolist() == values
    assert [packed.select(i) for i in range(len(values))] == values
    some = np.arange(len(values))[::3]
    assert packed.select_each(some).tolist() == values[::3]
    with pytest.raises(IndexError):
        packed.select(len(values))


def test_jaccard_join(docs):
    got = X.by_id(jaccard_join.jaccard_join(docs).collect())
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == X.linked_classes(ROWS)


@pytest.mark.parametrize("percent", [67, 80, 90, 100])
def test_jaccard_join_loses_no_link(spark, percent, monkeypatch):
    """Short texts of few words on both sides of the threshold; small blocks, so that clusters are cut."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(percent)
    rows = []
    for i in range(260):
        if rows and rng.random() < 0.75:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice("abcdefghij")
            w = w[: len(w) - rng.randrange(2) or None]
        else:
            w = [rng.choice("abcdefghij") for _ in range(rng.randrange(1, 60))]
        rows.append((i, " ".join(w), None, None, None))
    got = X.by_id(jaccard_join.jaccard_join(X.frame(spark, rows), percent=percent).collect())
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == X.linked_classes(rows, percent)


def test_jaccard_join_of_given_documents(spark):
    rows = X.own_documents()
    got = X.by_id(jaccard_join.op4_jaccard_join(spark, X.SF).collect())
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == X.linked_classes(rows)


def test_trie_finds_the_links_of_every_pair():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 14))).astype(np.uint64) for _ in range(60)]
    sets = list({s.tobytes(): s for s in sets}.values())
    trie = jaccard_join.Trie(sets, 80)
    for i, a in enumerate(sets):
        want = {j for j, b in enumerate(sets) if j != i and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
        assert set(trie.query(i)) == want


def test_clusters_give_a_forest():
    """A chain of near copies, of which the hub links few: all are in one class, by fewer links than sets."""
    chain = [np.arange(i, i + 100).astype(np.uint64) for i in range(40)]
    links, outside = jaccard_join.linked(chain, [20], 80)
    assert len(links) == len(chain) - 1 and not outside
    alone = [*chain, np.arange(900, 950).astype(np.uint64)]
    links, outside = jaccard_join.linked(alone, [0], 80)
    assert len(links) == len(chain) - 1 and outside == [40]


def test_crowded_links_of_many_and_of_few_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HEAVY_SETS", 5)
    rows = [(t, s, -s) for t, n in ((1, 30), (2, 5), (3, 2), (4, 1)) for s in range(n)] * 2
    got = sorted(tuple(r) for r in jaccard_join._crowded_pairs(spark.createDataFrame(rows, "token long, sid long, priority long")).collect())
    assert got == sorted((n - 1, s) for n in (30, 5, 2) for s in range(n))


def test_jaccard_join_keeps_rows_without_an_id_apart(spark):
    rng = random.Random(4)
    one, two = (" ".join(rng.choice("abcdefghij") for _ in range(30)) for _ in range(2))
    rows = [(1, one), (2, two), (None, one), (None, two), (None, "x y z"), (None, "x y z"), (None, None)]
    got = jaccard_join.jaccard_join(X.frame(spark, [(*r, None, None, None) for r in rows])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted([("1", "1"), ("2", "2"), ("None", "1"), ("None", "2")] + [("None", "None")] * 3)


def edits_inside(item: str, text: str) -> int:
    """The least edit distance of item to any passage of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        above, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (a != b)))
    return min(row)


def test_decontaminate(spark):
    rng = random.Random(8)
    letters = "abcdefgh    "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(30, 120))).strip()) for i in range(12)]
    flat = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t.lower())
    rows = []
    for i in range(120):
        part = list(rng.choice(items)[1])
        for _ in range(rng.randrange(14)):
            at = rng.randrange(len(part))
            part[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters), rng.choice(letters)])
        rows.append((i, "".join(rng.choice(letters) for _ in range(rng.randrange(60))) + "".join(part).upper().replace(" ", " \n") + "é" * (i % 3) + "".join(rng.choice(letters) for _ in range(40)), None, None, None))
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "short"), (93, items[0][1])], "item_id long, text string")
    for size in (1 << 20, 700):
        got = decontaminate.decontaminate(X.frame(spark, rows + X.odd_documents()), bench, block_bytes=size).collect()
        found = {(r.doc_id, r.item_id): r for r in got}
        want = set()
        for i, text, *_ in rows:
            for k, item in [*items, (93, items[0][1])]:
                n = len(flat(item))
                if edits_inside(flat(item), flat(text)) <= min(int(n * decontaminate.RATE), (n - decontaminate.Q) // decontaminate.Q):
                    want.add((i, k))
        assert set(found) == want
        for (i, k), r in list(found.items())[:40]:
            item = dict([*items, (93, items[0][1])])[k]
            assert edits_inside(flat(item), flat(rows[i][1][r.start : r.end])) <= r.edits
    assert decontaminate.decontaminate(X.frame(spark, rows), bench.where("item_id < 0")).count() == 0


def test_decontaminate_finds_parts_and_short_items(spark):
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefgh    ") for _ in range(n)).strip()
    long = "x" + say(700) + "x"
    bench = spark.createDataFrame([(1, long), (2, "tiny q?"), (3, "日本")], "item_id long, text string")
    texts = {1: say(50) + " " + long[200:380] + " " + say(50), 2: long[-180:], 3: say(300), 4: "a Tiny\nq? b", 5: "atiny q?", 6: "x日本y", 7: say(9) + long, 8: "tiny q?"}
    got = decontaminate.decontaminate(X.frame(spark, [(i, t, None, None, None) for i, t in texts.items()]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (4, 2), (6, 3), (7, 1), (8, 2)}
    by = {r.doc_id: texts[r.doc_id][r.start : r.end] for r in got}
    assert by[4] == "Tiny\nq?" and by[6] == "日本" and len(by[7]) >= len(long) and long[220:360] in texts[1]


def found_in(item: str, *texts: str) -> list[tuple]:
    """Row, start, end and edits of the passages of one item in texts, without Spark."""
    raw = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    got = decontaminate.passages(decontaminate.Items([item.encode()]), np.frombuffer(b"".join(raw), np.uint8), at)
    return list(zip(*(x.tolist() for x in (got[0], got[2], got[3], got[4]))))


def with_edits(item: str, places: list[int]) -> str:
    out = list(item)
    for i in places:
        out[i] = "z"
    return "".join(out)


@pytest.mark.parametrize("sizes", [[100, 127, 128, 129, 159, 160], [*range(600, 728)], [4095, 4096, 4097, 4160], [10_000]])
def test_decontaminate_at_the_edit_budget(sizes):
    """Items of any length, with all the edits that the whole allows, crowded into the ends of parts or anywhere."""
    rng = random.Random(sizes[0])
    for n in sizes:
        item = "x" + "".join(rng.choice("abcdefgh    ") for _ in range(n - 2)) + "x"
        item = re.sub("  ", " y", item)
        edits = min(int(n * decontaminate.RATE), (n - decontaminate.Q) // decontaminate.Q)
        crowded = [i for i in range(n) if i % 128 >= 64 and i % 4 == 0][:edits]
        crowded += [i for i in range(n) if i not in set(crowded)][1 : 1 + edits - len(crowded)]
        texts = [with_edits(item, crowded), "q " * 40 + with_edits(item, sorted(rng.sample(range(1, n - 1), edits))) + " r" * 30, "q r " * (n // 4)]
        got = found_in(item, *texts)
        whole = {r: (a, b, e) for r, a, b, e in got if b - a > n - 2 * edits - 1}
        assert set(whole) == {0, 1} and all(e <= edits for *_, e in whole.values()), n
        assert all(r in whole for r, *_ in got)
        if n < 200 or n % 16 == 0 and n < 1000:
            for r, (a, b, e) in whole.items():
                assert edits_inside(item, texts[r]) == e == edits_inside(item, texts[r][a:b]), n


def test_decontaminate_takes_the_nearest_of_many_passages():
    """Hundreds of passages of one item in one text, whole ones and parts, none over another."""
    rng = random.Random(20)
    say = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    item = say(400)
    bits = [rng.choice([item, item[60:260], with_edits(item, rng.sample(range(400), 40))]) for _ in range(300)]
    text, want, at = "", [], 0
    for bit in bits:
        text += bit + "-" * 60
        want.append((at, at + len(bit)))
        at = len(text)
    got = sorted((a, b) for _, a, b, _ in found_in(item, text))
    assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))
    for (a, b), bit in zip(want, bits):
        inside = [(c, d) for c, d in got if c < b and a < d]
        assert len(inside) == 1 and (len(bit) < 400 or abs(inside[0][0] - a) <= 40 and abs(inside[0][1] - b) <= 40)


def test_decontaminate_finds_whole_long_items(spark):
    """Near copies of long items, edited all over within the budget, and texts that only share their words; repeated rows each have theirs."""
    rng = random.Random(19)
    say = lambda n: "".join(rng.choice("abcdefgh    ") for _ in range(n)).strip()
    item = re.sub(" +", " ", say(6000))  # its normalised form
    near = with_edits(item, rng.sample(range(len(item)), int(len(item) * decontaminate.RATE * 0.9)))
    words = item.split()
    rng.shuffle(words)
    rows = [(1, near), (2, say(60) + item + say(60)), (3, " ".join(words)), (4, say(6000)), (5, item[:100]), (2, item)]
    bench = spark.createDataFrame([("one", item), (None, "an item without an id, which is long enough")], "item_id string, text string")
    got = decontaminate.decontaminate(X.frame(spark, [(*r, None, None, None) for r in rows] + [(6, "so: An item without\nan id, which is long enough.", None, None, None)]), bench).collect()
    assert sorted((r.doc_id, r.item_id or "") for r in got) == [(1, "one"), (2, "one"), (2, "one"), (6, "")]


def test_license_scan_equals_sql(spark):
    got = license_scan.op7_license_scan(spark, X.SF).toPandas()
    assert as_text(got) == as_text(oracle_rows(license_scan.ORACLE, X.SF)) and len(got)


def best_windows(text: str, templates: dict[str, list[str]]) -> set[tuple]:
    """License, template, start, words and Dice coefficient of each template's best window, the plain way."""
    words, out = license_scan.words_of(text), set()
    for name, texts in templates.items():
        for i, template in enumerate(texts):
            own, size = set(license_scan.bigrams_of(template)), len(license_scan.words_of(template))
            scores = []
            for at in range(len(words) - 1):
                part = words[at : at + size]
                if f"{words[at]} {words[at + 1]}" in own:
                    grams = {f"{a} {b}" for a, b in zip(part, part[1:])}
                    scores.append((-np.floor(2 * len(grams & own) / (len(grams) + len(own)) * 10000 + 0.5) / 10000, at, len(part)))
            if scores and min(scores)[0] <= -license_scan.LEAST:
                d, at, n = min(scores)
                out.add((name, i, at, n, round(-d, 4)))
    return out


def test_license_windows(spark):
    """Wrapped, indented, quoted and slightly changed paragraphs inside longer texts; clean texts have none."""
    import textwrap

    rng = random.Random(17)
    say = lambda n: " ".join(rng.choice("we may use this software under the terms of a license for any copy with or without notice and name".split()) for _ in range(n))
    every = {k: license_scan.PARAGRAPHS.get(k, []) + license_scan.NOTICES.get(k, []) for k in {**license_scan.PARAGRAPHS, **license_scan.NOTICES}}
    rows, planted = [], {}
    for name, texts in every.items():
        for i, text in enumerate(texts):
            w = text.split(" ")
            changed = " ".join(x for j, x in enumerate(w) if j % 17 != 11)
            for body in ("\n".join(f" * {x}" for x in textwrap.wrap(text, 50)), f"{say(20)} {text.upper()} {say(20)}", "// " + changed if len(w) > 20 else text):
                planted[10**6 + len(rows)] = (name, i)
                rows.append((10**6 + len(rows), say(40) + "\n" + body + "\n" + say(30), None, None, None))
    clean = range(2 * 10**6, 2 * 10**6 + 30)
    rows += [(i, say(rng.randrange(200)), None, None, None) for i in clean] + [(3 * 10**6, None, None, None, None), (3 * 10**6 + 1, "one", None, None, None)] + X.own_documents(60)
    got: dict[int, set] = {}
    for r in license_scan.license_windows(X.frame(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.license, r.template, r.start, r.n_words, r.dice))
    assert all(where in {(n, i) for n, i, *_ in got[k]} for k, where in planted.items()) and not set(got) & set(clean)
    for i, text, *_ in rows:
        assert got.get(i, set()) == best_windows(text or "", every), i


def test_license_scan_of_odd_rows(docs):
    assert license_scan.license_scan(docs).where("doc_id >= 100000 or doc_id is null").count() == 0


def repeats(text: str | None) -> tuple[int, ...]:
    w, lines = X.words(text), [x for x in (text or "").split("\n") if X.WORD.search(x)]
    where: dict[tuple, list[int]] = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {p for at in where.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), len(lines) - len(set(lines)), len(cover)


def test_quality_statistics(docs):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(ROWS)
    by = X.by_id(got)
    for i, text, *_ in ROWS:
        want = repeats(text)
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(4)
    say = lambda n, size: " ".join("".join(rng.choice("abcdefghij") for _ in range(max(1, round(rng.gauss(size, 1))))) for _ in range(n))
    rows = [(i, say(rng.randrange(40, 200), 5), "en", "web", None) for i in range(300)]
    rows += [(1000 + i, say(60, 5).replace(" ", " ## $$ "), "en", "web", None) for i in range(20)]
    rows += [(2000 + i, say(60, 14), "en", "other", None) for i in range(300)]
    got = X.by_id(quality_rules.quality_rules(X.frame(spark, rows)).collect())
    assert all(got[i].kept for i in [*range(300), *range(2000, 2300)]) and not any(got[1000 + i].kept for i in range(20))


def test_small_groups_have_verdicts(spark):
    """On given rows all groups are small; junk in a rare source goes as it would in a large one."""
    got = quality_rules.op10_quality_rules(spark, X.SF).collect()
    assert all(r.distance2 is not None for r in got if not r.base_failed) and any(not r.base_failed for r in got)
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(max(1, round(rng.gauss(5, 1))))) for _ in range(n))
    rows = [(i, say(rng.randrange(40, 200)), "en", f"rare{i % 40}", None) for i in range(300)]
    rows += [(1000, say(60).replace(" ", " ## $$ "), "en", "rare1", None), (1001, say(60).replace(" ", " ## $$ "), "xx", "rare1", None), (1002, say(60), "xx", "rare1", None)]
    got = X.by_id(quality_rules.quality_rules(X.frame(spark, rows)).collect())
    assert {i for i, r in got.items() if not r.kept} == {1000, 1001}


def test_distances_equal_numpy(spark):
    rows = X.own_documents()
    vectors = quality_rules.vector(quality_rules.statistics(X.frame(spark, rows).selectExpr("doc_id", "coalesce(lang, '') _lang", "coalesce(source, '') _source", "text"))).drop("text").persist()
    estimate = quality_rules.estimates(vectors, 1).toPandas().set_index(["_lang", "_source"])
    data = vectors.toPandas()
    for key, group in data.groupby(["_lang", "_source"]):
        x = group[[f"x{i}" for i in range(4)]].to_numpy(float)
        center = np.median(x, 0)
        scale = np.maximum(np.median(abs(x - center), 0) * 1.4826, quality_rules.FLOORS)
        d2 = (((x - center) / scale) ** 2).sum(1)
        step = np.floor(np.log1p(d2) * 1000)
        near = x[step <= np.ceil(np.percentile(step, 100 * quality_rules.SHARE))]
        cov = np.cov(near.T, bias=True) * quality_rules.CONSISTENCY + np.diag(np.square(quality_rules.FLOORS, dtype=float)) if len(near) > 1 else np.diag(np.square(quality_rules.FLOORS, dtype=float))
        e = estimate.loc[key]
        low = np.array([[e.get(f"l{i}{j}", 0.0) for j in range(4)] for i in range(4)])
        np.testing.assert_allclose([e[f"m{i}"] for i in range(4)], near.mean(0), rtol=1e-6, atol=1e-6)
        np.testing.assert_allclose(low @ low.T, cov, rtol=1e-6, atol=1e-3)


def test_no_size_changes_the_rule(spark):
    """A source that differs from its language: each further text of it moves a distance by a little, at any number of texts."""
    rng = random.Random(8)
    say = lambda size: " ".join("".join(rng.choice("abcdefghij") for _ in range(max(1, round(rng.gauss(size, 2))))) for _ in range(80))
    others, own = [(i, say(5), "en", "web", None) for i in range(200)], [(1000 + i, say(7), "en", "own", None) for i in range(51)]
    ask = lambda n: X.by_id(quality_rules.quality_rules(X.frame(spark, others + own[:n])).collect())[1000].distance2
    at = [ask(n) for n in (48, 49, 50, 51)]
    assert max(at) - min(at) <= 0.25 * max(max(at), 1.0)


def least_determinant(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of rows by concentration from three starts, the plain way."""
    ridge = np.diag(np.square(quality_rules.FLOORS, dtype=float))
    fit = lambda rows, grow: (rows.mean(0), np.cov(rows.T, bias=True).reshape(4, 4) * grow + ridge if len(rows) > 1 else ridge)
    center = np.median(x, 0)
    scale = np.maximum(np.median(abs(x - center), 0) * 1.4826, quality_rules.FLOORS)
    box = np.floor((abs(x - center) / scale).max(1) * 1000)
    ends = []
    for center, cov in [(center, np.diag(scale**2)), fit(x, 1.0), fit(x[box <= np.ceil(np.percentile(box, 50))], 1.0)]:
        det = np.inf
        while True:
            step = np.floor(np.log1p(np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)) * 1000)
            center, cov = fit(x[step <= np.ceil(np.percentile(step, 100 * quality_rules.SHARE))], quality_rules.CONSISTENCY)
            last, det = det, np.linalg.slogdet(cov)[1] / 2
            if abs(last - det) <= 1e-9:
                break
        ends.append((det, center, cov))
    return min(ends, key=lambda e: e[0])[1:]


def drawn(fit: tuple, above: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Centre and precision of n rows, drawn to those above them."""
    n, center, cov = fit
    beyond = max(n - 5, 0)
    share = beyond / (beyond + quality_rules.PRIOR_ROWS)
    return share * center + (1 - share) * above[0], share * np.linalg.inv(cov) + (1 - share) * above[1]


def test_verdicts_equal_numpy(spark):
    """Two populations in one source, and rows that would draw a mean away: distances and verdicts as the plain way has them."""
    rng = random.Random(14)
    say = lambda n, size, noise: " ".join("".join(rng.choice("abcdefghij") for _ in range(max(1, round(rng.gauss(size, 2))))) + ("#" if rng.random() < noise else "") for _ in range(n))
    rows = [(i, say(rng.randrange(30, 200), 5, 0.02), "en", "web", None) for i in range(160)]
    rows += [(1000 + i, say(rng.randrange(30, 200), 9, 0.6), "en", "web", None) for i in range(40)]
    rows += [(2000 + i, say(rng.randrange(30, 200), 6, 0.1), "en", "wiki", None) for i in range(80)]
    got = X.by_id(quality_rules.quality_rules(X.frame(spark, rows)).collect())
    found = {}
    for source in ("web", "wiki", "*"):
        ids = [r[0] for r in rows if source in (r[3], "*") and not got[r[0]].base_failed]
        values = [(np.log(got[i].word_chars / got[i].n_words), np.sqrt(got[i].n_symbols / got[i].n_words), np.sqrt(got[i].n_dup_lines), np.sqrt(got[i].n_repeat_words / got[i].n_words)) for i in ids]
        x = np.floor(np.array(values) * 1000 + 0.5)
        found[source] = ids, x, (len(x), *least_determinant(x))
    whole = found.pop("*")[2]  # of the language, and of all texts
    for ids, x, fit in found.values():
        center, precision = drawn(fit, (whole[1], np.linalg.inv(whole[2])))
        d2 = np.einsum("ij,jk,ik->i", x - center, precision, x - center)
        assert [got[i].kept for i in ids] == (d2 <= quality_rules.CUTOFF).tolist()
        np.testing.assert_allclose([got[i].distance2 for i in ids], d2, rtol=0.02, atol=0.02)
    assert not all(got[1000 + i].kept for i in range(40)) and all(got[i].kept for i in range(160))
