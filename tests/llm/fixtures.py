"""Small document tables, and the plain way to what the operators compute."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def own_documents(most: int = 10**9) -> list[tuple]:
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()][:most]


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, near copies and odd characters."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["lorem", "ipsum", "Dolor", "sit", "amet", "élan", "日本", "ß", "x1"]) + str(rng.randrange(40)) for _ in range(n))
    base = say(120)
    words = base.split(" ")
    near = " ".join(words[:60] + ["other"] + words[61:])
    far = " ".join(words[:40] + say(80).split(" "))
    texts = [None, "", " \t\n", "one", "two words", "a b c d", "a b c d e", "A B c d e", base, base, base.upper().replace("É", "é"), near, far, "ha " * 300, say(9) * 2000, "l1\nl1\n\nl2\nl1", "a\u0085b c   d", "<|im_end|> [UNK] don't I'LL 3,14 İΣ", "x" * 5000, "\x00 null byte", "日本語" * 40, "日本語" * 40 + "別", "password = hunter2hunter2", "AKIA" + "Z9" * 8, "deadbeef" * 3]
    rows = [(100_000 + i, t, "en", "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [(200_000, base, None, None, None), (None, near, None, "web", 3)]


def frame(spark, rows: list[tuple], parts: int = 3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def by_id(rows) -> dict:
    return {r["doc_id"]: r for r in rows}


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def order(i: int | None) -> int:
    """A null id comes last."""
    return 1 << 62 if i is None else i


def repeated_words(rows: list[tuple], k: int) -> dict:
    """doc_id: which words a window of k words that starts earlier elsewhere covers."""
    first: dict[tuple, tuple] = {}
    out = {}
    for i, text, *_ in sorted(rows, key=lambda r: order(r[0])):
        w = words(text)
        gone = [False] * len(w)
        for at in range(len(w) - k + 1):
            if first.setdefault(tuple(w[at : at + k]), (order(i), at)) != (order(i), at):
                gone[at : at + k] = [True] * k
        out[i] = (w, gone)
    return out


def repeated_bytes(rows: list[tuple], k: int) -> dict:
    """doc_id: which bytes a string of k bytes that a smaller document has covers."""
    first: dict[bytes, int] = {}
    out = {}
    for i, text, *_ in sorted(rows, key=lambda r: order(r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - k + 1):
            if first.setdefault(data[at : at + k], order(i)) < order(i):
                gone[at : at + k] = b"\1" * k
        out[i] = (data, gone)
    return out


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def linked_classes(rows: list[tuple], percent: int = 80) -> dict:
    """doc_id: size of its set and the smallest id that links lead to."""
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets, key=order)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = sorted((root(ids[a]), root(ids[b])), key=order)
                    top[q] = p
    return {i: (len(s), root(i)) for i, s in sets.items()}
