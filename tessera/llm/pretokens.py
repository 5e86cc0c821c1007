"""Normalised, split texts of a word-level BPE vocabulary, as flat arrays.

Follows the file's own rules: added tokens are cut out of the raw text; the rest
is brought to NFC and lower case; white space only separates; tokens are
contractions, runs of letters, single numbers and runs of anything else.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np

from . import arrays as A

#: White_Space of the Unicode character database.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER = 1, 2, 3
APOSTROPHE = ord("'")
#: What follows the apostrophe in the contractions that the vocabulary's pattern lists.
CONTRACTED = ["s", "t", "re", "ve", "m", "ll", "d"]
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """0 for white space, else LETTER, NUMBER or OTHER, for each code point."""
    if not _classes:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        table[WHITE] = 0
        _classes.append(table)
    return _classes[0]


def normal(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a capital sigma has one small letter here, wherever it stands
    return text.lower()


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, and first, end and text number of each token."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    edge = np.cumsum([0] + [len(t) + 1 for t in texts])
    if not len(codes):
        return codes, *(np.zeros(0, np.int64) for _ in range(3))
    kind = classes()[codes]
    opens = np.ones(len(kind), bool)
    opens[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    opens &= kind != 0
    marks = np.flatnonzero((codes[:-1] == APOSTROPHE) & opens[:-1] & (kind[1:] == LETTER))
    if len(marks):
        padded = np.append(codes, [0, 0, 0])
        for letters in CONTRACTED:
            hit = marks[np.logical_and.reduce([padded[marks + 1 + i] == ord(x) for i, x in enumerate(letters)])]
            opens[hit + 1] = False
            after = hit + 1 + len(letters)
            after = after[after < len(kind)]
            opens[after] |= kind[after] == LETTER
    starts = np.flatnonzero(opens)
    stops = np.flatnonzero(opens | (kind == 0))
    ends = np.append(stops, len(kind))[np.searchsorted(stops, starts, "right")]
    return codes, starts, ends, np.searchsorted(edge, starts, "right") - 1


class Encoder:
    """ids of texts; each word is encoded once, by ``encode_words``.

    encode_words(words) gives the ids of all words (one array) and how many each has.
    """

    def __init__(self, encode_words: Callable, added: dict[str, int], most: int = 250_000):
        self.encode_words, self.added, self.most = encode_words, added, most
        self.cut = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.at, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, keys: list[bytes]) -> np.ndarray:
        """Where in the cache each of these words is (UTF-32 bytes)."""
        if len(self.known) > self.most:  # a bound on memory; what is gone is encoded anew
            self.clear()
        new = list(dict.fromkeys(k for k in keys if k not in self.known))
        if new:
            ids, counts = self.encode_words([k.decode("utf-32-le") for k in new])
            base = len(self.at)
            self.at = np.append(self.at, len(self.ids) + np.cumsum(counts) - counts)
            self.length = np.append(self.length, counts)
            self.ids = np.append(self.ids, ids.astype(np.int32))
            self.known.update(zip(new, range(base, base + len(new))))
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after the other, and how many each text has."""
        segments, row, fixed = [], [], []
        for i, text in enumerate(texts):
            if self.cut and any(x in text for x in self.added):
                for part in self.cut.split(text):
                    segments.append("" if part in self.added else normal(part))
                    fixed.append(self.added.get(part, -1))
                    row.append(i)
            else:
                segments.append(normal(text))
                fixed.append(-1)
                row.append(i)
        codes, starts, ends, segment = split(segments)
        raw = codes.tobytes()
        hashes = A.mixed(A.range_hash(A.prefix_hash(A.mixed(codes.astype(np.uint64) + np.uint64(1))), starts, ends) + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        size = ends - starts
        same = bool(np.array_equal(size, size[first][inverse]) and np.array_equal(codes[A.ranges(starts, size)], codes[A.ranges(starts[first][inverse], size)]))
        if not same:  # two words with one hash: each word by itself
            first = inverse = np.arange(len(starts))
        place = self.learn([raw[4 * a : 4 * b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])[inverse]
        count = self.length[place]
        ids = self.ids[A.ranges(self.at[place], count)]
        per_segment = np.bincount(segment, weights=count, minlength=len(segments)).astype(np.int64)
        extra = np.array(fixed, np.int64) >= 0
        if extra.any():
            ids = np.insert(ids, np.cumsum(per_segment)[extra] - per_segment[extra], np.array(fixed)[extra])
            per_segment[extra] = 1
        return ids, np.bincount(np.array(row, np.int64), weights=per_segment, minlength=len(texts)).astype(np.int64)
