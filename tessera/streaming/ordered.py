"""Uploads released in their order: each waits until the one before it is in.

An upload is a number (from 1), a reference to what was uploaded, and whether it was
discarded.  State by source holds the next number and those that wait, as references,
so it grows with gaps and not with data.  A discarded upload lets the next one through
and isn't released itself.  One that comes again, or has a number below the next one,
is dropped; of two with one number in one batch the least reference counts.  Rows
without a source or a number, and numbers below 1, are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELEASED = "source string, number long, ref string"
WAITING = "next long, numbers array<long>, refs array<string>, dropped array<boolean>"


def advanced(after: int, waiting: dict[int, tuple[str | None, bool]]) -> tuple[int, list[tuple[int, str | None]]]:
    """The next number, and what is released, once waiting (which it takes them out of) goes on from ``after``."""
    out = []
    while after in waiting:
        ref, discarded = waiting.pop(after)
        if not discarded:
            out.append((after, ref))
        after += 1
    return after, out


def _release(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    after, waiting = 1, {}
    if state.exists:
        after, numbers, refs, gone = state.get
        waiting = dict(zip(map(int, numbers), zip(refs, map(bool, gone))))
    known, fresh = set(waiting), {}
    for batch in batches:
        for number, ref, discarded in zip(batch["number"], batch["ref"], batch["discarded"]):
            if number >= after and number not in known:
                offered = (ref, bool(discarded))
                fresh[int(number)] = min(fresh.get(int(number), offered), offered, key=lambda x: (x[0] is None, x[0] or "", x[1]))
    after, out = advanced(int(after), waiting := waiting | fresh)
    held = sorted(waiting)
    state.update((after, held, [waiting[n][0] for n in held], [waiting[n][1] for n in held]))
    yield pd.DataFrame({"source": [key[0]] * len(out), "number": [n for n, _ in out], "ref": [r for _, r in out]}).astype({"source": object, "number": "int64", "ref": object})


def in_order(uploads: DataFrame) -> DataFrame:
    """source, number, ref of a stream of uploads (source, number, ref, discarded), none before its predecessor."""
    discarded = F.coalesce(F.col("discarded"), F.lit(False)).alias("discarded")
    own = uploads.where("source IS NOT NULL AND number >= 1").select("source", F.col("number").cast("long").alias("number"), "ref", discarded)
    return own.groupBy("source").applyInPandasWithState(_release, RELEASED, WAITING, "append", "NoTimeout")
