"""License scans: lines and whole texts against licence notices by Dice coefficient.

Texts are normalised (lower case; only letters, digits and dots stay), cut into
words, and compared with each notice by the Dice coefficient of their sets of
word bigrams.  Size bounds leave few notices to compare: a Dice coefficient of t
with a notice of b bigrams needs between t / (2 - t) * b and (2 - t) / t * b
bigrams, and t / 2 of the segment's own must occur in some notice.  The notices
are literals of fixed size inside the expressions.  DataFrame functions only.

``license_windows`` looks for licence paragraphs, and for notices inside longer lines
or wrapped over lines: windows of as many words as a template has, each beginning
with one of its bigrams, in texts that hold enough of the template's bigrams at all.

Results for odd input: null and empty texts, and segments of one word, have no
bigrams and match nothing; repeated lines and rows each match; a segment's ties
go to the first notice by name; a null id is kept; very long texts are taken whole; an
empty table gives an empty one; other columns are left out, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The notices of public licences.
NOTICES = {
    "agpl-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "bsd-3-clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "lgpl-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "mpl-2.0": ["This work is subject to the terms of the Mozilla Public License, version 2.0."],
}
#: The first paragraphs of licence texts and the usual file headers, for windows.
PARAGRAPHS = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd-3-clause": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
LEAST = 0.8
JUNK = r"[^a-z0-9.]+"


def words_of(text: str) -> list[str]:
    """The words of a notice, by the rules that segments follow."""
    return [w for w in (x.strip(".") for x in re.sub(JUNK, " ", text.lower()).split(" ")) if w]


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def segment_words(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(F.lower(text), JUNK, " "), " "), lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, list[str]] = NOTICES, least: float = LEAST) -> DataFrame:
    """doc_id, segment (0 the whole text, from 1 its lines), license and dice of each segment that some notice matches best."""
    shapes = sorted((name, bigrams_of(text)) for name, texts in notices.items() for text in texts)
    known = sorted({g for _, grams in shapes for g in grams})
    low, high = min(len(g) for _, g in shapes) * least / (2 - least), max(len(g) for _, g in shapes) * (2 - least) / least
    text = F.coalesce(F.col(text_col), F.lit(""))
    segments = df.select(F.col(id_col).alias("doc_id"), F.split(text, "\n").alias("_lines"), text.alias("_text"))
    segments = segments.select("doc_id", F.posexplode(F.concat(F.array(F.col("_text")), F.when(F.size("_lines") > 1, F.col("_lines")).otherwise(F.array().cast("array<string>")))).alias("segment", "s"))

    def grams(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))))

    def best(g: Column) -> Column:
        entries = []
        for name, own in shapes:
            fits = (F.size(g) >= len(own) * least / (2 - least)) & (F.size(g) <= len(own) * (2 - least) / least)
            score = F.round(2.0 * F.size(F.array_intersect(g, F.array(*map(F.lit, own)))) / (F.size(g) + len(own)), 4)
            entries.append(F.struct(F.when(fits, -score).otherwise(F.lit(0.0)).alias("d"), F.lit(name).alias("n")))
        return F.least(*entries)

    # each step binds what it computes to a lambda's variable, so that nothing is computed twice; explode keeps what matches
    bags = F.transform(F.filter(F.array(segment_words(F.col("s"))), lambda w: F.size(w) >= 2), grams)
    near = F.filter(bags, lambda g: (F.size(g) >= low) & (F.size(g) <= high) & (F.size(F.filter(g, lambda x: x.isin(known))) >= F.size(g) * (least / 2)))
    found = F.filter(F.transform(near, best), lambda b: b["d"] <= -least)
    scored = segments.select("doc_id", "segment", F.explode(found).alias("b"))
    return scored.select("doc_id", "segment", F.col("b.n").alias("license"), (-F.col("b.d")).alias("dice"))


def license_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license, template (its number), start (word of the text, from 0), n_words and dice: for each template the first of its best windows, where that reaches least.

    templates: the paragraphs and the notices where none are given.  A window at the end of a text is shorter.
    """
    given = templates if templates is not None else {k: PARAGRAPHS.get(k, []) + NOTICES.get(k, []) for k in {**PARAGRAPHS, **NOTICES}}
    shapes = [(name, i, len(words_of(text)), bigrams_of(text)) for name in sorted(given) for i, text in enumerate(given[name])]
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def grams(w: Column) -> Column:
        """The bigrams of a text in order, none for a text of one word."""
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
        return F.when(F.size(w) >= 2, pairs).otherwise(F.array().cast("array<string>"))

    def best(g: Column, own: list[str], size: int) -> Column:
        literal = F.array(*map(F.lit, own))
        enough = F.size(F.array_intersect(g, literal)) >= len(own) * least / (2 - least)
        starts = F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(literal, x), i)), lambda i: i.isNotNull())
        dice = lambda part: F.round(2.0 * F.size(F.array_intersect(part, literal)) / (F.size(part) + len(own)), 4)
        scores = F.transform(starts, lambda i: F.struct((-dice(F.array_distinct(F.slice(g, i + 1, size - 1)))).alias("d"), i.alias("at"), F.least(F.size(g) - i + 1, F.lit(size)).alias("n")))
        return F.when(enough, F.array_min(scores))

    def found(g: Column) -> Column:
        entries = [F.struct(F.lit(name).alias("license"), F.lit(i).alias("template"), best(g, own, size).alias("b")) for name, i, size, own in shapes if own]
        return F.filter(F.array(*entries), lambda e: e["b"]["d"] <= -least)

    # each step binds what it computes to a lambda's variable, so that nothing is computed twice
    bags = F.transform(F.array(segment_words(F.col("_text"))), grams)
    hits = rows.select("doc_id", F.explode(F.flatten(F.transform(bags, found))).alias("e"))
    return hits.select("doc_id", "e.license", "e.template", F.col("e.b.at").cast("long").alias("start"), F.col("e.b.n").cast("long").alias("n_words"), (-F.col("e.b.d")).alias("dice"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    values = ", ".join(f"('{name}', [{', '.join(repr(g) for g in bigrams_of(text))}])" for name, texts in sorted(NOTICES.items()) for text in texts)
    return f"""
WITH notices AS (SELECT * FROM (VALUES {values}) v(license, own)),
s AS (SELECT doc_id, 0 AS segment, coalesce(text, '') AS s FROM documents
  UNION ALL SELECT doc_id, i AS segment, l AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE contains(text, chr(10)))),
w AS (SELECT doc_id, segment, list_filter(list_transform(string_split(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), ' '), lambda x: trim(x, '.')), lambda x: x <> '') AS w FROM s),
g AS (SELECT doc_id, segment, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) >= 2),
d AS (SELECT doc_id, segment, license, round(2.0 * len(list_intersect(g, own)) / (len(g) + len(own)), 4) AS dice FROM g, notices)
SELECT doc_id, segment::INT AS segment, license, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, segment ORDER BY dice DESC, license) AS rn FROM d WHERE dice >= {LEAST}) WHERE rn = 1
"""


ORACLE = _oracle()
