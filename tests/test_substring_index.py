"""Trigram postings against ILIKE over all rows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import substring_index
from tessera.operators.substring_index import SubstringIndex, pattern_grams

SCHEMA = "key string, name string, body string, other int"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(4)
    say = lambda k: "".join(rng.choice("abAB ß日😀%_\\") for _ in range(rng.randrange(k)))
    rows = [(f"k{i % 190}", say(9), say(30) if i % 7 else None, i) for i in range(200)] + [(None, "abab", "abab", 1), ("z", "50%_off\\now", "Straße 日本😀x", 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(substring_index, "BLOCK_ROWS", 8)
        return df, SubstringIndex.build(df, "key", ["name", "body"], f"file://{tmp_path_factory.mktemp('sub')}/i", 16)


@pytest.mark.parametrize("pattern", ["%aba%", "ab%", "%ab_b%", "%a_b_a%", "%", "", "%ß日%", "%日😀%", "50\\%\\_off%", "%\\\\now", "%STRASSE%", "%straße%", "%abab%bab%", "nothing here", "%日本😀X"])
def test_like(made, pattern):
    df, index = made
    asked = {pattern: ["name", "body"], "%bbb%": ["name"]}
    fits = F.col("name").ilike(pattern) | F.col("body").ilike(pattern) | F.col("name").ilike("%bbb%")
    want = df.where(F.col("key").isNotNull() & F.coalesce(fits, F.lit(False)))
    assert sorted(map(tuple, index.like(asked).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_pattern_grams():
    assert pattern_grams("%aBc%d_efg\\%h%") == ["abc", "efg", "fg%", "g%h"] and pattern_grams("a%b_c") == []


def test_reads_its_trigrams_and_blocks_alone(spark, made):
    df, index = made
    plan = index.postings(["aba"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"bucket#\d+ (IN|=)", plan) and re.search(r"PushedFilters: \[.*(EqualTo|In)\(gram", plan)
    found = index.candidates("%straße%")
    assert [r.key for r in found.collect()] == ["z"]
    plan = index.rows(found)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"_block#\d+ (IN|=)", plan)
    assert {r.key for r in index.all_words(["straße", "50%_"]).collect()} == {"z"} and index.all_words(["ab"]).count() == 201


def test_empty(spark, tmp_path):
    index = SubstringIndex.build(spark.createDataFrame([], SCHEMA), "key", ["name"], f"file://{tmp_path}/i")
    assert index.like({"%abc%": ["name"]}).count() == 0 == index.like({"%": ["name"]}).count()
