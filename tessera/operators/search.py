"""Ranked search: inverted index, keyword, vector and fused ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.readers import numbered

#: Words that an index leaves out.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with")
RRF_K = 60


def inverted_index(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, field, term, tf."""
    each = rows.select(key, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), X.tokens(F.col(f), STOP_WORDS).alias("terms")) for f in fields))))
    return each.select(key, "field", F.explode("terms").alias("term")).groupBy(key, "field", "term").agg(F.count("*").alias("tf"))


def among(rows: DataFrame, key: str, candidates: DataFrame | None) -> DataFrame:
    """rows whose key candidates (a table with that column) hold; all rows where there are none."""
    return rows if candidates is None else rows.join(candidates.select(key), key, "left_semi")


def keyword(index: DataFrame, key: str, query: str, limit: int | None = 2000, candidates: DataFrame | None = None) -> DataFrame:
    """key, score, rank of the rows with all terms of the query in one field; score: sum of 1 + ln(tf) over those fields.

    Only candidates are ranked, so that the limit never leaves one out for a row that isn't.
    """
    terms = sorted(set(query.lower().split()) - set(STOP_WORDS))
    index = among(index, key, candidates)
    hits = index.where(F.col("term").isin(*terms)).groupBy(key, "field").agg(F.count("*").alias("n"), F.sum(1 + F.log("tf")).alias("s"))
    scored = hits.where(F.col("n") == len(terms)).groupBy(key).agg(F.round(F.sum("s"), 6).alias("score"))
    return ranked(scored, key, limit)


def ranked(scored: DataFrame, key: str, limit: int | None) -> DataFrame:
    """The best ``limit`` rows with their rank, from 1; ties by key. Without a limit all rows are numbered, range by range."""
    if limit is None:
        every = numbered(scored, F.desc("score"), F.asc(key))
        return every.withColumn("rank", (F.col("position") + 1).cast("int")).drop("position")
    top = scored.orderBy(F.desc("score"), key).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def semantic(vectors: DataFrame, key: str, column: Column, query: Sequence[float], limit: int = 200, candidates: DataFrame | None = None) -> DataFrame:
    """key, score, rank of the nearest vectors by cosine, among the candidates where given."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    vectors = among(vectors, key, candidates)
    return ranked(vectors.select(key, F.round(cosine(column, literal), 6).alias("score")), key, limit)


def semantic_named(
    vectors: DataFrame, key: str, columns: dict[str, Column], query: dict[str, Sequence[float]], limit: int = 200, candidates: DataFrame | None = None
) -> DataFrame:
    """key, score, rank: the nearest by each named vector that the query has one for, fused by rank."""
    return fuse([semantic(vectors, key, columns[name], query[name], limit, candidates) for name in columns if name in query], key)


def hybrid(
    index: DataFrame, vectors: DataFrame, key: str, query: str, columns: dict[str, Column], vector: dict[str, Sequence[float]] | None, candidates: DataFrame | None = None
) -> DataFrame:
    """Keyword and semantic search fused by rank; keyword search alone without a query vector."""
    found = keyword(index, key, query, candidates=candidates)
    return found if vector is None else fuse([found, semantic_named(vectors, key, columns, vector, candidates=candidates)], key)


def fuse(lists: Sequence[DataFrame], key: str, limit: int | None = 2000) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (RRF_K + rank) over the lists."""
    out = lists[0].select(key, "rank")
    for x in lists[1:]:
        out = out.unionAll(x.select(key, "rank"))
    return ranked(out.groupBy(key).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 8).alias("score")), key, limit)


def by_id(rows: DataFrame, key: str, prefix: str, limit: int = 500) -> DataFrame:
    """Ids that begin with a text, in any case, in order."""
    return rows.where(F.lower(F.col(key).cast("string")).startswith(prefix.lower())).orderBy(key).limit(limit).withColumn("score", F.lit(1.0))


def weighted_contains(rows: DataFrame, key: str, weights: dict[str, float], query: str, limit: int = 20) -> DataFrame:
    """Rows that hold every word in some column; score: the weights of the columns that hold each word; a snippet around the first."""
    words = query.lower().split()
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in weights}
    every, score = F.lit(True), F.lit(0.0)
    for w in words:
        hit = F.lit(False)
        for c, weight in weights.items():
            hit = hit | low[c].contains(w)
            score = score + F.when(low[c].contains(w), F.lit(weight)).otherwise(0.0)
        every = every & hit
    body = list(weights)[-1]
    start = F.greatest(F.instr(low[body], words[0]) - 20, F.lit(1))
    return rows.where(every).select(key, score.alias("score"), F.substring(F.col(body), start, F.lit(60)).alias("snippet")).orderBy(F.desc("score"), key).limit(limit)


def mode(query: str) -> str:
    """The search that a query without a mode gets: by id if it looks like one."""
    return "id" if query.upper().startswith(("CTL-", "CTL_", "CTRL-", "CTRL_")) else "hybrid"
