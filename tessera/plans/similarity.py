"""Queries of similar pairs: documents by terms, vectors in three named parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import similarity as M
from ..operators import vector_index as V
from ..sources.shared import new_folder, saved, written
from .registry import query

_TF = "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}')) AS term FROM documents) GROUP BY 1, 2), voc AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 10000), raw AS (SELECT doc_id, tf.term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN voc ON voc.term = tf.term), wt AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"


def weights(t):
    return M.term_weights(t.documents.select("doc_id", "text"), "doc_id", "text")


@query("tfidf_weights", f"WITH {_TF} SELECT doc_id, term, round(weight, 6) AS weight FROM wt")
def tfidf_weights(t):
    return weights(t).withColumn("weight", F.round("weight", 6))


@query("tfidf_cosine", f"WITH {_TF}, p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM labels a JOIN labels b ON b.doc_id > a.doc_id AND b.doc_id <= a.doc_id + 8) SELECT p.a, p.b, round(coalesce(sum(x.weight * y.weight), 0), 6) + 0.0 AS cosine FROM p LEFT JOIN wt x ON x.doc_id = p.a LEFT JOIN wt y ON y.doc_id = p.b AND y.term = x.term GROUP BY 1, 2")
def tfidf_cosine(t):
    ids = t.labels.select("doc_id")
    pairs = ids.select(F.col("doc_id").alias("a"), F.explode(F.sequence(F.col("doc_id") + 1, F.col("doc_id") + 8)).alias("b")).join(ids.select(F.col("doc_id").alias("b")), "b")
    return M.pair_cosine(M.term_vectors(t.documents, "doc_id", "text", only=ids), pairs.select("a", "b"), "doc_id", "a", "b").withColumn("cosine", F.round("cosine", 6) + 0.0)


@query("vector_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS norm, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) > 0.01 AS valid FROM embeddings")
def vector_normalize(t):
    return M.normalise(t.embeddings, "embedding").select("vec_id", F.round("norm", 6).alias("norm"), "valid")


PARTS = {"what": (1, 21), "why": (22, 42), "where": (43, 63)}


def _cos(a, b, part):
    lo, hi = PARTS[part]
    return f"list_cosine_similarity({a}.embedding[{lo}:{hi}]::DOUBLE[], {b}.embedding[{lo}:{hi}]::DOUBLE[])"


_TOP = "SELECT a.vec_id AS key, b.vec_id AS other, round({c}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({c}, 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"


@query("vector_topk", f"SELECT key, other, score, rank::INT AS rank FROM ({_TOP.format(c='list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])')}) WHERE rank <= 10 AND score > 0")
def vector_topk(t):
    return M.nearest(t.embeddings, "vec_id", "embedding", 10)


def candidates(vectors, lists=None):
    """Pairs of each part's 50 nearest."""
    near = lists or [M.nearest(vectors, "vec_id", "embedding", 50, first=lo, last=hi) for lo, hi in PARTS.values()]
    return reduce(lambda a, b: a.union(b), [x.select("key", "other") for x in near]).distinct()


def pair_scores(vectors, pairs):
    """Scores of pairs; the second signal is the vectors' whole cosine."""
    each = M.pair_values(pairs, vectors, "vec_id", "embedding", [*PARTS.values(), (1, 64)])
    return each.select("key", "other", M.pair_score([(F.get("c", F.lit(i)), F.get("c", F.lit(len(PARTS)))) for i in range(len(PARTS))]).alias("score"))


def scored(t):
    return pair_scores(t.embeddings, candidates(t.embeddings))


#: The table's vectors are spread out: categories begin lower than the defaults.
CLOSE, LOOSE = 0.40, 0.25


_SCORED = "cand AS (" + " UNION ".join(f"SELECT key, other FROM ({_TOP.format(c=_cos('a', 'b', p))}) WHERE rank <= 50 AND score > 0" for p in PARTS) + "), sc AS (SELECT key, other, round((" + " + ".join(f"(least(greatest({_cos('a', 'b', p)}, 0), 1) + least(greatest(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 1)) / 2" for p in PARTS) + ") / 3, 4) AS score FROM cand JOIN embeddings a ON a.vec_id = key JOIN embeddings b ON b.vec_id = other)"


@query("pair_score", f"WITH {_SCORED} SELECT key, other, score FROM sc")
def pair_score(t):
    return scored(t)


_TOP3 = "top3 AS (SELECT * FROM (SELECT key, other, score, CASE WHEN score >= 0.4 THEN 'near_duplicate' ELSE 'weak_similar' END AS category, row_number() OVER (PARTITION BY key ORDER BY score DESC, other)::INT AS rank FROM sc WHERE score >= 0.25) WHERE rank <= 3)"


@query("similar_topk", f"WITH {_SCORED}, {_TOP3} SELECT * FROM top3")
def similar_topk(t):
    return M.top_pairs(scored(t), "key", "other", near=CLOSE, weak=LOOSE)


@query("similar_incremental", f"WITH {_SCORED}, {_TOP3} SELECT * FROM top3")
def similar_incremental(t):
    """Lists and pairs from before the rows with label 3 came, brought up to date: the same as a full rebuild.

    Only changed vectors, and those whose lists they touch, are compared and scored again.
    """
    changed = t.embeddings.where("label = 3").select("vec_id")
    before = t.embeddings.where("label <> 3")
    old = [saved(M.nearest(before, "vec_id", "embedding", 50, first=lo, last=hi)) for lo, hi in PARTS.values()]
    kept = M.top_pairs(pair_scores(before, candidates(before, old)), "key", "other", near=CLOSE, weak=LOOSE)
    new, touched = zip(*(M.updated_nearest(x, t.embeddings, changed, "vec_id", "embedding", 50, first=lo, last=hi) for x, (lo, hi) in zip(old, PARTS.values())))
    touched = saved(reduce(lambda a, b: a.union(b), touched).distinct())
    pairs = candidates(t.embeddings, new).join(touched, "key", "left_semi")
    fresh = M.top_pairs(pair_scores(t.embeddings, pairs), "key", "other", near=CLOSE, weak=LOOSE)
    return kept.join(touched, "key", "left_anti").select(fresh.columns).unionByName(fresh)


@query("kth_threshold", f"WITH {_SCORED}, {_TOP3} SELECT e.vec_id AS key, CASE WHEN count(t.other) = 3 THEN min(t.score) ELSE 0 END AS threshold FROM embeddings e LEFT JOIN top3 t ON t.key = e.vec_id GROUP BY 1")
def kth_threshold(t):
    top = M.top_pairs(scored(t), "key", "other", near=CLOSE, weak=LOOSE).groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("m"))
    return t.embeddings.select(F.col("vec_id").alias("key")).join(top, "key", "left").select("key", F.when(F.col("n") == 3, F.col("m")).otherwise(0.0).alias("threshold"))


@query("matrix_pairs", "WITH s AS (SELECT * FROM embeddings ORDER BY vec_id LIMIT 100) SELECT * FROM (SELECT a.vec_id AS key, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id)::INT AS rank FROM s a JOIN s b ON a.vec_id <> b.vec_id) WHERE rank <= 5 AND score > 0")
def matrix_pairs(t):
    return M.nearest(t.embeddings.orderBy("vec_id").limit(100), "vec_id", "embedding", 5)


@query("similarity_mst")
def similarity_mst(t):
    pairs = M.nearest(t.embeddings, "vec_id", "embedding", 3).select(F.col("key").alias("a"), F.col("other").alias("b"), "score")
    return M.spanning_forest(pairs)


_FOLDED = _TF.replace("lower(coalesce(text, ''))", "lower(strip_accents(coalesce(text, '')))")


@query("tfidf_weights_folded", f"WITH {_FOLDED} SELECT doc_id, term, round(weight, 6) AS weight FROM wt")
def tfidf_weights_folded(t):
    """Accents are taken off before texts are split."""
    return folded_weights(t).withColumn("weight", F.round("weight", 6))


def folded_weights(t):
    return M.term_weights(t.documents.select("doc_id", "text"), "doc_id", "text", fold=True)


_CANDIDATES = _SCORED.split(", sc AS")[0]
_TEXT_SCORE = " + ".join(f"(least(greatest({_cos('a', 'b', p)}, 0), 1) + least(greatest(coalesce(x.cosine, 0), 0), 1)) / 2" for p in PARTS)


# the pairs meet their terms in two written steps, so that no plan joins all texts of a term first
@query("pair_score_text", f"""WITH {_FOLDED}, {_CANDIDATES},
own AS MATERIALIZED (SELECT doc_id, term, weight FROM wt),
half AS MATERIALIZED (SELECT c.key, c.other, x.term, x.weight FROM cand c JOIN own x ON x.doc_id = c.key),
cs AS (SELECT x.key, x.other, sum(x.weight * y.weight) AS cosine FROM half x JOIN own y ON y.doc_id = x.other AND y.term = x.term GROUP BY 1, 2)
SELECT c.key, c.other, round(({_TEXT_SCORE}) / 3, 4) AS score FROM cand c JOIN embeddings a ON a.vec_id = c.key JOIN embeddings b ON b.vec_id = c.other LEFT JOIN cs x ON x.key = c.key AND x.other = c.other""")
def pair_score_text(t):
    """Each feature's two signals: its vectors' cosine, and that of the texts' term weights."""
    values = written(M.pair_values(candidates(t.embeddings), t.embeddings, "vec_id", "embedding", [*PARTS.values()]))
    asked = t.embeddings.select(F.col("vec_id").alias("doc_id"))
    each = M.pair_cosine(M.term_vectors(t.documents, "doc_id", "text", fold=True, only=asked), values, "doc_id", "key", "other")
    return each.select("key", "other", M.pair_score([(F.get("c", F.lit(i)), F.col("cosine")) for i in range(len(PARTS))]).alias("score"))


@query("similar_rescan", f"""SELECT key, other, score, rank::INT AS rank FROM (SELECT a.vec_id AS key, b.vec_id AS other, round(({" + ".join(_cos("a", "b", p) for p in PARTS)}) / 3, 6) AS score,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(({" + ".join(_cos("a", "b", p) for p in PARTS)}) / 3, 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.label = 3) WHERE rank <= 30 AND score > 0""")
def similar_rescan(t):
    """The thirty candidates of some keys by the mean of all parts' cosines."""
    return M.rescanned(t.embeddings, "vec_id", "embedding", list(PARTS.values()), t.embeddings.where("label = 3").select("vec_id"), 30)


ASKED = "vec_id % 50 = 0"
_ASKED_TOP = f"SELECT key, other, score, rank::INT AS rank FROM ({_TOP.format(c='list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])')} WHERE a.{ASKED}) WHERE rank <= 10 AND score > 0"


def vector_index(t, lists=None):
    return V.build(t.embeddings, "vec_id", "embedding", new_folder(t.spark, "vector-index"), lists)


@query("vector_index_all_lists", _ASKED_TOP)
def vector_index_all_lists(t):
    """A search of the kept index that leaves no list out and ranks every code exactly: the same as brute force."""
    index, n = vector_index(t), t.embeddings.count()
    return index.search(t.embeddings.where(ASKED), "vec_id", "embedding", 10, probe=V.LISTS, short=n)


@query("vector_index_recall", f"SELECT count(DISTINCT key) AS queries, TRUE AS reached FROM ({_ASKED_TOP})")
def vector_index_recall(t):
    """Whether the kept index, with the probes that it chose, finds nine of ten exact neighbours."""
    index, asked = vector_index(t), t.embeddings.where(ASKED)
    exact = M.nearest(t.embeddings, "vec_id", "embedding", 10, asked=asked.select("vec_id"))
    return V.recall(index.search(asked, "vec_id", "embedding", 10), exact).select("queries", (F.col("recall") >= 0.9).alias("reached"))


@query("vector_knn_pruned", f"SELECT key, other, score, rank::INT AS rank FROM ({_TOP.format(c='list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])')}) WHERE rank <= 10 AND score > 0")
def vector_knn_pruned(t):
    """All vectors' ten nearest, exactly: a block goes only where it may hold a better neighbour."""
    return vector_index(t).pruned_nearest(t.embeddings, "vec_id", "embedding", 10)[0]
