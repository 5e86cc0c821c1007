"""Queries of ranked search over documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explore as E
from ..operators import graph as G
from ..operators import search as S
from ..operators.substring_index import SubstringIndex
from ..operators.text_index import TextIndex
from ..sources.shared import new_folder
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
_INDEX = f"""idx AS (SELECT doc_id, field, term, count(*) AS tf FROM (SELECT doc_id, 'text' AS field, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS term FROM documents UNION ALL SELECT doc_id, 'source', unnest(regexp_extract_all(lower(source), '[a-z0-9]{{2,}}')) FROM documents) WHERE term NOT IN ({_STOP}) GROUP BY 1, 2, 3)"""
_KEYWORD = "kw AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT doc_id, field, count(*) AS n, sum(1 + ln(tf)) AS s FROM idx WHERE term IN ('thth', 'erer') GROUP BY 1, 2) WHERE n = 2 GROUP BY 1))"
#: The query vector: every coordinate alternates.
VECTOR = [1.0 if i % 2 else -0.5 for i in range(64)]
_COS = "list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END))"
_SEM = f"sem AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT vec_id AS doc_id, round({_COS}, 6) AS score FROM embeddings) QUALIFY rank <= 200)"
_FUSED = "f AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT doc_id, rank FROM kw UNION ALL SELECT doc_id, rank FROM sem) GROUP BY 1))"


def index(t):
    return S.inverted_index(t.documents.select("doc_id", "text", "source"), "doc_id", ["text", "source"])


def keyword(t, limit=2000):
    return S.keyword(index(t), "doc_id", "thth erer", limit)


def semantic(t):
    return S.semantic(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", F.col("embedding"), VECTOR)


@query("fts_index", f"WITH {_INDEX} SELECT doc_id, field, term, tf FROM idx")
def fts_index(t):
    return index(t)


@query("search_keyword", f"WITH {_INDEX}, {_KEYWORD} SELECT doc_id, score, rank::INT AS rank FROM kw WHERE rank <= 2000")
def search_keyword(t):
    return keyword(t)


@query("search_semantic", f"WITH {_SEM} SELECT doc_id, score, rank::INT AS rank FROM sem")
def search_semantic(t):
    return semantic(t)


def fused(t, limit=None):
    """Whole lists are fused: a row far down in one of them may be among the best of both."""
    return S.fuse([keyword(t, None), semantic(t)], "doc_id", limit)


@query("rrf_fuse", f"WITH {_INDEX}, {_KEYWORD}, {_SEM}, {_FUSED} SELECT doc_id, score, rank FROM f")
def rrf_fuse(t):
    return fused(t)


@query("search_hybrid", f"WITH {_INDEX}, {_KEYWORD}, {_SEM}, {_FUSED} SELECT f.doc_id, f.score, f.rank, d.lang FROM f JOIN documents d ON d.doc_id = f.doc_id WHERE d.lang = 'en'")
def search_hybrid(t):
    return fused(t).join(t.documents.where("lang = 'en'").select("doc_id", "lang"), "doc_id").orderBy("rank")


@query("search_hydrated", f"WITH {_INDEX}, {_KEYWORD}, {_SEM}, {_FUSED} SELECT f.doc_id, f.rank, d.source, d.n_chars, l.quality, coalesce(l.toxic, 0)::INT AS toxic FROM f JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id) WHERE f.rank <= 50")
def search_hydrated(t):
    top = fused(t, 50)
    out = top.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id").join(t.labels, "doc_id", "left")
    return out.select("doc_id", "rank", "source", "n_chars", "quality", F.coalesce("toxic", F.lit(0)).alias("toxic")).orderBy("rank")


@query("search_by_id", "SELECT o_orderkey AS id, 1.0::DOUBLE AS score FROM orders WHERE CAST(o_orderkey AS VARCHAR) LIKE '12%' ORDER BY 1 LIMIT 500")
def search_by_id(t):
    return S.by_id(t.control.select("id"), "id", "12")


@query("similar_by_id", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 5) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q WHERE vec_id <> 5 ORDER BY score DESC, vec_id LIMIT 20")
def similar_by_id(t):
    own = t.embeddings.where("vec_id = 5").select(F.col("embedding").alias("_q"))
    near = t.embeddings.where("vec_id <> 5").crossJoin(F.broadcast(own))  # one stored vector
    return near.select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("_q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query("entity_detail", "SELECT c.id, c.status, c.level, c.price, e.c_what, e.c_evidence FROM v_control c LEFT JOIN v_criteria e ON e.id = c.id WHERE c.id = 123")
def entity_detail(t):
    return E.detail(t.control, t.criteria, [123], ["status", "level", "price"], ["c_what", "c_evidence"])


@query("entity_brief", "SELECT id, status, price FROM v_control WHERE id IN (1, 5, 9, 42, 77)")
def entity_brief(t):
    return E.brief(t.control, [1, 5, 9, 42, 77], ["status", "price"])


_DOCS = "SELECT doc_id, score, snippet FROM (SELECT doc_id, (CASE WHEN contains(lower(source), 'src1') THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(text), 'src1') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(source), 'the') THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 1.0 ELSE 0 END)::DOUBLE AS score, substr(text, greatest(instr(lower(text), 'src1') - 20, 1), 60) AS snippet FROM documents WHERE (contains(lower(source), 'src1') OR contains(lower(text), 'src1')) AND (contains(lower(source), 'the') OR contains(lower(text), 'the'))) ORDER BY score DESC, doc_id LIMIT 20"


@query("docs_search", _DOCS)
def docs_search(t):
    return S.weighted_contains(t.documents, "doc_id", {"source": 3.0, "text": 1.0}, "src1 the")


@query("search_in_facet", f"WITH {_INDEX}, {_KEYWORD} SELECT doc_id, score FROM kw WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en')")
def search_in_facet(t):
    good = t.labels.where("quality = 1").select(F.col("doc_id").alias("id"))
    english = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("id"))
    inside = G.all_of(good, english).withColumnRenamed("id", "doc_id")
    return S.keyword(index(t), "doc_id", "thth erer", None, inside).select("doc_id", "score")


def english(t):
    return t.documents.where("lang = 'en'").select("doc_id")


_ENGLISH = "(SELECT doc_id FROM documents WHERE lang = 'en')"
_RANKED = "SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM"


@query("search_keyword_candidates", f"WITH {_INDEX}, {_KEYWORD} SELECT doc_id, score, rank FROM ({_RANKED} (SELECT doc_id, score FROM kw WHERE doc_id IN {_ENGLISH})) WHERE rank <= 5")
def search_keyword_candidates(t):
    """A limit that bites: the five best of the candidates."""
    return S.keyword(index(t), "doc_id", "thth erer", 5, english(t))


_OWN_COS = f"SELECT vec_id AS doc_id, round({_COS}, 6) AS score FROM embeddings WHERE vec_id IN {_ENGLISH}"


@query("search_semantic_candidates", f"SELECT doc_id, score, rank FROM ({_RANKED} ({_OWN_COS})) WHERE rank <= 20")
def search_semantic_candidates(t):
    """The twenty nearest of the candidates, which needn't be among the twenty nearest of all."""
    vectors = t.embeddings.withColumnRenamed("vec_id", "doc_id")
    return S.semantic(vectors, "doc_id", F.col("embedding"), VECTOR, 20, english(t))


PARTS = {"what": (1, 21), "why": (22, 42), "where": (43, 63)}


def named(part):
    lo, hi = PARTS[part]
    return F.slice("embedding", lo, hi - lo + 1)


def _named_sql(part, where="TRUE"):
    lo, hi = PARTS[part]
    own = f"list_transform(range({lo - 1}, {hi}), lambda i: CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END)"
    return f"SELECT doc_id, rank FROM ({_RANKED} (SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding[{lo}:{hi}]::DOUBLE[], {own}), 6) AS score FROM embeddings WHERE {where})) WHERE rank <= 200"


def _fused_sql(lists):
    every = " UNION ALL ".join(lists)
    return f"{_RANKED} (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM ({every}) GROUP BY 1)"


def _by_part(t, parts, candidates=None):
    vectors = t.embeddings.withColumnRenamed("vec_id", "doc_id")
    return S.semantic_named(vectors, "doc_id", {p: named(p) for p in PARTS}, {p: VECTOR[PARTS[p][0] - 1 : PARTS[p][1]] for p in parts}, candidates=candidates)


@query("search_semantic_named", f"SELECT * FROM ({_fused_sql([_named_sql(p) for p in PARTS])}) WHERE rank <= 2000")
def search_semantic_named(t):
    return _by_part(t, PARTS)


_HYBRID = f"""WITH {_INDEX}, {_KEYWORD}, own AS (SELECT doc_id, rank FROM ({_RANKED} (SELECT doc_id, score FROM kw WHERE doc_id IN {_ENGLISH})) WHERE rank <= 2000),
vec AS (SELECT doc_id, rank FROM ({_fused_sql([_named_sql(p, f"vec_id IN {_ENGLISH}") for p in ("what", "why")])}))"""


@query("search_hybrid_candidates", f"{_HYBRID} SELECT * FROM ({_fused_sql(['SELECT doc_id, rank FROM own', 'SELECT doc_id, rank FROM vec'])}) WHERE rank <= 2000")
def search_hybrid_candidates(t):
    """Both lists are of candidates before they are cut and fused."""
    vectors = t.embeddings.withColumnRenamed("vec_id", "doc_id")
    vector = {p: VECTOR[PARTS[p][0] - 1 : PARTS[p][1]] for p in ("what", "why")}
    return S.hybrid(index(t), vectors, "doc_id", "thth erer", {p: named(p) for p in PARTS}, vector, english(t))


def kept_index(t):
    return TextIndex.build(t.documents.select("doc_id", "text", "source"), "doc_id", ["text", "source"], new_folder(t.spark, "text-index"))


def updated_index(t):
    """An index of other texts (every seventh one missing, every eleventh one another's) that is brought up to date, a stranger taken out."""
    docs = t.documents.select("doc_id", "text", "source")
    old = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.lit("thth erer thth")).otherwise(F.col("text")))
    stranger = docs.select(F.lit(-5).cast("long").alias("doc_id"), F.lit("erer thth").alias("text"), F.lit("none").alias("source")).limit(1)
    index = TextIndex.build(old.unionByName(stranger), "doc_id", ["text", "source"], new_folder(t.spark, "text-index"))
    index.update(docs.where("doc_id % 7 = 0"), "doc_id")
    index.update(docs.where("doc_id % 11 = 0"), "doc_id", stranger.select("doc_id"))
    return index


@query("search_kept_index", f"WITH {_INDEX}, {_KEYWORD} SELECT doc_id, score, rank::INT AS rank FROM kw WHERE rank <= 2000")
def search_kept_index(t):
    """Keyword search that reads its terms' postings of a kept index alone."""
    return kept_index(t).search("thth erer", key="doc_id")[0]


@query("search_kept_top", f"WITH {_INDEX}, {_KEYWORD} SELECT doc_id, score, rank FROM ({_RANKED} (SELECT doc_id, round(2.5::DOUBLE * score, 6) AS score FROM (SELECT doc_id, sum(s) AS score FROM (SELECT doc_id, field, count(*) AS n, sum(1 + ln(tf)) AS s FROM idx WHERE term IN ('thth', 'erer') GROUP BY 1, 2) WHERE n = 2 AND field = 'text' GROUP BY 1) WHERE doc_id IN {_ENGLISH})) WHERE rank <= 10")
def search_kept_top(t):
    """The ten best of the candidates by weighted fields: blocks whose bound is too low aren't read."""
    return kept_index(t).search("thth erer", 10, {"text": 2.5, "source": 1.0}, english(t), "doc_id")[0]


@query("search_updated_index", f"WITH {_INDEX} SELECT doc_id, field, term, tf FROM idx")
def search_updated_index(t):
    """What counts in an index after two updates: the same as in one made anew."""
    return updated_index(t).postings().withColumnRenamed("key", "doc_id")


@query("search_updated_top", f"WITH {_INDEX}, {_KEYWORD} SELECT doc_id, score, rank::INT AS rank FROM kw WHERE rank <= 10")
def search_updated_top(t):
    return updated_index(t).search("thth erer", 10, key="doc_id")[0]


def substring_index(t):
    return SubstringIndex.build(t.documents.select("doc_id", "text", "source"), "doc_id", ["text", "source"], new_folder(t.spark, "substring-index"))


@query("docs_search_indexed", _DOCS)
def docs_search_indexed(t):
    """Documents are ranked among those with all trigrams of each word."""
    return S.weighted_contains(substring_index(t).all_words(["src1", "the"]), "doc_id", {"source": 3.0, "text": 1.0}, "src1 the")


@query("docs_like", "SELECT doc_id FROM documents WHERE text ILIKE '%thth_ing%the%' OR source ILIKE '%rc1_'")
def docs_like(t):
    return substring_index(t).like({"%thth_ing%the%": ["text"], "%rc1_": ["source"]}).select("doc_id")
