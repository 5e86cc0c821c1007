"""Queries of data quality."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import quality as Q
from ..operators import similarity as M
from .registry import query

_FIELDS = {"lang": "lang", "source": "source", "long": "CASE WHEN n_chars > 2000 THEN 'long' WHEN n_chars < 200 THEN '' END"}
_LONG = "SELECT doc_id, unnest([" + ", ".join(f"{{'field': '{k}', 'value': {v}}}" for k, v in _FIELDS.items()) + "], recursive := true) FROM documents"


def fields(t):
    long = F.when(F.col("n_chars") > 2000, "long").when(F.col("n_chars") < 200, "")
    return Q.unpivoted(t.documents.select("doc_id", "lang", "source", long.alias("long")), "doc_id", ["lang", "source", "long"])


@query("payload_quality", f"WITH f AS ({_LONG}) SELECT field, count(*) AS total, round(100.0 * count(value) / count(*), 2) AS coverage, round(100.0 * count(*) FILTER (WHERE value IS NULL) / count(*), 2) AS null_pct, round(100.0 * count(*) FILTER (WHERE value = '') / count(*), 2) AS empty_pct, count(DISTINCT value) AS distinct_values FROM f GROUP BY 1")
def payload_quality(t):
    return Q.profile(fields(t))


@query("payload_top_values", f"WITH f AS ({_LONG}) SELECT field, value, n, pct FROM (SELECT field, value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY field), 2) AS pct, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS rn FROM f WHERE value IS NOT NULL GROUP BY 1, 2) WHERE rn <= 8")
def payload_top_values(t):
    return Q.top_values(fields(t), 8)


@query("vector_health", "WITH n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS norm, len(embedding) AS dim FROM embeddings) SELECT count(*) AS total, count(*) FILTER (WHERE norm IS NULL) AS missing, count(*) FILTER (WHERE dim <> 64) AS wrong_dim, count(*) FILTER (WHERE norm = 0) AS zero, round(quantile_cont(norm, 0.05), 6) AS p05, round(quantile_cont(norm, 0.25), 6) AS p25, round(quantile_cont(norm, 0.5), 6) AS p50, round(quantile_cont(norm, 0.75), 6) AS p75, round(quantile_cont(norm, 0.95), 6) AS p95 FROM n")
def vector_health(t):
    return Q.vector_profile(t.embeddings, "embedding", 64)


@query("consistency_check", "SELECT (SELECT count(*) FROM documents) AS rows, (SELECT count(*) FROM embeddings) AS vectors, abs((SELECT count(*) FROM documents) - (SELECT count(*) FROM embeddings)) AS gap")
def consistency_check(t):
    both = t.documents.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(t.embeddings.agg(F.count("*").alias("vectors"))))
    return both.withColumn("gap", F.abs(F.col("rows") - F.col("vectors")))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_NEAR = f"SELECT a.vec_id AS key, b.vec_id AS other, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"


@query("ann_precision_at_k", f"""WITH t AS (SELECT * FROM ({_NEAR}) WHERE rank <= 50 AND score > 0), e AS (SELECT key, list(other) AS a FROM t WHERE rank <= 10 GROUP BY 1),
n AS (SELECT key, list(other) AS b FROM (SELECT t.key, t.other, row_number() OVER (PARTITION BY key ORDER BY score DESC, other) AS r FROM t JOIN embeddings x ON x.vec_id = key JOIN embeddings y ON y.vec_id = other WHERE x.label = y.label) WHERE r <= 10 GROUP BY 1)
SELECT count(*) AS queries, round(avg(s), 4) AS mean, round(stddev_pop(s), 4) AS deviation FROM (SELECT len(list_intersect(a, coalesce(b, []))) / least(10, len(a)) AS s FROM e LEFT JOIN n USING (key))""")
def ann_precision_at_k(t):
    """Precision of nearest neighbours within a label against all neighbours."""
    exact = M.nearest(t.embeddings, "vec_id", "embedding", 10).groupBy("key").agg(F.collect_set("other").alias("a"))
    label = t.embeddings.select(F.col("vec_id").alias("key"), "label")
    near = M.nearest(t.embeddings, "vec_id", "embedding", 50).join(label, "key").join(label.select(F.col("key").alias("other"), F.col("label").alias("l2")), "other").where("label = l2")
    w = Window.partitionBy("key").orderBy(F.desc("score"), "other")
    found = near.withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy("key").agg(F.collect_set("other").alias("b"))
    return Q.precision(exact.join(found, "key", "left"), "a", "b", 10)


@query("type_conflicts", "SELECT 'k' AS field, CASE WHEN event_id % 100 = 0 THEN 'string' ELSE 'number' END AS kind, count(*) AS n FROM events GROUP BY 2")
def type_conflicts(t):
    raw = F.when(F.col("event_id") % 100 == 0, F.lit('{"k": "x"}')).otherwise(F.col("props"))
    kind = F.regexp_extract(F.schema_of_variant(F.variant_get(F.parse_json(raw), "$.k", "variant")), r"^\w+", 0)
    kinds = F.when(kind == "STRING", "string").when(kind.isin("BIGINT", "INT", "DOUBLE", "DECIMAL"), "number").otherwise(F.lower(kind))
    return t.events.groupBy(F.lit("k").alias("field"), kinds.alias("kind")).agg(F.count("*").alias("n"))


@query("snapshot_compare", "SELECT a.n AS before, b.n AS after, b.n - a.n AS added, round(100.0 * (b.n - a.n) / a.n, 2) AS pct FROM (SELECT count(*) AS n FROM orders WHERE o_orderdate < DATE '1998-01-01') a, (SELECT count(*) AS n FROM orders) b")
def snapshot_compare(t):
    old = t.orders.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("date")).agg(F.count("*").alias("before"))
    both = old.crossJoin(F.broadcast(t.orders.agg(F.count("*").alias("after"))))
    return both.withColumn("added", F.col("after") - F.col("before")).withColumn("pct", F.round(100.0 * F.col("added") / F.col("before"), 2))
