"""Queries of scans, sinks and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..sources import generators, shards, stores
from ..sources import readers as S
from .registry import query


@query("validate_records", r"""WITH r AS (SELECT o_orderkey AS id, concat('CTRL-', lpad(CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 50 = 0 THEN 9 ELSE 10 END, '0')) AS cid, o_orderkey % 20 <> 0 AS owned, o_totalprice FROM orders)
SELECT id, 'id' AS rule FROM r WHERE NOT regexp_matches(cid, '^CTRL-[0-9]{10}$') UNION ALL SELECT id, 'owner' FROM r WHERE NOT owned UNION ALL SELECT id, 'price' FROM r WHERE NOT o_totalprice > 20000""")
def validate_records(t):
    cid = F.concat(F.lit("CTRL-"), F.when(F.col("o_orderkey") % 50 == 0, F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).otherwise(F.lpad(F.col("o_orderkey").cast("string"), 10, "0")))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), cid.alias("cid"), (F.col("o_orderkey") % 20 != 0).alias("owned"), "o_totalprice")
    return I.violations(rows, "id", {"id": F.col("cid").rlike(r"^CTRL-[0-9]{10}$"), "owner": F.col("owned"), "price": F.col("o_totalprice") > 20000})


@query("validate_parents", "SELECT child_id, parent_id FROM v_parent WHERE parent_id NOT IN (SELECT id FROM v_control WHERE id % 15 <> 0)")
def validate_parents(t):
    return I.missing_references(t.parent, "parent_id", t.control.where("id % 15 <> 0"), "id").select("child_id", "parent_id")


@query("validate_duplicates", "SELECT c_name AS name, count(*) AS n FROM (SELECT c_name FROM customer UNION ALL SELECT c_name FROM customer WHERE c_custkey % 9 = 0) GROUP BY 1 HAVING count(*) > 1")
def validate_duplicates(t):
    rows = t.customer.select(F.col("c_name").alias("name"))
    return S.duplicates(rows.unionAll(t.customer.where("c_custkey % 9 = 0").select("c_name")), "name")


def _lists(t):
    x = F.struct(F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey")).alias("related_id"), F.col("l_linenumber").alias("line"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", x.alias("x")))).alias("s")).select("id", F.transform("s", lambda y: y["x"]).alias("related"))


@query("unlinked_split", "SELECT l_orderkey AS id, count(*) FILTER (WHERE l_suppkey % 10 <> 0) AS n_linked, count(*) FILTER (WHERE l_suppkey % 10 = 0) AS n_unlinked FROM lineitem GROUP BY 1")
def unlinked_split(t):
    return I.unlinked(_lists(t), "related", "related_id").select("id", F.size("linked").cast("long").alias("n_linked"), F.size("unlinked").cast("long").alias("n_unlinked"))


@query("edge_build", "SELECT DISTINCT l_orderkey AS id, l_suppkey AS target FROM lineitem WHERE l_suppkey % 10 <> 0")
def edge_build(t):
    return I.build_edges(_lists(t), "id", "related", "related_id").select("id", "target")


@query("payload_filter", """SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') = '42'""")
def payload_filter(t):
    return t.events.where(I.payload_filter("k:42", "props", "event_id")).select("event_id", "props")


@query("payload_filter_whole", """SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') = '42'""")
def payload_filter_whole(t):
    return t.events.where(I.payload_filter("k:42", "props", "event_id")).select("event_id", "props")


@query("last_wins", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def last_wins(t):
    return S.last_by_id(t.events.select("user_id", "event_id", "event_type", "value"), "user_id", F.col("event_id")).select("user_id", "event_type", "value")


@query("table_page", "SELECT * FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def table_page(t):
    return S.page(t.customer, ["c_custkey"], 3, 25)


@query("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 7")
def point_lookup(t):
    return S.point(t.orders, "o_orderkey", 7)


@query("sample_rows", "SELECT vec_id, label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 20")
def sample_rows(t):
    return S.scroll(t.embeddings.select("vec_id", "label"), "vec_id", limit=20, where=F.col("label") == 3)


@query("insert_ignore", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def insert_ignore(t):
    old = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return S.insert_ignore(old, t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name")), "c_custkey")


@query("upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN upper(c_name) WHEN c_custkey % 2 = 0 THEN c_name END AS c_name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upsert(t):
    old = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return S.upsert(old, t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.upper("c_name")).alias("c_name")), "c_custkey")


@query("vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 4) END AS norm2 FROM embeddings")
def vector_upsert(t):
    raw = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("v"))
    fixed = raw.withColumn("v", S.vector_or_zero("v", 64))
    return fixed.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 4).alias("norm2"))


@query("numbered_pool", "SELECT doc_id, (rn // 3)::BIGINT AS entity, (rn % 3)::BIGINT AS field FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)")
def numbered_pool(t):
    return S.numbered(t.documents.select("doc_id"), "doc_id").select("doc_id", F.floor(F.col("position") / 3).alias("entity"), (F.col("position") % 3).alias("field"))


@query("facet_counts", "SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 100")
def facet_counts(t):
    return S.facet_values(t.events, F.get_json_object("props", "$.k"))


@query("latest_date", "SELECT * FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def latest_date(t):
    dated = t.orders.withColumn("date", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return S.latest_partition(dated).drop("date")


RULES = I.RecordRules(
    key="control_id", pattern=r"^CTRL-[0-9]{10}$", parent="parent_control_id",
    fields={"control_id": "string", "parent_control_id": "string?", "sox_relevant": "boolean?", "admins": "strings", "admin_gpns": "strings", "related_functions": "entries"},
    nested={"related_functions": ["id", "comment"]}, parallel=[("admins", "admin_gpns")])


def _records(t):
    """A JSON line for each order, some of them wrong."""
    k = F.col("o_orderkey")
    number = lambda n: F.concat(F.lit("CTRL-"), F.lpad(n.cast("string"), 10, "0"))
    own = F.when(k % 50 == 0, F.concat(F.lit("CTRL-"), F.lpad(k.cast("string"), 9, "0"))).otherwise(number(k))
    parent = F.when(k % 5 != 0, F.concat(F.lit('"'), number(k - k % 5), F.lit('"'))).otherwise("null")
    value = F.concat(
        F.lit('{"control_id": "'), own, F.lit('", "parent_control_id": '), parent, F.lit(', "sox_relevant": '), F.when(k % 31 == 0, '"yes"').otherwise("true"),
        F.lit(', "admins": ["a"], "admin_gpns": '), F.when(k % 17 == 0, "[]").otherwise('["1"]'),
        F.lit(', "related_functions": [{"id": '), F.when(k % 13 == 0, "null").otherwise('"f"'), F.lit(', "comment": null}]}'))
    return t.orders.select(k.alias("line"), F.when(k % 101 == 0, "{").otherwise(value).alias("value"))


@query("record_rules", """WITH k AS (SELECT o_orderkey AS line FROM orders), g AS (SELECT * FROM k WHERE line % 101 <> 0)
SELECT line, 'json' AS rule, '' AS field FROM k WHERE line % 101 = 0 UNION ALL SELECT line, 'pattern', 'control_id' FROM g WHERE line % 50 = 0 UNION ALL SELECT line, 'type', 'sox_relevant' FROM g WHERE line % 31 = 0
UNION ALL SELECT line, 'parallel', 'admins' FROM g WHERE line % 17 = 0 UNION ALL SELECT line, 'entry', 'related_functions' FROM g WHERE line % 13 = 0
UNION ALL SELECT line, 'reference', 'parent_control_id' FROM g WHERE line % 5 <> 0 AND line - line % 5 NOT IN (SELECT line FROM g WHERE line % 50 <> 0)""")
def record_rules(t):
    return I.record_violations(_records(t), RULES).select("line", "rule", "field")


@query("generated_rows", """WITH u AS (SELECT i AS id, CAST(concat('0x', left(md5(concat_ws('|', CAST(i AS VARCHAR), 'level', '7')), 8)) AS BIGINT) / 4294967296.0 AS u, CAST(concat('0x', left(md5(concat_ws('|', CAST(i AS VARCHAR), 'status', '7')), 8)) AS BIGINT) / 4294967296.0 AS v FROM (SELECT c_custkey AS i FROM customer))
SELECT id, CASE WHEN u < 0.2 THEN 'Level 1' ELSE 'Level 2' END AS level, CASE WHEN v < 0.75 THEN 'Active' ELSE 'Expired' END AS status FROM u""")
def generated_rows(t):
    """Categories drawn for each customer."""
    return generators.labelled(t.customer.select(F.col("c_custkey").alias("id")), "id", {"level": {"Level 1": 1, "Level 2": 4}, "status": {"Active": 3, "Expired": 1}}, 7)


@query("vector_update", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0")
def vector_update(t):
    """Named fields of some rows change, and some rows go."""
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    new = rows.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit("x").alias("c_mktsegment"), F.array(F.lit("c_name")).alias("changed"))
    return S.delete_by_key(S.update_fields(rows, new, "c_custkey"), t.customer.where("c_custkey % 7 = 0"), "c_custkey")


@query("pool_fields", "SELECT CAST(rn // 3 AS BIGINT) AS entity, max(CASE WHEN rn % 3 = 0 THEN doc_id END) AS what, max(CASE WHEN rn % 3 = 1 THEN doc_id END) AS why, max(CASE WHEN rn % 3 = 2 THEN doc_id END) AS \"where\" FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) GROUP BY 1")
def pool_fields(t):
    return shards.scattered(S.numbered(t.documents.select("doc_id"), "doc_id"), ["what", "why", "where"], "doc_id")


@query("versions_compared", "SELECT count(a.o_orderkey) AS before, count(b.o_orderkey) AS after, count(*) FILTER (WHERE a.o_orderkey IS NULL) AS added, count(*) FILTER (WHERE b.o_orderkey IS NULL) AS removed, count(*) FILTER (WHERE a.s <> b.s) AS changed, count(*) FILTER (WHERE a.s = b.s) AS unchanged, round(100.0 * (count(b.o_orderkey) - count(a.o_orderkey)) / count(a.o_orderkey), 2) AS pct FROM (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 4 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 3 <> 0) b ON a.o_orderkey = b.o_orderkey")
def versions_compared(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    after = rows.where("o_orderkey % 3 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return stores.compare_versions(rows.where("o_orderkey % 4 <> 0"), after, "o_orderkey")
