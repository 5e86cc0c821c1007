"""Queries of versioned rows: events are the versions of their user's state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity as M
from ..operators import temporal as T
from ..sources.shared import new_folder
from ..sources.table_store import TableStore
from .registry import query

AT, LATER = "2024-01-10 00:00:00", "2024-01-20 23:59:59"
STATE = ["state", "amount", "props"]


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def state_at(t, at):
    return T.as_of(t.version, stamp(at)).select("id", *STATE, "tx_from")


def _state_sql(at):
    return f"SELECT id, state, amount, props, tx_from FROM v_version WHERE tx_from <= TIMESTAMP '{at}' AND (tx_to IS NULL OR tx_to > TIMESTAMP '{at}')"


@query("temporal_current", "SELECT * FROM v_version WHERE tx_to IS NULL")
def temporal_current(t):
    return T.current(t.version)


@query("temporal_as_of", _state_sql(AT))
def temporal_as_of(t):
    return state_at(t, AT)


@query("version_list", "SELECT *, row_number() OVER (PARTITION BY id ORDER BY tx_from, event_id) AS version FROM v_version")
def version_list(t):
    return T.version_list(t.version, "id", ["tx_from", "event_id"])


@query("version_diff", f"WITH a AS ({_state_sql(AT)}), b AS ({_state_sql(LATER)}) " + " UNION ALL ".join(f"SELECT a.id, '{c}' AS field, a.{c} AS before, b.{c} AS after FROM a JOIN b ON a.id = b.id WHERE a.{c} IS DISTINCT FROM b.{c}" for c in ("state", "props")))
def version_diff(t):
    return T.version_diff(state_at(t, AT), state_at(t, LATER), "id", ["state", "props"])


DUMP = "SELECT id, state, amount, props FROM later WHERE id % 10 <> 3 UNION ALL SELECT id + 1000, state, amount, props FROM later WHERE id % 10 = 4"


def dump(t):
    """The later state as a full dump: some ids missing, some new."""
    later = state_at(t, LATER).drop("tx_from")
    return later.where(F.col("id") % 10 != 3).unionAll(later.where(F.col("id") % 10 == 4).withColumn("id", F.col("id") + 1000))


@query("delta_classify", f"WITH o AS ({_state_sql(AT)}), later AS ({_state_sql(LATER)}), n AS ({DUMP}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'disappeared' WHEN o.state IS DISTINCT FROM n.state OR o.amount IS DISTINCT FROM n.amount OR o.props IS DISTINCT FROM n.props THEN 'changed' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON o.id = n.id")
def delta_classify(t):
    return T.delta(state_at(t, AT).drop("tx_from"), dump(t), "id", STATE)


@query("delta_counts", f"WITH o AS ({_state_sql(AT)}), later AS ({_state_sql(LATER)}), n AS ({DUMP}) SELECT CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'disappeared' WHEN o.state IS DISTINCT FROM n.state OR o.amount IS DISTINCT FROM n.amount OR o.props IS DISTINCT FROM n.props THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS n FROM o FULL JOIN n ON o.id = n.id GROUP BY 1")
def delta_counts(t):
    return T.delta(state_at(t, AT).drop("tx_from"), dump(t), "id", STATE).groupBy("change").agg(F.count("*").alias("n"))


HISTORY = f"SELECT id, state, amount, props, tx_from, CASE WHEN tx_to <= TIMESTAMP '{AT}' THEN tx_to END AS tx_to FROM v_version WHERE tx_from <= TIMESTAMP '{AT}'"


def history(t):
    """Versions as they stood at AT."""
    return t.version.where(F.col("tx_from") <= stamp(AT)).select("id", *STATE, "tx_from", F.when(F.col("tx_to") <= stamp(AT), F.col("tx_to")).alias("tx_to"))


_DIFFERS = "(h.state IS DISTINCT FROM n.state OR h.amount IS DISTINCT FROM n.amount OR h.props IS DISTINCT FROM n.props)"


def _merge_sql(close_missing):
    gone = " OR n.id IS NULL" if close_missing else ""
    return f"""WITH h AS ({HISTORY}), later AS ({_state_sql(LATER)}), n AS ({DUMP})
SELECT h.id, h.state, h.amount, h.props, h.tx_from, CASE WHEN h.tx_to IS NULL AND ((n.id IS NOT NULL AND {_DIFFERS}){gone}) THEN TIMESTAMP '{LATER}' ELSE h.tx_to END AS tx_to FROM h LEFT JOIN n ON h.id = n.id
UNION ALL SELECT n.id, n.state, n.amount, n.props, TIMESTAMP '{LATER}', NULL FROM n LEFT JOIN (SELECT * FROM h WHERE tx_to IS NULL) h ON h.id = n.id WHERE h.id IS NULL OR {_DIFFERS}"""


@query("scd2_merge", _merge_sql(False))
def scd2_merge(t):
    return T.merge(history(t), dump(t), "id", STATE, stamp(LATER), repeats=True)


@query("org_scd2", _merge_sql(True) + f" UNION ALL SELECT h.id, 'Inactive', h.amount, h.props, TIMESTAMP '{LATER}', NULL FROM h WHERE tx_to IS NULL AND id NOT IN (SELECT id FROM n)")
def org_scd2(t):
    return T.merge(history(t), dump(t), "id", STATE, stamp(LATER), close_missing=True, repeats=True).unionAll(T.disappeared_rows(history(t), dump(t), "id", STATE, stamp(LATER), "state"))


@query("unit_scd2", _merge_sql(True) + f" UNION ALL SELECT h.id, h.state, h.amount, h.props, TIMESTAMP '{LATER}', NULL FROM h WHERE tx_to IS NULL AND id NOT IN (SELECT id FROM n)")
def unit_scd2(t):
    return T.merge(history(t), dump(t), "id", STATE, stamp(LATER), close_missing=True, repeats=True).unionAll(T.disappeared_rows(history(t), dump(t), "id", STATE, stamp(LATER), None))


@query("theme_scd2", f"""WITH o AS (SELECT concat('RTH-', left(sha256(concat(c_mktsegment, '|', CAST(c_nationkey AS VARCHAR))), 12)) AS theme_id, c_mktsegment AS name, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY c_mktsegment, c_nationkey),
n AS (SELECT concat('RTH-', left(sha256(concat(c_mktsegment, '|', CAST(c_nationkey AS VARCHAR))), 12)) AS theme_id, c_mktsegment AS name, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_mktsegment, c_nationkey)
SELECT o.theme_id, o.name, o.n, TIMESTAMP '{AT}' AS tx_from, CASE WHEN n.theme_id IS NOT NULL AND (o.name, o.n) IS DISTINCT FROM (n.name, n.n) THEN TIMESTAMP '{LATER}' END AS tx_to FROM o LEFT JOIN n USING (theme_id)
UNION ALL SELECT n.theme_id, n.name, n.n, TIMESTAMP '{LATER}', NULL FROM n LEFT JOIN o USING (theme_id) WHERE o.theme_id IS NULL OR o.n <> n.n""")
def theme_scd2(t):
    key = F.concat(F.lit("RTH-"), F.substring(F.sha2(F.concat("c_mktsegment", F.lit("|"), F.col("c_nationkey").cast("string")), 256), 1, 12))
    themes = lambda rows: rows.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).select(key.alias("theme_id"), F.col("c_mktsegment").alias("name"), "n")
    old = themes(t.customer.where("c_custkey % 3 = 0")).withColumns({"tx_from": stamp(AT), "tx_to": F.lit(None).cast("timestamp_ntz")})
    return T.merge(old, themes(t.customer.where("c_custkey % 2 = 0")), "theme_id", ["name", "n"], stamp(LATER))


@query("scd2_invariants", "SELECT 'none' AS rule, 0::BIGINT AS id WHERE FALSE")
def scd2_invariants(t):
    return T.invariants(T.merge(history(t), dump(t), "id", STATE, stamp(LATER)), "id")


def _hashes(rows):
    return rows.select("id", F.md5("state").alias("h_what"), F.md5(F.col("props")).alias("h_why"))


_HASHED = "SELECT id, md5(state) AS h_what, md5(props) AS h_why FROM "


@query("model_delta", f"WITH a AS ({_state_sql(AT)}), later AS ({_state_sql(LATER)}), b AS ({DUMP}), o AS ({_HASHED} a), n AS ({_HASHED} b) SELECT n.id, CASE WHEN o.id IS NULL THEN 'new' WHEN o.h_what IS DISTINCT FROM n.h_what OR o.h_why IS DISTINCT FROM n.h_why THEN 'changed' ELSE 'unchanged' END AS change FROM n LEFT JOIN o ON o.id = n.id")
def model_delta(t):
    return T.hash_delta(_hashes(state_at(t, AT)), _hashes(dump(t)), "id", ["h_what", "h_why"]).drop("parts")


@query("embedding_delta", f"WITH a AS ({_state_sql(AT)}), later AS ({_state_sql(LATER)}), b AS ({DUMP}), o AS ({_HASHED} a), n AS ({_HASHED} b) SELECT n.id, CASE WHEN o.id IS NULL THEN 'new' WHEN o.h_what IS DISTINCT FROM n.h_what OR o.h_why IS DISTINCT FROM n.h_why THEN 'changed' ELSE 'unchanged' END AS change, CASE WHEN o.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.h_what IS DISTINCT FROM n.h_what THEN 'h_what' END, CASE WHEN o.h_why IS DISTINCT FROM n.h_why THEN 'h_why' END) END AS parts FROM n LEFT JOIN o ON o.id = n.id")
def embedding_delta(t):
    return T.hash_delta(_hashes(state_at(t, AT)), _hashes(dump(t)), "id", ["h_what", "h_why"])


@query("asof_export", "SELECT c.id, c.status, c.level, e.c_frequency, e.c_evidence, u.parent_id, u.parent_c_what, u.parent_c_why FROM v_control c JOIN v_criteria e ON e.id = c.id LEFT JOIN (SELECT p.child_id, p.parent_id, q.c_what AS parent_c_what, q.c_why AS parent_c_why FROM v_parent p JOIN v_criteria q ON q.id = p.parent_id) u ON u.child_id = c.id WHERE c.created_on <= TIMESTAMP '1999-12-31 23:59:59.999999'")
def asof_export(t):
    seen = t.control.where(F.col("created_on") <= stamp("1999-12-31 23:59:59.999999")).select("id", "status", "level")
    return T.export_as_of(seen, t.criteria, t.parent, ["c_frequency", "c_evidence"], ["c_what", "c_why"])


@query("export_violations", "SELECT c.id, CASE WHEN e.id IS NULL THEN 'no criteria' ELSE 'empty frequency' END AS rule FROM v_base c LEFT JOIN v_criteria e ON e.id = c.id WHERE e.id IS NULL OR coalesce(c.frequency, '') = '' ORDER BY c.id LIMIT 20")
def export_violations(t):
    rows = t.base.join(t.criteria.select("id", F.lit(True).alias("_there")), "id", "left")
    rule = F.when(F.col("_there").isNull(), "no criteria").when(F.coalesce("frequency", F.lit("")) == "", "empty frequency")
    return rows.select("id", rule.alias("rule")).where("rule IS NOT NULL").orderBy("id").limit(20)


@query("latest_by_key", "SELECT id, state, amount FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tx_from DESC, event_id DESC) AS rn FROM v_version) WHERE rn = 1")
def latest_by_key(t):
    return t.version.groupBy("id").agg(F.max_by(F.struct("state", "amount"), F.struct("tx_from", "event_id")).alias("x")).select("id", "x.state", "x.amount")


@query("predecessor_check", "SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> 'error', TRUE) AS may_run FROM events WHERE event_type <> 'view'")
def predecessor_check(t):
    jobs = T.may_run(t.events.dropna(subset=["event_type"]), "user_id", ["event_id"], F.col("event_type"), ["view"], ["error"])
    return jobs.select("event_id", "user_id", "before", "may_run")


EXPORT_AT = "1999-12-31 23:59:59.999999"


def _held(table):
    return f"(SELECT * FROM {table} WHERE tx_from <= TIMESTAMP '{EXPORT_AT}' AND (tx_to IS NULL OR tx_to > TIMESTAMP '{EXPORT_AT}'))"


@query("export_at_time", f"""WITH c AS {_held('v_control_v')}, e AS {_held('v_criteria_v')}, p AS (SELECT child_id, min(parent_id) AS parent_id FROM {_held('v_parent_v')} GROUP BY 1)
SELECT c.id, c.status, c.frequency, e.c_frequency, e.c_evidence, CASE WHEN u.id IS NOT NULL THEN p.parent_id END AS parent_id, u.c_what AS parent_c_what, u.c_why AS parent_c_why
FROM c JOIN e ON e.id = c.id LEFT JOIN p ON p.child_id = c.id LEFT JOIN e u ON u.id = p.parent_id""")
def export_at_time(t):
    """Rows, criteria, parents and their criteria, all as they stood at one time."""
    out = T.export_at(t.control_v.drop("level"), t.criteria_v, t.parent_v, stamp(EXPORT_AT), ["c_frequency", "c_evidence"], ["c_what", "c_why"])
    return out.select("id", "status", "frequency", "c_frequency", "c_evidence", "parent_id", "parent_c_what", "parent_c_why")


def _snapshot_sql(at):
    return f"""(SELECT v.id, v.status, v.frequency, u.parent_id, w.status AS parent_status FROM (SELECT *, {at} AS at FROM v_control_v) v
LEFT JOIN (SELECT x.id, x.tx_from, min(p.parent_id) AS parent_id FROM v_control_v x JOIN v_parent_v p ON p.child_id = x.id AND p.tx_from <= x.tx_from AND (p.tx_to IS NULL OR p.tx_to > x.tx_from) GROUP BY 1, 2) u ON u.id = v.id AND u.tx_from = v.tx_from
LEFT JOIN v_control_v w ON w.id = u.parent_id AND w.tx_from <= v.tx_from AND (w.tx_to IS NULL OR w.tx_to > v.tx_from) WHERE v.tx_from = v.at)"""


_FIRST, _SECOND = "(SELECT created_on FROM v_control k WHERE k.id = v_control_v.id)", "(SELECT created_on + INTERVAL 300 DAY FROM v_control k WHERE k.id = v_control_v.id)"


@query("version_diff_parents", f"WITH a AS {_snapshot_sql(_FIRST)}, b AS {_snapshot_sql(_SECOND)} " + " UNION ALL ".join(f"SELECT a.id, '{c}' AS field, CAST(a.{c} AS VARCHAR) AS before, CAST(b.{c} AS VARCHAR) AS after FROM a JOIN b ON a.id = b.id WHERE a.{c} IS DISTINCT FROM b.{c}" for c in ("status", "frequency", "parent_id", "parent_status")))
def version_diff_parents(t):
    """Two versions of each row, the parent and its status as of each of them."""
    began = t.control.select(F.col("id").alias("_i"), "created_on")
    versions = t.control_v.join(began, F.col("id") == F.col("_i")).drop("_i")
    return T.diff_versions(versions, t.parent_v, "id", F.col("created_on"), F.col("created_on") + F.expr("INTERVAL 300 DAY"), ["status", "frequency"], ["status"])


_TREE_DUMP = "SELECT src AS parent_id, CASE WHEN src = 'nation:3' AND dst LIKE '%5' THEN dst || 'x' ELSE dst END AS child_id FROM v_edge WHERE src <> 'nation:7' AND dst <> 'nation:7'"
_TREE_NODES = "SELECT parent_id AS node_id FROM n UNION SELECT child_id FROM n"


@query("org_edges_scd2", f"""WITH n AS ({_TREE_DUMP}), nodes AS ({_TREE_NODES}), o AS (SELECT src AS parent_id, dst AS child_id FROM v_edge),
gone AS (SELECT parent_id AS id FROM o WHERE parent_id NOT IN (SELECT node_id FROM nodes) UNION SELECT child_id FROM o WHERE child_id NOT IN (SELECT node_id FROM nodes)),
diff AS (SELECT parent_id FROM (SELECT * FROM o EXCEPT SELECT * FROM n) WHERE parent_id IN (SELECT node_id FROM nodes) UNION SELECT parent_id FROM (SELECT * FROM n EXCEPT SELECT * FROM o))
SELECT parent_id, child_id, TIMESTAMP '{AT}' AS tx_from, CASE WHEN parent_id IN (SELECT parent_id FROM diff) OR parent_id IN (SELECT id FROM gone) OR child_id IN (SELECT id FROM gone) THEN TIMESTAMP '{LATER}' END AS tx_to FROM o
UNION ALL SELECT parent_id, child_id, TIMESTAMP '{LATER}', NULL FROM n WHERE parent_id IN (SELECT parent_id FROM diff)""")
def org_edges_scd2(t):
    """A node goes, with its edges both ways; another one's children change, so all its edges begin anew."""
    child = F.when((F.col("src") == "nation:3") & F.col("dst").endswith("5"), F.concat("dst", F.lit("x"))).otherwise(F.col("dst"))
    dump = t.edge.where("src <> 'nation:7' AND dst <> 'nation:7'").select(F.col("src").alias("parent_id"), child.alias("child_id"))
    nodes = dump.select(F.col("parent_id").alias("node_id")).union(dump.select("child_id")).distinct()
    old = t.edge.select(F.col("src").alias("parent_id"), F.col("dst").alias("child_id"), stamp(AT).alias("tx_from"), F.lit(None).cast("timestamp_ntz").alias("tx_to"))
    return T.merge_children(old, dump, nodes, stamp(LATER))


@query("theme_parent_resolve", """WITH th AS (SELECT concat('RTH-', left(sha256(concat(p_brand, '|', p_type)), 12)) AS theme_id, p_brand AS source, CASE WHEN p_partkey % 3 = 0 THEN 'Expired' ELSE 'Active' END AS status, p_partkey AS position FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey AS id, p_brand AS parent_source, (SELECT max_by(theme_id, position) FROM th WHERE status = 'Active' AND source = p_brand) AS parent_id FROM part""")
def theme_parent_resolve(t):
    themes = t.part.where("p_partkey % 2 = 0").select(
        F.concat(F.lit("RTH-"), F.substring(F.sha2(F.concat_ws("|", "p_brand", "p_type"), 256), 1, 12)).alias("theme_id"), F.col("p_brand").alias("source"),
        F.when(F.col("p_partkey") % 3 == 0, "Expired").otherwise("Active").alias("status"), F.col("p_partkey").alias("position"))
    return T.theme_parents(t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("parent_source")), themes)


@query("edges_deferred", "SELECT parent_id, child_id, parent_id IN (SELECT id FROM v_base) AND child_id IN (SELECT id FROM v_base) AS ready FROM v_parent")
def edges_deferred(t):
    """Edges that can be written once the base rows are there, and those that wait."""
    ready, waiting = T.deferred(t.parent, t.base)
    return ready.withColumn("ready", F.lit(True)).unionByName(waiting.withColumn("ready", F.lit(False)))


def history_store(t):
    return TableStore.create(history(t), new_folder(t.spark, "table-store"), "id", 16)


@query("store_scd2_merge", _merge_sql(False))
def store_scd2_merge(t):
    """The merge in a kept store: only buckets of the dump's keys are read and written."""
    store = history_store(t)
    store.merge(dump(t), lambda rows, new: T.merge(rows, new, "id", STATE, stamp(LATER), repeats=True))
    return store.read()


@query("store_versions", f"WITH h AS ({HISTORY}), up AS (SELECT id, 'held' AS state, amount, props, tx_from, tx_to FROM h WHERE id % 50 = 0) SELECT 'now' AS version, * FROM h WHERE id % 50 <> 0 UNION ALL SELECT 'now', * FROM up UNION ALL SELECT 'first', * FROM h")
def store_versions(t):
    """Of three commits (deletion, restore, replacement) the first and the last are read."""
    store = history_store(t)
    store.delete(store.read().where("id % 3 = 0").select("id"))
    store.restore(0)
    held = store.read().where("id % 50 = 0").withColumn("state", F.lit("held"))
    store.upsert(held)
    return store.read().withColumn("version", F.lit("now")).unionByName(store.read(0).withColumn("version", F.lit("first")))


_PAIRS_OLD = "SELECT id AS key, similar_id AS other, score FROM v_similar WHERE (id + similar_id) % 4 <> 1"
_PAIRS_NEW = "SELECT id AS key, similar_id AS other, CASE WHEN similar_id % 5 = 0 THEN score / 2 ELSE score END AS score FROM v_similar WHERE id % 3 = 0 AND (id + similar_id) % 4 <> 2"


@query("pair_versions", f"""WITH o AS ({_PAIRS_OLD}), n AS ({_PAIRS_NEW})
SELECT o.key, o.other, o.score, TIMESTAMP '{AT}' AS tx_from, CASE WHEN o.key % 3 = 0 AND (n.key IS NULL OR n.score <> o.score) THEN TIMESTAMP '{LATER}' END AS tx_to FROM o LEFT JOIN n ON n.key = o.key AND n.other = o.other
UNION ALL SELECT n.key, n.other, n.score, TIMESTAMP '{LATER}', NULL FROM n LEFT JOIN o ON n.key = o.key AND n.other = o.other WHERE o.key IS NULL OR o.score <> n.score""")
def pair_versions(t):
    """Versions of similar pairs after those of some keys were made anew, in a kept store."""
    s = t.similar.select(F.col("id").alias("key"), F.col("similar_id").alias("other"), "score")
    total = F.col("key") + F.col("other")
    none = F.lit(None).cast("timestamp_ntz")
    store = TableStore.create(s.where(total % 4 != 1).withColumns({"tx_from": stamp(AT), "tx_to": none}), new_folder(t.spark, "table-store"), "key", 16)
    pairs = s.where((F.col("key") % 3 == 0) & (total % 4 != 2)).withColumn("score", F.when(F.col("other") % 5 == 0, F.col("score") / 2).otherwise(F.col("score")))
    touched = t.control.where("id % 3 = 0").select(F.col("id").alias("key"))
    store.merge(touched, lambda rows, keys: M.pair_versions(rows, keys, pairs, stamp(LATER), ["score"]))
    return store.read()
