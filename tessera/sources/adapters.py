"""Views of the driver's tables in the roles of a governed inventory.

Each is plain SQL over ``{table}`` names, so that Spark and the oracle read the
same definition.  A view may stand on another one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

L1 = ("c_what", "c_where", "c_who", "c_when", "c_why", "c_what_why", "c_risk_theme")
L2 = ("c_frequency", "c_preventative", "c_automation", "c_followup", "c_escalation", "c_evidence", "c_abbreviations")

_RULES = dict(zip(L1 + L2, (
    "max(l_discount) > 0.05", "count(DISTINCT l_suppkey) > 2", "min(l_quantity) < 10", "max(l_shipdate) >= DATE '1998-01-01'", "sum(l_quantity) > 100", "max(l_tax) > 0.06", "max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1",
    "count(*) > 3", "max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 1", "min(l_discount) < 0.02", "min(l_linenumber) = 1", "max(l_extendedprice) > 80000", "max(l_quantity) > 40", "count(DISTINCT l_partkey) > 4",
)))

VIEWS = {
    "control": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Expired' ELSE 'Approval Pending' END AS status,
      o_orderpriority IN ('1-URGENT', '2-HIGH') AS key_control, CASE WHEN o_orderkey % 5 = 0 THEN 'Level 1' ELSE 'Level 2' END AS level, o_orderdate AS created_on,
      CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS frequency, o_custkey AS custkey, o_totalprice AS price FROM {orders}""",
    "criteria": "SELECT l_orderkey AS id, " + ", ".join(f"CASE WHEN {rule} THEN 'yes' ELSE 'no' END AS {name}" for name, rule in _RULES.items()) + " FROM {lineitem} GROUP BY l_orderkey",
    "parent": "SELECT o_orderkey - o_orderkey % 5 AS parent_id, o_orderkey AS child_id FROM {orders} WHERE o_orderkey % 5 <> 0",
    "owns": "SELECT o_orderkey AS id, concat('customer:', CAST(o_custkey AS STRING)) AS node_id FROM {orders}",
    "related": "SELECT DISTINCT l_orderkey AS id, concat('supplier:', CAST(l_suppkey AS STRING)) AS node_id FROM {lineitem}",
    "theme": "SELECT DISTINCT l_orderkey AS id, p_type AS theme FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    "edge": """SELECT concat('region:', CAST(n_regionkey AS STRING)) AS src, concat('nation:', CAST(n_nationkey AS STRING)) AS dst FROM {nation}
      UNION ALL SELECT concat('nation:', CAST(c_nationkey AS STRING)), concat('customer:', CAST(c_custkey AS STRING)) FROM {customer}
      UNION ALL SELECT concat('nation:', CAST(s_nationkey AS STRING)), concat('supplier:', CAST(s_suppkey AS STRING)) FROM {supplier}""",
    "node": """SELECT concat('region:', CAST(r_regionkey AS STRING)) AS node_id, r_name AS name FROM {region} UNION ALL SELECT concat('nation:', CAST(n_nationkey AS STRING)), n_name FROM {nation}
      UNION ALL SELECT concat('customer:', CAST(c_custkey AS STRING)), c_name FROM {customer} UNION ALL SELECT concat('supplier:', CAST(s_suppkey AS STRING)), s_name FROM {supplier}""",
    "unit": "SELECT DISTINCT c_nationkey * 100 + s_nationkey AS unit_id, concat('nation:', CAST(c_nationkey AS STRING)) AS function_node, concat('nation:', CAST(s_nationkey AS STRING)) AS location_node FROM {customer} JOIN {supplier} ON c_custkey % 100 = s_suppkey % 100",
    "link": "SELECT concat('entity:', CAST(s_suppkey % 20 AS STRING)) AS entity_id, concat('supplier:', CAST(s_suppkey AS STRING)) AS node_id FROM {supplier}",
    "version": "SELECT user_id AS id, event_id, event_type AS state, value AS amount, props, ts AS tx_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tx_to FROM {events}",
    "similar": """SELECT a.o_orderkey AS id, b.o_orderkey AS similar_id, CAST(1 AS INT) AS rank, CAST(6000 + 40 * ((a.o_orderkey * 7 + b.o_orderkey) % 100) AS DOUBLE) / 10000 AS score FROM {orders} a JOIN {orders} b
      ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND (a.o_orderkey + b.o_orderkey) % 3 = 0""",
    "control_v": """SELECT id, status, level, frequency, created_on AS tx_from, CASE WHEN id % 4 = 0 THEN created_on + INTERVAL 300 DAY END AS tx_to FROM {control}
      UNION ALL SELECT id, 'Active', level, 'later', created_on + INTERVAL 300 DAY, NULL FROM {control} WHERE id % 4 = 0""",
    "criteria_v": """SELECT c.id, c.c_what, c.c_why, c.c_frequency, c.c_evidence, o.created_on + INTERVAL 10 DAY AS tx_from, CASE WHEN c.id % 3 = 0 THEN o.created_on + INTERVAL 200 DAY END AS tx_to FROM {criteria} c JOIN {control} o ON o.id = c.id
      UNION ALL SELECT c.id, 'no', c.c_why, c.c_frequency, 'yes', o.created_on + INTERVAL 200 DAY, NULL FROM {criteria} c JOIN {control} o ON o.id = c.id WHERE c.id % 3 = 0""",
    "parent_v": """SELECT p.parent_id, p.child_id, o.created_on AS tx_from, CASE WHEN p.child_id % 2 = 0 THEN o.created_on + INTERVAL 150 DAY END AS tx_to FROM {parent} p JOIN {control} o ON o.id = p.child_id
      UNION ALL SELECT CASE WHEN p.parent_id >= 5 THEN p.parent_id - 5 ELSE p.parent_id END, p.child_id, o.created_on + INTERVAL 150 DAY, NULL FROM {parent} p JOIN {control} o ON o.id = p.child_id WHERE p.child_id % 2 = 0""",
    "base": "SELECT * FROM {control} WHERE status = 'Active' AND coalesce(key_control, FALSE)",
}

_NEVER = "CAST(NULL AS TIMESTAMP_NTZ)"

#: How Spark gets the rows of some views.  Units are made of the different values of both sides, of which there are few; criteria
#: without a copy of the lines for each distinct count.  Versions come from one reading: a union of two joins counts as dealt out like
#: both, and no longer is once one of them is broadcast while the query runs, so that a join over it fails.
PLANS = {
    "unit": """SELECT DISTINCT c_nationkey * 100 + s_nationkey AS unit_id, concat('nation:', CAST(c_nationkey AS STRING)) AS function_node, concat('nation:', CAST(s_nationkey AS STRING)) AS location_node
      FROM (SELECT DISTINCT c_nationkey, c_custkey % 100 AS k FROM {customer}) c JOIN (SELECT DISTINCT s_nationkey, s_suppkey % 100 AS k FROM {supplier}) s ON c.k = s.k""",
    "criteria": re.sub(r"count\(DISTINCT (\w+)\)", r"size(collect_set(\1))", VIEWS["criteria"]),
    "control_v": f"""SELECT inline(array_compact(array(named_struct('id', id, 'status', status, 'level', level, 'frequency', frequency, 'tx_from', created_on, 'tx_to', CASE WHEN id % 4 = 0 THEN created_on + INTERVAL 300 DAY END),
      CASE WHEN id % 4 = 0 THEN named_struct('id', id, 'status', 'Active', 'level', level, 'frequency', 'later', 'tx_from', created_on + INTERVAL 300 DAY, 'tx_to', {_NEVER}) END))) FROM {{control}}""",
    "criteria_v": f"""SELECT inline(array_compact(array(named_struct('id', c.id, 'c_what', c.c_what, 'c_why', c.c_why, 'c_frequency', c.c_frequency, 'c_evidence', c.c_evidence, 'tx_from', o.created_on + INTERVAL 10 DAY, 'tx_to', CASE WHEN c.id % 3 = 0 THEN o.created_on + INTERVAL 200 DAY END),
      CASE WHEN c.id % 3 = 0 THEN named_struct('id', c.id, 'c_what', 'no', 'c_why', c.c_why, 'c_frequency', c.c_frequency, 'c_evidence', 'yes', 'tx_from', o.created_on + INTERVAL 200 DAY, 'tx_to', {_NEVER}) END))) FROM {{criteria}} c JOIN {{control}} o ON o.id = c.id""",
    "parent_v": f"""SELECT inline(array_compact(array(named_struct('parent_id', p.parent_id, 'child_id', p.child_id, 'tx_from', o.created_on, 'tx_to', CASE WHEN p.child_id % 2 = 0 THEN o.created_on + INTERVAL 150 DAY END),
      CASE WHEN p.child_id % 2 = 0 THEN named_struct('parent_id', CASE WHEN p.parent_id >= 5 THEN p.parent_id - 5 ELSE p.parent_id END, 'child_id', p.child_id, 'tx_from', o.created_on + INTERVAL 150 DAY, 'tx_to', {_NEVER}) END))) FROM {{parent}} p JOIN {{control}} o ON o.id = p.child_id""",
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, or a view of them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = PLANS.get(name, VIEWS[name])
    return spark.sql(text, **{x: spark_view(spark, sf_dir, x) for x in set(re.findall(r"\{(\w+)\}", text))})


class Inventory:
    """The tables and views of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES or name in VIEWS:
            return spark_view(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def oracle(sql: str) -> str:
    """sql with the views that it names in front of it (``v_`` and the view's name)."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_(\w+)\b", text):
            if name in VIEWS and name not in needed:
                need(plain(name))
                needed.append(name)

    def plain(name: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES else f"v_{m[1]}", VIEWS[name])

    need(sql)
    views = ", ".join(f"v_{name} AS ({plain(name)})" for name in needed)
    body = sql.strip()
    if not needed:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body[:4].upper() == "WITH":
        rest = body[14:] if recursive else body[4:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{views}, {rest.strip()}"
    return f"WITH {views} {body}"
