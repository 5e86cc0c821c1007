"""Queries of hierarchies, facets and joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import bitmap_facets as B
from ..operators import explore as E
from ..operators import graph as G
from ..operators import intervals as N
from ..operators.substring_index import SubstringIndex
from ..sources.shared import new_folder
from .registry import query


def _seed(t, *nodes):
    return t.spark.range(1).select(F.explode(F.array(*map(F.lit, nodes))).alias("node"))


def _closure_sql(seed, up=False):
    a, b = ("dst", "src") if up else ("src", "dst")
    return f"WITH RECURSIVE walk AS ({seed} UNION SELECT e.{b}, w.level + 1 FROM walk w JOIN v_edge e ON e.{a} = w.node WHERE w.level < 10) SELECT node, min(level)::INT AS level FROM walk GROUP BY node"


@query("graph_descendants", _closure_sql("SELECT 'region:1' AS node, 0 AS level"))
def graph_descendants(t):
    return G.closure(_seed(t, "region:1"), t.edge)


@query("graph_ancestors", _closure_sql("SELECT 'customer:7' AS node, 0 AS level UNION SELECT 'supplier:9', 0", up=True))
def graph_ancestors(t):
    return G.closure(_seed(t, "customer:7", "supplier:9"), G.reverse(t.edge))


@query("tree_roots", "SELECT node_id, name FROM v_node WHERE node_id NOT IN (SELECT dst FROM v_edge)")
def tree_roots(t):
    return G.roots(t.node, t.edge)


@query("tree_children", "SELECT e.src AS parent_id, e.dst AS node_id, n.name, EXISTS (SELECT 1 FROM v_edge x WHERE x.src = e.dst) AS has_children FROM v_edge e JOIN v_node n ON n.node_id = e.dst WHERE e.src = 'region:2'")
def tree_children(t):
    return G.children(t.node, t.edge, F.lit("region:2"))


@query("tree_preload", "WITH RECURSIVE walk AS (SELECT node_id, 0 AS level FROM v_node WHERE node_id NOT IN (SELECT dst FROM v_edge) UNION ALL SELECT e.dst, w.level + 1 FROM walk w JOIN v_edge e ON e.src = w.node_id WHERE w.level < 2) SELECT w.node_id, w.level::INT AS level, n.name, w.node_id IN (SELECT src FROM v_edge) AS has_children FROM walk w JOIN v_node n ON n.node_id = w.node_id")
def tree_preload(t):
    reached = G.closure(G.roots(t.node, t.edge).select(F.col("node_id").alias("node")), t.edge, 2).withColumnRenamed("node", "node_id")
    return G.with_has_children(reached.join(t.node, "node_id"), t.edge)


@query("tree_levels", "WITH RECURSIVE walk AS (SELECT node_id, 0 AS level, node_id AS path FROM v_node WHERE node_id NOT IN (SELECT dst FROM v_edge) UNION ALL SELECT e.dst, w.level + 1, w.path || ' / ' || e.dst FROM walk w JOIN v_edge e ON e.src = w.node_id) SELECT node_id, level::INT AS level, path FROM walk")
def tree_levels(t):
    return G.paths(G.roots(t.node, t.edge), t.edge)


@query("taxonomy_tree", "SELECT p.o_orderkey AS id, count(c.o_orderkey) AS n_expired, coalesce(min(c.o_orderkey), -1) AS first FROM orders p LEFT JOIN orders c ON c.o_orderkey - c.o_orderkey % 5 = p.o_orderkey AND c.o_orderkey % 5 <> 0 AND c.o_orderstatus = 'F' WHERE p.o_orderkey % 5 = 0 AND p.o_orderstatus = 'O' GROUP BY 1")
def taxonomy_tree(t):
    themes = t.control.where("level = 'Level 1' AND status = 'Active' OR level = 'Level 2' AND status = 'Expired'").select("id", "status")
    forest = E.theme_forest(themes, t.parent.select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst")))
    return forest.select("id", F.size("expired").cast("long").alias("n_expired"), F.coalesce(F.get("expired", F.lit(0)), F.lit(-1)).alias("first"))


@query("scope_union", "SELECT id, node_id FROM v_owns UNION SELECT id, node_id FROM v_related")
def scope_union(t):
    return G.scoped(t.owns, t.related, "both")


_CUST = "SELECT id FROM v_owns WHERE node_id IN (SELECT concat('customer:', CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))"
_THEME = "SELECT id FROM v_theme WHERE theme = 'ECONOMY'"


def _customer_facet(t):
    return G.facet(t.owns, G.closure(_seed(t, "region:1"), t.edge))


def _theme_facet(t):
    return t.theme.where("theme = 'ECONOMY'").select("id").distinct()


@query("facet_and", f"{_CUST} INTERSECT {_THEME}")
def facet_and(t):
    return G.all_of(_customer_facet(t), _theme_facet(t))


@query("facet_or", f"{_CUST} UNION {_THEME}")
def facet_or(t):
    return G.any_of(_customer_facet(t), _theme_facet(t))


def facet_bitmaps(t):
    edges = B.edges_of(t.control, ["status", "level", "frequency"]).unionByName(B.edges_of(t.theme, ["theme"]))
    return B.BitmapFacets.build(edges, new_folder(t.spark, "facets"))


_ASKED = {"theme": ["ECONOMY", "PROMO"], "status": ["Active", "Expired"], "frequency": ["1-URGENT", "5-LOW"]}
_THEMES, _STATUS, _FREQUENCY = "SELECT id FROM v_theme WHERE theme IN ('ECONOMY', 'PROMO')", "SELECT id FROM v_control WHERE status IN ('Active', 'Expired')", "SELECT id FROM v_control WHERE frequency IN ('1-URGENT', '5-LOW')"
_FACETS = """SELECT 'status' AS facet, status AS value, id FROM v_control UNION ALL SELECT 'level', level, id FROM v_control
UNION ALL SELECT 'frequency', frequency, id FROM v_control WHERE frequency <> '' UNION ALL SELECT 'theme', theme, id FROM v_theme"""


@query("facet_bitmap_and", f"{_THEMES} INTERSECT {_STATUS} INTERSECT {_FREQUENCY}")
def facet_bitmap_and(t):
    """Controls with a value of each facet, by bitmaps."""
    return B.ids_of(facet_bitmaps(t).selected(_ASKED))


@query("facet_bitmap_or", f"{_THEMES} UNION SELECT id FROM v_control WHERE status = 'Approval Pending'")
def facet_bitmap_or(t):
    return B.ids_of(facet_bitmaps(t).selected({"theme": ["ECONOMY", "PROMO"], "status": ["Approval Pending"]}, every=False))


@query("facet_bitmap_counts", f"SELECT facet, value, count(DISTINCT id) AS n FROM ({_FACETS}) WHERE id IN ({_THEMES} INTERSECT {_STATUS} INTERSECT {_FREQUENCY}) GROUP BY 1, 2")
def facet_bitmap_counts(t):
    """What the chosen controls have in each facet."""
    kept = facet_bitmaps(t)
    return kept.counts(kept.selected(_ASKED))


@query("facet_bitmap_totals", f"SELECT facet, value, count(DISTINCT id) AS n FROM ({_FACETS}) GROUP BY 1, 2")
def facet_bitmap_totals(t):
    return facet_bitmaps(t).counts()


@query("facet_via_unit", "WITH u AS (SELECT function_node AS n FROM v_unit WHERE unit_id % 10 = 1 UNION SELECT location_node FROM v_unit WHERE unit_id % 10 = 1), leaf AS (SELECT dst AS node FROM v_edge JOIN u ON src = n UNION SELECT n FROM u) SELECT DISTINCT id FROM (SELECT * FROM v_owns UNION ALL SELECT * FROM v_related) e WHERE node_id IN (SELECT node FROM leaf)")
def facet_via_unit(t):
    units = t.unit.where("unit_id % 10 = 1")
    seeds = units.select(F.explode(F.array("function_node", "location_node")).alias("node"))
    return G.facet(G.scoped(t.owns, t.related, "both"), G.closure(seeds, t.edge))


@query("facet_via_link", "SELECT DISTINCT r.id FROM v_related r JOIN v_link l ON l.node_id = r.node_id WHERE l.entity_id IN ('entity:3', 'entity:5')")
def facet_via_link(t):
    return G.facet(t.related, t.link.where(F.col("entity_id").isin("entity:3", "entity:5")).select(F.col("node_id").alias("node")))


@query("sidebar_candidates", f"SELECT b.* FROM v_base b WHERE id IN ({_CUST} INTERSECT {_THEME})")
def sidebar_candidates(t):
    return t.base.join(G.all_of(_customer_facet(t), _theme_facet(t)), "id", "left_semi")


@query("toolbar_filter", "SELECT id, level, created_on FROM v_control WHERE status = 'Active' AND key_control AND level IN ('Level 1', 'Level 2') AND created_on >= TIMESTAMP '1996-01-01' AND created_on <= TIMESTAMP '1999-12-31' AND id IN (SELECT id FROM v_similar)")
def toolbar_filter(t):
    asked = E.Toolbar(active_only=True, key_control=True, level1=True, level2=True, date_from="1996-01-01", date_to="1999-12-31", has_similar=True)
    return E.toolbar(t.control, asked, t.similar).select("id", "level", "created_on")


@query("toolbar_open", "SELECT id, status, level FROM v_control WHERE NOT coalesce(key_control, FALSE) AND created_on >= TIMESTAMP '1998-01-01'")
def toolbar_open(t):
    """Neither level: any level."""
    return E.toolbar(t.control, E.Toolbar(key_control=False, date_from="1998-01-01")).select("id", "status", "level")


@query("toolbar_one_level", "SELECT id FROM v_control WHERE status = 'Active' AND level = 'Level 1'")
def toolbar_one_level(t):
    return E.toolbar(t.control, E.Toolbar(active_only=True, level1=True)).select("id")


@query("criteria_no_filter", """SELECT b.id, b.level FROM v_control b LEFT JOIN v_criteria c ON c.id = b.id LEFT JOIN v_parent p ON p.child_id = b.id LEFT JOIN v_criteria u ON u.id = p.parent_id
WHERE NOT coalesce(lower(trim(c.c_evidence)) = 'yes', FALSE) AND NOT coalesce(lower(trim(CASE WHEN b.level = 'Level 2' THEN u.c_why ELSE c.c_why END)) = 'yes', FALSE)""")
def criteria_no_filter(t):
    return G.criteria_all_no(t.control.select("id", "level"), t.criteria, t.parent, ["c_evidence"], ["c_why"])


@query("cascade_suggest", "SELECT DISTINCT u.unit_id, u.location_node FROM v_unit u WHERE u.function_node = 'nation:4' OR split_part(u.location_node, ':', 2) = '4'")
def cascade_suggest(t):
    same = F.substring_index("location_node", ":", -1) == "4"
    return t.unit.where((F.col("function_node") == "nation:4") | same).select("unit_id", "location_node").distinct()


@query("edge_expand", "SELECT e.src, e.dst, a.name AS src_name, b.name AS dst_name FROM v_edge e LEFT JOIN v_node a ON a.node_id = e.src LEFT JOIN v_node b ON b.node_id = e.dst WHERE e.dst LIKE 'nation:%' OR e.dst LIKE 'supplier:%'")
def edge_expand(t):
    part = t.edge.where(F.col("dst").startswith("nation:") | F.col("dst").startswith("supplier:"))
    return E.edge_expand(part, t.node)


@query("relationships_hydrate", """SELECT b.id, (SELECT min(parent_id) FROM v_parent p WHERE p.child_id = b.id) AS parent_id, coalesce(k.n, 0) AS n_children, o.node_id AS owner, n.name AS owner_name, coalesce(r.n, 0) AS n_related, coalesce(h.themes, '') AS themes
FROM v_base b LEFT JOIN (SELECT parent_id, count(*) AS n FROM v_parent GROUP BY 1) k ON k.parent_id = b.id LEFT JOIN v_owns o ON o.id = b.id LEFT JOIN v_node n ON n.node_id = o.node_id
LEFT JOIN (SELECT id, count(*) AS n FROM v_related GROUP BY 1) r ON r.id = b.id LEFT JOIN (SELECT id, string_agg(theme, ',' ORDER BY theme) AS themes FROM v_theme GROUP BY 1) h ON h.id = b.id""")
def relationships_hydrate(t):
    up = t.parent.groupBy(F.col("child_id").alias("id")).agg(F.min("parent_id").alias("parent_id"))
    down = t.parent.groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list("child_id")).alias("children"))
    owner = t.owns.join(t.node, "node_id", "left").select("id", F.col("node_id").alias("owner"), F.col("name").alias("owner_name"))
    related = t.related.groupBy("id").agg(F.count("*").alias("n_related"))
    themes = t.theme.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("theme")), ",").alias("themes"))
    out = t.base.select("id").join(up, "id", "left").join(down, "id", "left").join(owner, "id", "left").join(related, "id", "left").join(themes, "id", "left")
    return out.select("id", "parent_id", F.when(F.col("children").isNull(), 0).otherwise(F.size("children")).cast("long").alias("n_children"), "owner", "owner_name", F.coalesce("n_related", F.lit(0)).alias("n_related"), F.coalesce("themes", F.lit("")).alias("themes"))


@query("fk_filter", "SELECT id, node_id FROM v_owns WHERE node_id IN (SELECT node_id FROM v_node WHERE node_id NOT LIKE '%7')")
def fk_filter(t):
    return t.owns.join(t.node.where(~F.col("node_id").endswith("7")), "node_id", "left_semi").select("id", "node_id")


@query("fk_dropped", "SELECT count(*) AS n FROM v_owns WHERE node_id NOT IN (SELECT node_id FROM v_node WHERE node_id NOT LIKE '%7')")
def fk_dropped(t):
    return t.owns.join(t.node.where(~F.col("node_id").endswith("7")), "node_id", "left_anti").agg(F.count("*").alias("n"))


@query("theme_resolve", """WITH cat AS (SELECT DISTINCT p_brand AS source, p_type AS name, concat(p_brand, '|', p_type) AS theme FROM part WHERE p_partkey % 17 = 0), one AS (SELECT source, min(theme) AS theme FROM cat GROUP BY 1 HAVING count(*) = 1),
ask AS (SELECT p_partkey AS id, p_brand AS source, CASE WHEN p_partkey % 4 = 0 THEN 'UNKNOWN' ELSE p_type END AS name FROM part)
SELECT a.id, coalesce(c.theme, o.theme) AS theme FROM ask a LEFT JOIN cat c ON c.source = a.source AND c.name = a.name LEFT JOIN one o ON o.source = a.source WHERE coalesce(c.theme, o.theme) IS NOT NULL""")
def theme_resolve(t):
    cat = t.part.where("p_partkey % 17 = 0").select(F.col("p_brand").alias("source"), F.col("p_type").alias("name")).distinct()
    name = F.when(F.col("p_partkey") % 4 == 0, "UNKNOWN").otherwise(F.col("p_type"))
    ask = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("source"), name.alias("name"))
    found = E.theme_resolve(ask, cat.withColumn("theme", F.concat_ws("|", "source", "name")))
    return found.select("id", "theme").where("theme IS NOT NULL")


@query("pair_exclusion", "SELECT id, similar_id, score FROM v_similar s WHERE NOT EXISTS (SELECT 1 FROM v_parent p WHERE least(p.parent_id, p.child_id) = least(s.id, s.similar_id) AND greatest(p.parent_id, p.child_id) = greatest(s.id, s.similar_id))")
def pair_exclusion(t):
    return E.without_family(t.similar.select("id", "similar_id", "score"), t.parent, "id", "similar_id")


@query("node_search", "SELECT node_id, name FROM v_node WHERE name ILIKE '%r#0000000_4%' OR node_id ILIKE '%nation:1%' ORDER BY name, node_id LIMIT 50")
def node_search(t):
    return E.node_search(t.node, "r#0000000_4", "nation:1")


@query("group_results", "SELECT CASE WHEN coalesce(frequency, '') = '' THEN 'Unknown' ELSE frequency END AS label, count(*) AS n, min(id) AS first FROM v_base GROUP BY 1")
def group_results(t):
    label = F.when(F.coalesce("frequency", F.lit("")) == "", "Unknown").otherwise(F.col("frequency"))
    return t.base.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy("label")


@query("page_slice", "SELECT id, total, total > 150 AS has_more FROM (SELECT id, row_number() OVER (ORDER BY price DESC, id) AS rn, count(*) OVER () AS total FROM v_base) WHERE rn > 100 AND rn <= 150")
def page_slice(t):
    return _page_behind(t.base.select("id", "price"), ["-price", "id"], 100, 50).select("id", "total", "has_more")


def _page_behind(rows, order, skipped, size):
    """The page after the first ``skipped`` rows, by the cursor that these end with."""
    before = E.page_after(rows, order, None, skipped).agg(F.max("next_cursor")).first()[0]
    return E.page_after(rows, order, before, size)


@query("page_cursor", """SELECT id, total, total > 75 AS has_more, CASE WHEN total > 75 THEN max(CASE WHEN rn = 75 THEN CAST(to_json([CAST(created_on AS VARCHAR), CAST(id AS VARCHAR)]) AS VARCHAR) END) OVER () END AS next_cursor
FROM (SELECT id, created_on, row_number() OVER (ORDER BY created_on, id) AS rn, count(*) OVER () AS total FROM v_base) WHERE rn > 50 AND rn <= 75""")
def page_cursor(t):
    return _page_behind(t.base.select("id", "created_on"), ["created_on", "id"], 50, 25).drop("created_on")


@query("counted_page", "SELECT c_custkey, count(*) OVER () AS total FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def counted_page(t):
    return E.counted_page(t.customer.select("c_custkey"), ["c_custkey"], 3, 25)


@query("browse_all", "SELECT id, 0.0::DOUBLE AS score, row_number() OVER (ORDER BY id) AS rank FROM v_base ORDER BY id LIMIT 2000")
def browse_all(t):
    top = t.base.select("id").orderBy("id").limit(2000)
    return top.select("id", F.lit(0.0).alias("score"), F.row_number().over(Window.orderBy("id")).cast("long").alias("rank"))


@query("readiness_missing", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY 1 LIMIT 20")
def readiness_missing(t):
    return E.missing(t.control, t.criteria, "id")

def _list_sql(table, key, shown, name):
    return f"LEFT JOIN (SELECT k AS id, string_agg(s, ',' ORDER BY s) AS {name} FROM (SELECT DISTINCT {key} AS k, {shown} AS s FROM {table}) GROUP BY 1) {name} ON {name}.id = b.id"


@query("relations_all", f"""SELECT b.id, coalesce(parents, '') AS parents, coalesce(children, '') AS children, coalesce(owners, '') AS owners, coalesce(related, '') AS related, coalesce(themes, '') AS themes FROM v_base b
{_list_sql("v_parent p LEFT JOIN v_control c ON c.id = p.parent_id", "child_id", "concat(p.parent_id, '/', c.status)", "parents")}
{_list_sql("v_parent p LEFT JOIN v_control c ON c.id = p.child_id", "parent_id", "concat(p.child_id, '/', c.status)", "children")}
{_list_sql("v_owns o LEFT JOIN v_node n ON n.node_id = o.node_id", "o.id", "concat(o.node_id, '/', coalesce(n.name, '-'))", "owners")}
{_list_sql("v_related o LEFT JOIN v_node n ON n.node_id = o.node_id", "o.id", "concat(o.node_id, '/', coalesce(n.name, '-'))", "related")}
{_list_sql("v_theme", "id", "theme", "themes")}""")
def relations_all(t):
    """All five relations of the base rows; shown as sorted texts."""
    found = E.relations(t.base.select("id"), t.parent, t.owns, t.related, t.theme, t.node, t.control)

    def shown(name, *fields):
        texts = F.transform(name, lambda x: F.concat_ws("/", *(F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields)))
        return F.array_join(F.array_sort(texts), ",").alias(name)

    return found.select("id", shown("parents", "parent_id", "status"), shown("children", "child_id", "status"), shown("owners", "node_id", "name"), shown("related", "node_id", "name"), shown("themes", "theme"))


@query("group_members", """WITH p AS (SELECT id, frequency, row_number() OVER (ORDER BY price DESC, id) AS rank FROM v_base QUALIFY rank <= 100)
SELECT CASE WHEN coalesce(frequency, '') = '' THEN 'Unknown' ELSE frequency END AS label, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS members FROM p GROUP BY 1""")
def group_members(t):
    top = t.base.orderBy(F.desc("price"), "id").limit(100).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("price"), "id")))
    return E.grouped(top, "frequency").withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("cascade_all", """WITH f AS (SELECT * FROM v_unit WHERE function_node = 'nation:4'), l AS (SELECT * FROM v_unit WHERE location_node IN ('nation:3', 'nation:7'))
SELECT 'unit' AS facet, CAST(unit_id AS VARCHAR) AS value FROM f UNION SELECT 'unit', CAST(unit_id AS VARCHAR) FROM l UNION SELECT 'location', location_node FROM f UNION SELECT 'function', function_node FROM l
UNION SELECT 'entity', entity_id FROM v_link WHERE split_part(entity_id, ':', 2) IN ('3', '7') UNION SELECT 'location', location_node FROM v_unit WHERE split_part(location_node, ':', 2) = '5'""")
def cascade_all(t):
    entities = t.spark.range(1).select(F.lit("entity:5").alias("entity_id"))
    return E.cascade(t.unit, t.link, _seed(t, "nation:4"), _seed(t, "nation:3", "nation:7"), entities)


@query("scope_mask", "SELECT id, status = 'Active' AND coalesce(key_control, FALSE) AS in_scope FROM v_control")
def scope_mask(t):
    return t.control.select("id", E.in_scope(None).alias("in_scope"))


@query("details", "SELECT c.id, c.status, c.level, e.c_what, e.c_frequency FROM v_control c LEFT JOIN v_criteria e ON e.id = c.id WHERE c.id IN (2, 4, 11, 123)")
def details(t):
    return E.detail(t.control, t.criteria, [2, 4, 11, 123], ["status", "level"], ["c_what", "c_frequency"])


@query("interval_labels", "WITH RECURSIVE up AS (SELECT node_id AS node, node_id AS top FROM v_node UNION ALL SELECT u.node, e.src FROM up u JOIN v_edge e ON e.dst = u.top) SELECT n.node_id AS node, (SELECT count(*) FROM up WHERE node = n.node_id)::INT - 1 AS level, (SELECT count(*) FROM up WHERE top = n.node_id) AS size FROM v_node n")
def interval_labels(t):
    return N.labels(t.edge, t.node.select(F.col("node_id").alias("node"))).nodes.select("node", "level", "size")


@query("interval_descendants", _closure_sql("SELECT 'region:1' AS node, 0 AS level UNION ALL SELECT 'nation:3', 0"))
def interval_descendants(t):
    """What is below two nodes: one range join over the labels."""
    return N.below(N.labels(t.edge), _seed(t, "region:1", "nation:3"))


@query("interval_ancestors", _closure_sql("SELECT 'customer:7' AS node, 0 AS level UNION SELECT 'supplier:9', 0", up=True))
def interval_ancestors(t):
    return N.above(N.labels(t.edge), _seed(t, "customer:7", "supplier:9"))


@query("interval_facet", f"SELECT DISTINCT id FROM v_owns WHERE node_id IN (SELECT node FROM ({_closure_sql("SELECT 'region:2' AS node, 0 AS level")}))")
def interval_facet(t):
    """Controls that anything below a region owns."""
    return G.facet(t.owns, N.below(N.labels(t.edge), _seed(t, "region:2")))


def node_index(t):
    return SubstringIndex.build(t.node, "node_id", ["name", "node_id"], new_folder(t.spark, "substring-index"))


@query("node_search_indexed", "SELECT node_id, name FROM v_node WHERE name ILIKE '%r#0000000_4%' OR node_id ILIKE '%nation:1%' ORDER BY name, node_id LIMIT 50")
def node_search_indexed(t):
    """Only nodes with the patterns' trigrams are read."""
    return E.first_nodes(node_index(t).like({"%r#0000000_4%": ["name"], "%nation:1%": ["node_id"]}))


@query("node_like", "SELECT node_id, name FROM v_node WHERE name ILIKE '%0001_' OR name ILIKE 'a%i_A'")
def node_like(t):
    """All nodes that patterns fit, one with a wild card for a character, one anchored at both ends with no trigram at all."""
    return node_index(t).like({"%0001_": ["name"], "a%i_A": ["name"]}).select("node_id", "name")
