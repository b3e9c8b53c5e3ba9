"""Multi-hop, lineage, path and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conditions as cond
from ..operators import dataflow, ranking, rules
from ..operators import lineage as lineage_of
from ..operators import traversal as tr
from ..operators.traversal import settled
from ..sources import projection as p
from .registry import query

_SEEDS = "seeds AS (SELECT id FROM nodes WHERE node_type = 'Page')"
_BOTH = "both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


def _models(t):
    return p.nodes(t).where("node_type = 'Model'").select(F.col("id").alias("target"), F.col("id").alias("node"))


@query("g01_context", p.sql("""SELECT target, direction, edge_type, count(*) AS n, min(src) AS first_src, max(dst) AS last_dst FROM (SELECT DISTINCT target, 'downstream' AS direction, edge_type, src, dst FROM near JOIN edges ON src = node UNION ALL SELECT DISTINCT target, 'upstream', edge_type, src, dst FROM near JOIN edges ON dst = node) GROUP BY 1, 2, 3""",
 _BOTH, "near AS (SELECT id AS target, id AS node FROM nodes WHERE node_type = 'Model' UNION SELECT src, dst FROM both_ways WHERE src LIKE 'model:%')"))
def context(t):
    return tr.context_summary(p.edges(t), _models(t), 2)


_SUBTREE = "subtree AS (SELECT src AS page, dst AS node FROM edges WHERE edge_type = 'Contains' AND src LIKE 'page:%' UNION ALL SELECT h.src, e.dst FROM edges e JOIN edges h ON h.dst = e.src AND h.edge_type = 'Contains' AND h.src LIKE 'page:%' WHERE e.edge_type = 'Triggers')"
_CLOSURE = "closure AS (SELECT page, dst AS node FROM subtree JOIN edges ON src = node WHERE dst LIKE 'model:%' OR dst LIKE 'field:%' UNION SELECT page, dst FROM closure JOIN edges ON src = node WHERE (src LIKE 'model:%' OR src LIKE 'field:%') AND (dst LIKE 'model:%' OR dst LIKE 'field:%'))"
_INDEX = "page_index AS (SELECT DISTINCT src AS node, src AS page FROM edges WHERE src LIKE 'page:%' UNION SELECT node, page FROM subtree UNION SELECT node, page FROM closure)"


@query("g02_page_subtree", p.sql("SELECT * FROM subtree", _SUBTREE))
def subtree(t):
    return tr.page_subtree(p.edges(t))


@query("g03_data_closure", p.sql("SELECT page, node FROM closure", _SUBTREE, _CLOSURE))
def data_closure(t):
    return tr.data_closure(p.edges(t))


@query("g04_page_index", p.sql("SELECT node, count(*) AS n_pages, min(page) AS first_page FROM page_index GROUP BY node", _SUBTREE, _CLOSURE, _INDEX))
def page_index(t):
    return tr.page_index(p.edges(t)).groupBy("node").agg(F.count("*").alias("n_pages"), F.min("page").alias("first_page"))


@query("t13_affected_pages", p.sql("SELECT DISTINCT page FROM page_index WHERE node IN (SELECT concat('model:part', p_partkey) FROM part WHERE p_size = 7)", _SUBTREE, _CLOSURE, _INDEX))
def affected_pages(t):
    dirty = t.part.where("p_size = 7").select(p.model_id("p_partkey").alias("node"))
    return tr.affected_pages(tr.page_index(p.edges(t)), dirty)


# the reference rule: Contains from components alone, a component before a page, stop before the page
_UP = "up AS (SELECT dst AS id, min(src) AS parent FROM edges WHERE edge_type = 'Contains' AND starts_with(src, 'comp:') GROUP BY dst)"
_ANCESTORS = "ancestors AS (SELECT id, parent AS ancestor, 1 AS distance FROM up UNION ALL SELECT a.id, u.parent, a.distance + 1 FROM ancestors a JOIN up u ON u.id = a.ancestor)"


@query("j13_ancestors", p.sql("SELECT * FROM ancestors", _UP, _ANCESTORS))
def ancestors(t):
    return tr.ancestors(p.edges(t))


@query("j16_nearest_reader", p.sql("SELECT id, arg_min(ancestor, distance) AS ancestor, min(distance) AS distance FROM ancestors WHERE ancestor IN (SELECT src FROM edges WHERE edge_type = 'Reads') GROUP BY id", _UP, _ANCESTORS))
def nearest_reader(t):
    e = p.edges(t)
    return tr.nearest(tr.ancestors(e), e.where("edge_type = 'Reads'").select(F.col("src").alias("id")).distinct())


@query("g29_inherited_conditions", p.sql("SELECT owner_id AS id, id AS condition, 0 AS distance FROM conditions WHERE effect_type = 'Show' UNION ALL SELECT a.id, c.id, a.distance FROM ancestors a JOIN conditions c ON c.owner_id = a.ancestor WHERE c.effect_type = 'Show'", _UP, _ANCESTORS))
def inherited(t):
    return cond.inherited(p.conditions(t), p.edges(t))


_PATHS = "paths AS (SELECT concat('app/n', c_nationkey, '.spg') AS page, concat('c', c_custkey) AS id, concat('canvas.components[', c_custkey % 7, '].components[', c_custkey % 3, ']', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '.actions[1]' END) AS json_path FROM customer UNION ALL SELECT concat('app/n', c_nationkey, '.spg'), concat('k', c_custkey), concat('canvas.components[', c_custkey % 7, ']') FROM customer WHERE c_custkey % 5 = 0)"


@query("j14_path_ancestors", f"WITH {_PATHS} SELECT b.id, a.id AS ancestor FROM paths a JOIN paths b ON a.page = b.page AND length(b.json_path) > length(a.json_path) AND starts_with(b.json_path, a.json_path) AND substr(b.json_path, length(a.json_path) + 1, 1) IN ('.', '[')")
def path_ancestors(t):
    key = F.col("c_custkey")
    deep = t.customer.select(p.page_path("c_nationkey").alias("page"), F.concat(F.lit("c"), key).alias("id"), F.concat(F.lit("canvas.components["), key % 7, F.lit("].components["), key % 3, F.lit("]"), F.when(key % 2 == 0, "").otherwise(".actions[1]")).alias("json_path"))
    shallow = t.customer.where("c_custkey % 5 = 0").select(p.page_path("c_nationkey").alias("page"), F.concat(F.lit("k"), key).alias("id"), F.concat(F.lit("canvas.components["), key % 7, F.lit("]")).alias("json_path"))
    return tr.prefix_ancestors(deep.unionByName(shallow))


@query("g05_dependency_graph", p.sql("SELECT page, component, count(*) AS n_refs, max(CASE WHEN component = ref THEN 1 ELSE 0 END) AS is_self FROM refs GROUP BY 1, 2"))
def dependency_graph(t):
    return p.component_refs(t).groupBy("page", "component").agg(F.count("*").alias("n_refs"), F.max((F.col("component") == F.col("ref")).cast("int")).alias("is_self"))


# a component's level is the length of its chain of references, which ends at one that has none; here every third component has none
_THIN = "thin AS (SELECT * FROM refs WHERE CAST(substr(component, 2) AS BIGINT) % 3 <> 0)"


@query("g06_levels", p.sql("SELECT page, component, max(level) AS level FROM walk GROUP BY 1, 2", _THIN, "walk AS (SELECT page, component, 0 AS level FROM refs WHERE CAST(substr(component, 2) AS BIGINT) % 3 = 0 UNION ALL SELECT t.page, t.component, w.level + 1 FROM thin t JOIN walk w ON w.page = t.page AND w.component = t.ref)"))
def levels(t):
    refs = p.component_refs(t)
    return tr.levels(refs.where("CAST(substring(component, 2) AS BIGINT) % 3 <> 0"), refs.select("page", "component"))


@query("g07_cycles", p.sql("SELECT page, array_to_string(path, '>') AS cycle FROM walk WHERE here = path[1]", "walk AS (SELECT page, [component] AS path, ref AS here FROM refs UNION ALL SELECT w.page, list_append(w.path, w.here), r.ref FROM walk w JOIN refs r ON r.page = w.page AND r.component = w.here WHERE w.here > w.path[1] AND NOT list_contains(w.path, w.here) AND len(w.path) < 4)"))
def cycles(t):
    return tr.cycles(p.component_refs(t), 4)


# cycles of any length; g07_cycles has those that recursive SQL can list
@query("g07_all_cycles")
def all_cycles(t):
    return tr.all_cycles(p.component_refs(t))


@query("g11_lineage", p.sql("SELECT model, upstream, min(depth) AS depth FROM walk WHERE depth > 0 AND upstream <> model GROUP BY 1, 2", "walk AS (SELECT src AS model, src AS upstream, 0 AS depth, [src] AS seen FROM edges WHERE edge_type = 'DataflowInput' UNION ALL SELECT w.model, e.dst, w.depth + 1, list_append(w.seen, e.dst) FROM walk w JOIN edges e ON e.src = w.upstream AND e.edge_type = 'DataflowInput' WHERE NOT list_contains(w.seen, e.dst))"))
def lineage(t):
    return dataflow.lineage(p.edges(t)).where("model <> upstream")


@query("g14_field_origins", p.sql("""SELECT src AS field, CASE WHEN last NOT IN (SELECT src FROM alias) THEN last END AS origin, CASE WHEN last NOT IN (SELECT src FROM alias) THEN 'proven' ELSE 'cycle' END AS status, CASE WHEN last NOT IN (SELECT src FROM alias) THEN CAST(hops AS BIGINT) END AS hops FROM (SELECT src, arg_max(here, hops) AS last, max(hops) AS hops FROM walk GROUP BY src)""",
 "alias AS (SELECT src, min(dst) AS dst FROM edges WHERE edge_type = 'FieldAlias' GROUP BY src)", "walk AS (SELECT src, dst AS here, 1 AS hops, [src, dst] AS seen FROM alias UNION ALL SELECT w.src, a.dst, w.hops + 1, list_append(w.seen, a.dst) FROM walk w JOIN alias a ON a.src = w.here WHERE NOT list_contains(w.seen, a.dst))"))
def field_origins(t):
    return dataflow.field_origins(p.edges(t))


# price fields are mapped, quantities of every fourth part are calculated, the others have what dataflows and dimensions say
_LINEAGE = """own AS (SELECT n.id AS field, n.name AS field_name, c.src AS model, m.name AS model_name, CAST(substr(c.src, 11) AS BIGINT) AS k FROM nodes n JOIN edges c ON c.dst = n.id AND c.edge_type = 'Contains' JOIN nodes m ON m.id = c.src WHERE n.node_type = 'Field'),
told AS (SELECT *, CASE WHEN field_name = 'price' AND k % 3 = 0 THEN concat('in', k % 7) END AS input_field, CASE WHEN field_name = 'qty' AND k % 4 = 0 THEN '=model1.x * 2' END AS expr, CASE WHEN k % 8 = 0 THEN ['model1'] ELSE CAST([] AS VARCHAR[]) END AS expr_models FROM own),
dims AS (SELECT concat('model:part', p_partkey) AS model, concat('d', p_partkey % 5) AS name, CASE WHEN p_partkey % 2 = 0 THEN 'qty' ELSE 'price' END AS dbfield FROM part),
ins AS (SELECT DISTINCT e.src, e.dst, n.name FROM edges e JOIN nodes n ON n.id = e.dst WHERE edge_type = 'DataflowInput'),
wrote AS (SELECT DISTINCT e.src, o.field FROM edges e JOIN own o ON e.dst = o.model AND e.field_path = o.field_name WHERE e.edge_type IN ('Writes', 'ActionWrites')),
found AS (SELECT field, 'input_field' AS source, concat('field:', model_name, '.', input_field) AS sources, NULL AS expr, model AS via, 'high' AS confidence FROM told WHERE input_field IS NOT NULL UNION ALL SELECT field, 'expression', array_to_string(list_transform(expr_models, lambda x: concat('model:', x)), ','), expr, model, CASE WHEN len(expr_models) > 0 THEN 'medium' ELSE 'low' END FROM told WHERE expr IS NOT NULL UNION ALL SELECT field, 'writer', '', NULL, src, 'high' FROM wrote),
rest AS (SELECT * FROM told WHERE field NOT IN (SELECT field FROM found)),
chained AS (SELECT DISTINCT field, CASE WHEN d.model IS NULL THEN 'input_node' ELSE 'input_dimension' END AS source, concat('field:', i.name, '.', coalesce(d.name, field_name)) AS sources, NULL AS expr, r.model AS via, 'medium' AS confidence FROM rest r JOIN ins i ON i.src = r.model LEFT JOIN dims d ON d.model = i.dst AND d.dbfield = r.field_name WHERE d.model IS NOT NULL OR concat('field:', i.name, '.', field_name) IN (SELECT id FROM nodes)
 UNION ALL SELECT DISTINCT field, 'producer_dimension', concat('field:', n.name, '.', d.name), NULL, e.src, 'medium' FROM rest r JOIN edges e ON e.dst = r.model AND e.edge_type = 'OutputsTo' JOIN nodes n ON n.id = e.src JOIN dims d ON d.model = e.src AND d.dbfield = r.field_name)"""


@query("g15_field_lineage", p.sql("SELECT * FROM found UNION ALL SELECT * FROM chained", _LINEAGE))
def field_lineage(t):
    # fields, what holds them and dataflows are fields and models (model.ENDPOINTS); of the edges each use takes its own kinds,
    # so neither is written whole
    n, e = settled(p.nodes(t).where("node_type IN ('Model', 'Field')")), p.edges(t)
    k = F.expr("cast(regexp_extract(id, '^field:part([0-9]+)', 1) AS BIGINT)")
    own = n.where("node_type = 'Field'").select(F.col("id").alias("field"), "name", k.alias("k"))
    expr = F.when((F.col("name") == "qty") & (F.col("k") % 4 == 0), "=model1.x * 2")
    fields = own.select("field", F.when((F.col("name") == "price") & (F.col("k") % 3 == 0), F.concat(F.lit("in"), F.col("k") % 7)).alias("input_field"), expr.alias("expr"), F.when(F.col("k") % 8 == 0, F.array(F.lit("model1"))).otherwise(F.expr("cast(array() as array<string>)")).alias("expr_models"))
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    dims = t.part.select(p.model_id(key).alias("model"), F.lit(0).alias("place"), F.concat(F.lit("d"), key % 5).alias("name"), F.when(key % 2 == 0, "qty").otherwise("price").alias("dbfield"), none.alias("input_field"), none.alias("exp"))
    return lineage_of.model_field_lineage(n, e, fields, dims).withColumn("sources", F.array_join("sources", ","))


@query("g16_table_lineage", "SELECT concat('t', l_orderkey) AS model, concat('f', l_linenumber) AS name, CASE l_returnflag WHEN 'R' THEN concat('in', s, ',model1.c', k, CASE WHEN l_linenumber % 2 = 0 THEN ',orig' ELSE '' END) WHEN 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'orig' ELSE '' END ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'orig' END END AS sources, CASE WHEN l_returnflag = 'A' THEN 'medium' ELSE 'high' END AS confidence FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS s, CASE WHEN l_returnflag IN ('R', 'A') THEN l_partkey % 9 END AS k FROM lineitem) WHERE l_returnflag IN ('R', 'A') OR l_linenumber % 2 = 0")
def table_lineage(t):
    flag = F.col("l_returnflag")
    exp = F.when(flag == "R", F.concat(F.lit("=model1.c"), F.col("l_partkey") % 9, F.lit(" + 1"))).when(flag == "A", F.concat(F.lit("=x"), F.col("l_partkey") % 9, F.lit(".value")))
    even = F.col("l_linenumber") % 2 == 0
    dims = t.lineitem.select(F.concat(F.lit("t"), "l_orderkey").alias("model"), F.concat(F.lit("f"), "l_linenumber").alias("name"), F.when(flag == "R", F.concat(F.lit("in"), "l_suppkey")).alias("input_field"), exp.alias("exp"), F.when(even, "orig").alias("original_field"), F.when(even, F.concat(F.lit("n"), F.col("l_linenumber") - 1)).alias("original_node"))
    return lineage_of.table_field_lineage(dims).select("model", "name", F.array_join("sources", ",").alias("sources"), "confidence")


_DF = """df_fields AS (SELECT concat('m', l_orderkey) AS model, concat('n', l_linenumber) AS node, 'f' AS name, concat('db', l_linenumber) AS dbfield, CASE WHEN l_linenumber > 1 THEN 'f' END AS original_field, CASE WHEN l_linenumber > 1 THEN concat('n', l_linenumber - 1) END AS original_node FROM lineitem GROUP BY ALL)"""


@query("g13_field_trace", "WITH RECURSIVE " + _DF + """, best AS (SELECT model, max(CAST(substr(node, 2) AS INTEGER)) AS top FROM df_fields GROUP BY model), walk AS (SELECT b.model, concat('n', top) AS node, concat('n', top, '.f') AS path, top AS k FROM best b UNION ALL SELECT w.model, concat('n', k - 1), concat(w.path, '<n', k - 1, '.f'), k - 1 FROM walk w JOIN df_fields f ON f.model = w.model AND f.node = w.node WHERE f.original_node IS NOT NULL),
 ended AS (SELECT w.*, f.node AS found FROM walk w LEFT JOIN df_fields f ON f.model = w.model AND f.node = w.node) SELECT model, 'f' AS field, path, CASE WHEN found IS NULL THEN 'unknown' ELSE 'origin' END AS stop FROM ended WHERE found IS NULL OR k = 1""")
def field_trace(t):
    n = F.col("l_linenumber")
    rows = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    fields = rows.select(F.concat(F.lit("m"), "l_orderkey").alias("model"), F.concat(F.lit("n"), n).alias("node"), F.lit("f").alias("name"), F.concat(F.lit("db"), n).alias("dbfield"), F.when(n > 1, "f").alias("original_field"), F.when(n > 1, F.concat(F.lit("n"), n - 1)).alias("original_node"))
    start = rows.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("top")).select(F.concat(F.lit("m"), "l_orderkey").alias("model"), F.concat(F.lit("n"), "top").alias("node"), F.lit("f").alias("field"))
    return dataflow.field_trace(fields, start)


@query("g25_visual_depth", p.sql("SELECT target, depth, depth >= 3 AS collapsed, count(*) AS n FROM (SELECT target, node, min(depth) AS depth FROM walk GROUP BY 1, 2) GROUP BY 1, 2", "links AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type IN ('Contains', 'Triggers', 'OutputsTo', 'DataflowInput'))", "walk AS (SELECT id AS target, id AS node, 0 AS depth FROM nodes WHERE node_type IN ('Page', 'Model') UNION SELECT target, dst, depth + 1 FROM walk JOIN links ON src = node WHERE depth < 4)"))
def visual_depth(t):
    e = p.edges(t).where("edge_type IN ('Contains', 'Triggers', 'OutputsTo', 'DataflowInput')")
    seeds = p.nodes(t).where("node_type IN ('Page', 'Model')").select(F.col("id").alias("target"), F.col("id").alias("node"))
    return tr.visual_depth(e, seeds, 4).groupBy("target", "depth", "collapsed").agg(F.count("*").alias("n"))


_ARCS = """weights(edge_type, f, b) AS (VALUES ('Reads', 1.0::DOUBLE, 0.25::DOUBLE), ('FieldAlias', 0.9, 0.9), ('DependsOn', 0.9, 0.25), ('DataflowInput', 0.8, 0.8), ('OutputsTo', 0.8, 0.8), ('Contains', 0.02, 0.02)),
arcs AS MATERIALIZED (SELECT src, dst, sum(w) / sum(sum(w)) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, f AS w FROM edges JOIN weights USING (edge_type) UNION ALL SELECT dst, src, b FROM edges JOIN weights USING (edge_type)) GROUP BY src, dst),
base AS MATERIALIZED (SELECT id AS node, 1.0::DOUBLE / count(*) OVER () AS seed FROM nodes WHERE node_type = 'Page')"""


def _rank_sql(rounds: int) -> str:
    parts, last = [_ARCS, "r0 AS (SELECT node, seed AS score FROM base)"], "r0"
    for k in range(1, rounds + 1):
        parts.append(f"""r{k} AS MATERIALIZED (SELECT node, sum(score) AS score FROM (SELECT dst AS node, sum(0.8 * score * p) AS score FROM {last} JOIN arcs ON src = node GROUP BY dst UNION ALL SELECT node, seed * (0.2 + 0.8 * coalesce((SELECT sum(score) FROM {last} WHERE node NOT IN (SELECT src FROM arcs)), 0)) FROM base) GROUP BY node)""")
        last = f"r{k}"
    return p.sql(f"SELECT node, round(score, 9) AS score FROM {last} WHERE score > 1e-12", *parts)


@query("a10_arc_weights", p.sql("SELECT src, count(*) AS n, round(sum(p), 6) AS total, round(max(p), 6) AS top FROM arcs GROUP BY src", _ARCS))
def arc_weights(t):
    rows = ranking.arcs(p.edges(t), "value_source")
    return rows.groupBy("src").agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("total"), F.round(F.max("p"), 6).alias("top"))


@query("g23_page_rank", _rank_sql(4))
def page_rank(t):
    seeds = p.nodes(t).where("node_type = 'Page'").select(F.col("id").alias("node"), F.lit(1.0).alias("score"))
    return ranking.page_rank(p.edges(t), seeds, "value_source", iterations=4, tolerance=0.0).where("score > 1e-12").select("node", F.round("score", 9).alias("score"))


# to the operator's own tolerance; g23_page_rank has the rounds that SQL can unroll
@query("g23_converged_page_rank")
def converged_page_rank(t):
    seeds = p.nodes(t).where("node_type = 'Page'").select(F.col("id").alias("node"), F.lit(1.0).alias("score"))
    return ranking.page_rank(p.edges(t), seeds, "value_source").select("node", F.round("score", 9).alias("score"))


_FILES = ("SELECT concat('f', o_custkey) AS path, max(o_orderkey) AS hash FROM orders {} GROUP BY 1", "o_orderstatus <> 'P'", "o_orderkey % 5 <> 0")


@query("t01_hash_diff", f"SELECT coalesce(b.path, n.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM ({_FILES[0].format('WHERE ' + _FILES[1])}) b FULL JOIN ({_FILES[0].format('WHERE ' + _FILES[2])}) n ON b.path = n.path WHERE b.path IS NULL OR n.path IS NULL OR b.hash <> n.hash")
def hash_diff(t):
    files = lambda where: t.orders.where(where).groupBy(F.concat(F.lit("f"), "o_custkey").alias("path")).agg(F.max("o_orderkey").alias("hash"))
    return rules.hash_diff(files(_FILES[1]), files(_FILES[2]))


@query("t02_batched_apply", "SELECT o_orderkey, concat('f', o_custkey) AS origin_file FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, concat('f', o_custkey) FROM orders WHERE o_orderstatus = 'P'")
def batched_apply(t):
    state = t.orders.select("o_orderkey", F.concat(F.lit("f"), "o_custkey").alias("origin_file"))
    changed = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", F.concat(F.lit("f"), "o_custkey").alias("origin_file"))
    return rules.applied(state, changed, changed)


@query("j18_stale_diagnostics", "SELECT d.path, d.hash FROM (SELECT concat('f', o_custkey) AS path, o_orderkey AS hash FROM orders) d WHERE (d.path, d.hash) NOT IN (SELECT concat('f', o_custkey), max(o_orderkey) FROM orders GROUP BY o_custkey)")
def stale(t):
    rows = t.orders.select(F.concat(F.lit("f"), "o_custkey").alias("path"), F.col("o_orderkey").alias("hash"))
    return rules.stale(rows, rows.groupBy("path").agg(F.max("hash").alias("hash")))


@query("a09_diagnostic_merge", "SELECT code, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT path) AS files, arg_min(sample, path) FILTER (sample <> '') AS sample FROM (SELECT concat('f', o_custkey) AS path, o_orderpriority AS code, count(*) AS n, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE concat('s', max(o_orderkey)) END AS sample FROM orders GROUP BY o_custkey, o_orderpriority) GROUP BY code")
def diagnostic_merge(t):
    rows = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("code")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("k"))
    return rules.diagnostic_merge(rows.select(F.concat(F.lit("f"), "o_custkey").alias("path"), "code", "n", F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("s"), "k")).alias("sample")))
