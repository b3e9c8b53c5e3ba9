"""Lookups, neighbours, contract and aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import ENDPOINTS
from ..operators import conditions as cond
from ..operators import lookup, neighbours, output, pattern, rules, search
from ..operators.traversal import settled
from ..sources import projection as p
from .registry import query

KEYWORDS = ["part1", "app/n3", "GERMANY", "o77", "qty", "customer#000000012"]
TARGETS = ["model:part12", "model:prat7", "comp:app/n3.spg|c9", "page:app/n77", "field:part5.qtx", "action:app/n1.spg|c1|o1"]
_PAGES = """, pages AS (SELECT dst AS id, src AS page FROM edges WHERE edge_type = 'Contains' AND src LIKE 'page:%' UNION ALL SELECT e.dst, h.src FROM edges e JOIN edges h ON h.dst = e.src AND h.edge_type = 'Contains' AND h.src LIKE 'page:%' WHERE e.edge_type = 'Triggers')"""


def _values(items) -> str:
    return ", ".join("('" + x.replace("'", "''") + "')" for x in items)


@query("a01_type_counts", p.sql("SELECT 'node' AS what, node_type AS kind, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY 2"))
def type_counts(t):
    return output.histogram(p.nodes(t), p.edges(t))


@query("j01_neighbours", p.sql("SELECT src AS id, 'out' AS direction, edge_type, dst AS neighbour, node_type AS neighbour_type FROM edges JOIN nodes ON id = dst UNION ALL SELECT dst, 'in', edge_type, src, node_type FROM edges JOIN nodes ON id = src"))
def neighbour_rows(t):
    return neighbours.neighbours(p.nodes(t), settled(p.edges(t).select("src", "dst", "edge_type")))  # read for both directions


@query("j02_readers_of_model", p.sql("SELECT dst AS model, count(*) AS n_readers, min(src) AS first_reader FROM edges WHERE edge_type = 'Reads' AND dst LIKE 'model:%' GROUP BY dst"))
def readers(t):
    return neighbours.readers(p.edges(t)).groupBy("model").agg(F.count("*").alias("n_readers"), F.min("reader").alias("first_reader"))


@query("j02b_all_readers", p.sql("SELECT dst AS model, count(*) AS n_readers FROM edges WHERE edge_type IN ('Reads', 'ActionReads') AND dst LIKE 'model:%' GROUP BY dst"))
def all_readers(t):
    return neighbours.all_readers(p.edges(t)).groupBy("model").agg(F.count("*").alias("n_readers"))


@query("j03_writers_of_model", p.sql("""SELECT e.dst AS model, count(*) AS n_writes, count(DISTINCT n.path) AS n_pages, min(e.src) AS first_writer, max(e.src) AS last_writer
FROM edges e JOIN nodes n ON n.id = e.src WHERE e.edge_type IN ('Writes', 'ActionWrites') GROUP BY e.dst ORDER BY n_writes DESC, model LIMIT 20"""))
def writers(t):
    """The flagship: which models are written, how often, from how many pages."""
    rows = neighbours.writers(p.edges(t)).join(p.nodes(t).select("id", "path"), F.col("writer") == F.col("id"))
    out = rows.groupBy("model").agg(F.count("*").alias("n_writes"), F.count_distinct("path").alias("n_pages"), F.min("writer").alias("first_writer"), F.max("writer").alias("last_writer"))
    return out.orderBy(F.desc("n_writes"), "model").limit(20)


@query("j04_dataflow_links", p.sql("""SELECT src AS model, CASE edge_type WHEN 'DataflowInput' THEN 'input' ELSE 'output' END AS relation, dst AS other FROM edges WHERE edge_type IN ('DataflowInput', 'OutputsTo')
UNION ALL SELECT dst, CASE edge_type WHEN 'DataflowInput' THEN 'consumed_by' ELSE 'produced_by' END, src FROM edges WHERE edge_type IN ('DataflowInput', 'OutputsTo')"""))
def dataflow_links(t):
    return neighbours.dataflow_links(p.edges(t))


@query("j06_parent_page", p.sql("SELECT * FROM pages", _PAGES.lstrip(", ")))
def parent_page(t):
    return neighbours.parent_pages(p.nodes(t), p.edges(t))


@query("a02_model_counts", p.sql("""SELECT id AS model, count(*) FILTER (k = 'read_by') AS read_by, count(*) FILTER (k = 'written_by') AS written_by, count(*) FILTER (k = 'input') AS input, count(*) FILTER (k = 'output') AS output, count(*) FILTER (k = 'produced_by') AS produced_by, count(*) FILTER (k = 'consumed_by') AS consumed_by
FROM nodes LEFT JOIN (SELECT dst AS model, CASE WHEN edge_type = 'Reads' THEN 'read_by' WHEN edge_type IN ('Writes', 'ActionWrites') THEN 'written_by' WHEN edge_type = 'DataflowInput' THEN 'consumed_by' WHEN edge_type = 'OutputsTo' THEN 'produced_by' END AS k FROM edges
 UNION ALL SELECT src, CASE edge_type WHEN 'DataflowInput' THEN 'input' WHEN 'OutputsTo' THEN 'output' END FROM edges) ON model = id WHERE node_type = 'Model' GROUP BY id"""))
def model_counts(t):
    return neighbours.model_counts(p.nodes(t), p.edges(t))


@query("j07_model_query", p.sql("""SELECT model, CASE WHEN n_readers > 0 AND n_writers > 0 THEN 'shared' WHEN n_writers > 0 THEN 'sink' ELSE 'source' END AS role, readers, writers, n_readers, n_writers, n_pages FROM
 (SELECT model, coalesce(string_agg(id, ',' ORDER BY id) FILTER (k = 'r' AND rk <= 5), '') AS readers, coalesce(string_agg(id, ',' ORDER BY id) FILTER (k = 'w' AND rk <= 5), '') AS writers, count(*) FILTER (k = 'r') AS n_readers, count(*) FILTER (k = 'w') AS n_writers, count(DISTINCT page) AS n_pages
  FROM (SELECT touch.*, page, row_number() OVER (PARTITION BY model, k ORDER BY touch.id) AS rk FROM touch LEFT JOIN pages ON pages.id = touch.id) GROUP BY model)""",
 _PAGES.lstrip(", "), "touch AS (SELECT DISTINCT dst AS model, src AS id, CASE edge_type WHEN 'Reads' THEN 'r' ELSE 'w' END AS k FROM edges WHERE edge_type IN ('Reads', 'Writes', 'ActionWrites') AND dst LIKE 'model:%')"))
def model_query(t):
    return neighbours.model_summary(p.nodes(t), p.edges(t))


@query("j08_page_query", p.sql("SELECT src AS page, 'out' AS direction, edge_type, count(*) AS n FROM edges WHERE src LIKE 'page:%' GROUP BY 1, 3 UNION ALL SELECT dst, 'in', edge_type, count(*) FROM edges WHERE dst LIKE 'page:%' GROUP BY 1, 3"))
def page_query(t):
    return neighbours.page_edges(p.edges(t))


# the reference rule: direct targets of two given nodes, one edge of each side
@query("j09_cross_relations", p.sql("SELECT a.src AS a, b.src AS b, a.dst AS target, min(a.edge_type) AS kind_a, min(b.edge_type) AS kind_b FROM asked JOIN edges a ON a.src = asked.a JOIN edges b ON b.src = asked.b AND b.dst = a.dst GROUP BY 1, 2, 3", "asked AS (SELECT concat('comp:app/n', x.c_nationkey, '.spg|c', x.c_custkey) AS a, concat('comp:app/n', y.c_nationkey, '.spg|c', y.c_custkey) AS b FROM customer x JOIN customer y ON y.c_custkey IN (x.c_custkey + 1, x.c_custkey + 2, x.c_custkey + 3))"))
def cross_relations(t):
    c = t.customer.select("c_custkey", p.component_id("c_nationkey", "c", "c_custkey").alias("a"))
    asked = c.withColumn("other", F.explode(F.sequence(F.col("c_custkey") + 1, F.col("c_custkey") + 3))).join(c.select(F.col("c_custkey").alias("other"), F.col("a").alias("b")), "other").select("a", "b")
    return neighbours.cross_relations(p.edges(t), asked)


@query("j12_conditions_of_node", p.sql("SELECT dst AS id, src AS condition FROM edges WHERE edge_type = 'DependsOn' AND src LIKE 'cond:%'"))
def conditions_of(t):
    return neighbours.conditions_of(p.edges(t), p.nodes(t))


@query("j15_alias_chain", p.sql("""SELECT DISTINCT r.src AS reader, r.dst AS field, a.dst AS physical, w.src AS writer FROM edges r JOIN edges a ON a.src = r.dst AND a.edge_type = 'FieldAlias' JOIN edges w ON w.edge_type = 'Writes' AND w.dst = concat('model:', regexp_extract(a.dst, '^field:([^.]+)', 1))
JOIN pages p ON p.id = r.src JOIN pages q ON q.id = w.src WHERE r.edge_type = 'Reads' AND r.field_path IS NOT NULL AND p.page <> q.page""", _PAGES.lstrip(", ")))
def alias_chain(t):
    return neighbours.alias_chain(p.edges(t), p.nodes(t))


@query("j17_dangling_edges", p.sql("SELECT edge_type, 'src' AS side, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM nodes) GROUP BY 1 UNION ALL SELECT edge_type, 'dst', count(*) FROM edges WHERE dst NOT IN (SELECT id FROM nodes) GROUP BY 1"))
def dangling(t):
    return neighbours.dangling(p.nodes(t), p.edges(t))


@query("j17_existing_edges", p.sql("SELECT DISTINCT * FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)"))
def existing(t):
    # written, or both joins would be made in each family's branch, with all nodes each time
    return neighbours.distinct_edges(neighbours.existing(settled(p.nodes(t).select("id")), settled(p.edges(t))))


_FIND = """SELECT keyword, rank, id, node_type, score, CASE WHEN score >= 100 THEN 'high' WHEN score >= 80 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, CAST(row_number() OVER (PARTITION BY keyword ORDER BY score DESC, id) AS INTEGER) AS rank FROM
 (SELECT keyword, id, node_type, CASE WHEN lower(id) = lower(keyword) OR lower(name) = lower(keyword) THEN 100 WHEN contains(lower(id), lower(keyword)) OR contains(lower(name), lower(keyword)) THEN 80 WHEN contains(lower(path), lower(keyword)) THEN 50 END AS score FROM nodes CROSS JOIN (VALUES {}) k(keyword) {}) WHERE score IS NOT NULL) WHERE rank <= 20"""


@query("p04_find", p.sql(_FIND.format(_values(KEYWORDS), "")))
def find(t):
    return lookup.find(p.nodes(t), KEYWORDS)


@query("p02_find_models", p.sql(_FIND.format(_values(["part1", "green"]), "WHERE contains(lower(node_type), 'model')")))
def find_models(t):
    return lookup.find(p.nodes(t), ["part1", "green"], node_type="model")


# every supplier and part, misspelt in one way or another, or without a kind
_TARGETS = """targets AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN concat('comp:app/n', s_nationkey, '.spg|S', s_suppkey) WHEN 1 THEN concat('comp:ap/n', s_nationkey, '.spg|s', s_suppkey, '0') WHEN 2 THEN concat('Supplier#', s_suppkey) ELSE concat('s', s_suppkey) END AS target FROM supplier
 UNION ALL SELECT CASE p_partkey % 5 WHEN 0 THEN concat('model:part', p_partkey) WHEN 1 THEN concat('model:prat', p_partkey) WHEN 2 THEN concat('field:part', p_partkey, '.pric') WHEN 3 THEN concat('page:part', p_partkey) ELSE concat('model:xpart', p_partkey, 'x') END FROM part)"""


def _targets(t):
    s, k = F.col("s_suppkey").cast("string"), F.col("p_partkey").cast("string")
    page = F.concat(F.lit("/n"), "s_nationkey", F.lit(".spg|"))
    way = F.col("s_suppkey") % 4
    suppliers = F.when(way == 0, F.concat(F.lit("comp:app"), page, F.lit("S"), s)).when(way == 1, F.concat(F.lit("comp:ap"), page, F.lit("s"), s, F.lit("0"))).when(way == 2, F.concat(F.lit("Supplier#"), s)).otherwise(F.concat(F.lit("s"), s))
    way = F.col("p_partkey") % 5
    parts = F.when(way == 0, F.concat(F.lit("model:part"), k)).when(way == 1, F.concat(F.lit("model:prat"), k)).when(way == 2, F.concat(F.lit("field:part"), k, F.lit(".pric"))).when(way == 3, F.concat(F.lit("page:part"), k)).otherwise(F.concat(F.lit("model:xpart"), k, F.lit("x")))
    return t.supplier.select(suppliers.alias("target")).unionByName(t.part.select(parts.alias("target")))


_KIND = "CASE WHEN regexp_matches({0}, '^(model|page|comp|action|field):') THEN split_part({0}, ':', 1) END"
_BARE = "CASE WHEN regexp_matches({0}, '^(model|page|comp|action|field):') THEN substr({0}, strpos({0}, ':') + 1) ELSE {0} END"


@query("p05_candidates", p.sql(f"""SELECT target, rank, id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT target, id,
 CASE WHEN tk IS NULL THEN CASE WHEN lower(name) = lower(target) OR lower(id) = lower(target) OR a = b THEN 100 WHEN contains(lower(name), lower(target)) OR contains(lower(id), lower(target)) THEN 80 WHEN contains(lower(path), lower(target)) THEN 50 END
 WHEN nk = tk THEN CASE WHEN a = b THEN 100 WHEN contains(a, b) OR contains(b, a) THEN 80 WHEN abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) = 1 THEN 55 WHEN abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) = 2 THEN 45 WHEN tk = 'comp' THEN 5 END
 WHEN b <> '' AND a = b THEN 70 END AS score
 FROM (SELECT id, name, path, {_KIND.format('id')} AS nk, lower({_BARE.format('id')}) AS a FROM nodes WHERE trim(name) <> '') CROSS JOIN (SELECT DISTINCT target, {_KIND.format('target')} AS tk, lower({_BARE.format('target')}) AS b FROM targets) WHERE id <> target) WHERE score IS NOT NULL) WHERE rank <= 5""", _TARGETS))
def candidates(t):
    return search.candidates(search.text_index(p.nodes(t)), _targets(t)).select("target", "rank", "id", "score")


@query("p04_find_many", p.sql("""SELECT keyword, rank, id, node_type, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY keyword ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT keyword, id, node_type, CASE WHEN lower(id) = lower(keyword) OR lower(name) = lower(keyword) THEN 100 WHEN contains(lower(id), lower(keyword)) OR contains(lower(name), lower(keyword)) THEN 80 WHEN contains(lower(path), lower(keyword)) THEN 50 END AS score FROM nodes CROSS JOIN keywords) WHERE score IS NOT NULL) WHERE rank <= 20""",
 "keywords AS (SELECT DISTINCT n_name AS keyword FROM nation UNION SELECT concat('n', n_nationkey, '.SPG') FROM nation UNION SELECT DISTINCT p_type FROM part UNION SELECT concat('S', s_suppkey) FROM supplier)"))
def find_many(t):
    words = t.nation.select(F.col("n_name").alias("keyword")).union(t.nation.select(F.concat(F.lit("n"), "n_nationkey", F.lit(".SPG")))).union(t.part.select("p_type")).union(t.supplier.select(F.concat(F.lit("S"), "s_suppkey")))
    return search.find(search.text_index(p.nodes(t)), words.distinct())


@query("p07_bare_targets", p.sql("""SELECT name, CASE WHEN n = 0 THEN 'not_found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, coalesce(ids, '') AS ids FROM (SELECT k.name, count(id) AS n, string_agg(id, ',' ORDER BY id) FILTER (r <= 20) AS ids FROM keys k LEFT JOIN (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id) AS r FROM (SELECT k.name AS key, n.id FROM keys k JOIN nodes n ON lower(n.name) = lower(k.name) UNION SELECT k.name, n.id FROM keys k JOIN nodes n ON lower(n.id) = lower(k.name))) m ON m.key = k.name GROUP BY k.name)""",
 "keys AS (SELECT DISTINCT n_name AS name FROM nation UNION SELECT concat('o', o_orderkey) FROM orders UNION SELECT s_name FROM supplier UNION SELECT concat('page:app/n', n_nationkey, '.SPG') FROM nation UNION SELECT concat('nobody', n_nationkey) FROM nation UNION SELECT 'qty')"))
def bare_targets(t):
    page = F.concat(F.lit("page:app/n"), "n_nationkey", F.lit(".SPG"))
    names = t.nation.select(F.col("n_name").alias("name")).union(t.orders.select(F.concat(F.lit("o"), "o_orderkey"))).union(t.supplier.select("s_name")).union(t.nation.select(page)).union(t.nation.select(F.concat(F.lit("nobody"), "n_nationkey"))).union(t.spark.createDataFrame([("qty",)], "name string"))
    return search.resolve_exact(search.text_index(p.nodes(t)), names.distinct())


_NAMED = [f"c{k}" for k in (1, 2, 999999)] + ["part3", "price", "s1"]


@query("p08_resolve_bare", p.sql(f"SELECT name, CASE count(id) WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids FROM (VALUES {_values(_NAMED)}) k(name) LEFT JOIN (SELECT id, split_part(substr(id, strpos(id, ':') + 1), '|', -1) AS local FROM nodes WHERE id LIKE 'comp:%') ON local = name GROUP BY name"))
def resolve(t):
    return lookup.resolve_bare(p.nodes(t), t.spark.createDataFrame([(x,) for x in _NAMED], "name string"), "comp")


_LOOSE = ["model:PART5", "page:n3", "page:app/n3", "page:APP/n3.SPG", "comp:part9", "dataflow:part7", "field:x|part2.qty", "model:part8", "page:nowhere", "model:shop|part8", "model:part8.qty.sum", "comp:app/n3.spg|zz", "comp:n4", "comp:c7", "comp:gone/p.spg|c9", "action:o33", "action:n5", "widget:part1", "part1"]


# the reference rule: target normalisation by six tiers, one id resolves, several are ambiguous
@query("p06_normalise_targets", p.sql(f"""SELECT target, coalesce(tier, -1) AS tier, CASE WHEN tier IS NULL THEN 'not_found' WHEN tier = 0 THEN 'exact' WHEN len(every) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, coalesce(array_to_string(every[1:12], ','), '') AS ids
FROM (SELECT target, min(best) AS tier, list(DISTINCT id ORDER BY id) FILTER (tier = best) AS every FROM (SELECT *, min(tier) OVER (PARTITION BY target) AS best FROM (SELECT target, id,
 CASE WHEN id = target THEN 0 WHEN hk <> wk THEN CASE WHEN lower(hc) = lower(wc) THEN 2 END WHEN len(h) = len(w) AND h[2:] = w[2:] AND fits THEN 1 WHEN len(h) > len(w) AND fits AND h[2:len(w)] = w[2:] THEN 3
 WHEN len(h) < len(w) AND w[len(w) - len(h) + 1:] = h THEN 4 WHEN len(w) = 1 AND (n = f OR ends_with(n, concat('/', f))) THEN 5 WHEN len(w) >= 2 AND len(h) = len(w) AND h[2:] = w[2:] THEN 6 END AS tier
 FROM (SELECT *, regexp_replace(h[1], '\\.(spg|tbl)$', '') = f OR ends_with(regexp_replace(h[1], '\\.(spg|tbl)$', ''), concat('/', f)) AS fits, regexp_replace(h[-1], '\\.(spg|tbl)$', '') AS n FROM (SELECT target, id, split_part(target, ':', 1) AS wk, split_part(id, ':', 1) AS hk,
 substr(target, strpos(target, ':') + 1) AS wc, substr(id, strpos(id, ':') + 1) AS hc, string_split(lower(substr(target, strpos(target, ':') + 1)), '|') AS w, string_split(lower(substr(id, strpos(id, ':') + 1)), '|') AS h,
 regexp_replace(string_split(lower(substr(target, strpos(target, ':') + 1)), '|')[1], '\\.(spg|tbl)$', '') AS f
 FROM (VALUES {_values(_LOOSE)}) k(target) LEFT JOIN nodes ON regexp_matches(target, '^(comp|action|field|model|page|dataflow):') AND regexp_matches(id, '^(comp|action|field|model|page|dataflow):')))) ) GROUP BY target)"""))
def normalise(t):
    return lookup.normalise_targets(p.nodes(t), t.spark.createDataFrame([(x,) for x in _LOOSE], "target string"))


@query("p11_prefix", p.sql("SELECT id FROM nodes WHERE starts_with(id, 'model:part1') ORDER BY id"))
def prefix(t):
    return lookup.with_prefix(p.nodes(t), "model:part1")


_ODD = "SELECT 'part9' AS id, 'Model' AS node_type, 'x' AS name UNION ALL SELECT 'comp:app/x.spg', 'Component', 'x' UNION ALL SELECT 'model:z', 'Model', ' ' UNION ALL SELECT 'w:1', 'Widget', 'x' UNION ALL SELECT 'param:a', 'Field', 'a' UNION ALL SELECT 'field:b', 'Field', NULL"


@query("p14_node_violations", p.sql(f"""SELECT id, unnest(list_filter([CASE WHEN pre IS NULL THEN 'unknown_type' END, CASE WHEN NOT starts_with(id, pre) AND NOT sym THEN 'wrong_prefix' END, CASE WHEN starts_with(id, pre) AND NOT form THEN 'bad_id' END, CASE WHEN coalesce(trim(name), '') = '' THEN 'missing_name' END], lambda x: x IS NOT NULL)) AS violation FROM (SELECT *, CASE node_type WHEN 'Component' THEN regexp_matches(id, '^comp:[^|]+\\|[^|]+$') WHEN 'Action' THEN regexp_matches(id, '^action:[^|]+\\|[^|]+\\|[^|]+$') WHEN 'Field' THEN sym OR regexp_matches(id, '^field:.+\\.[^.]+$') ELSE true END AS form FROM
 (SELECT *, CASE node_type WHEN 'Page' THEN 'page:' WHEN 'Component' THEN 'comp:' WHEN 'Model' THEN 'model:' WHEN 'Field' THEN 'field:' WHEN 'Action' THEN 'action:' WHEN 'Condition' THEN 'cond:' END AS pre, node_type = 'Field' AND (starts_with(id, 'param:') OR starts_with(id, 'user:') OR starts_with(id, 'system:')) AS sym FROM (SELECT id, node_type, name FROM nodes UNION ALL {_ODD})))"""))
def node_violations(t):
    return rules.node_violations(p.nodes(t).select("id", "node_type", "name").unionByName(t.spark.sql(_ODD)))


_WRONG = "SELECT 'model:part1' AS src, 'page:app/n1.spg' AS dst, 'Reads' AS edge_type, CAST(NULL AS STRING) AS field_path UNION ALL SELECT 'page:app/n1.spg', 'page:app/n2.spg', 'OpensPage', NULL UNION ALL SELECT 'x', 'page:app/n2.spg', 'Likes', NULL UNION ALL SELECT 'field:part1.qty', 'field:part2.qty', 'FieldAlias', NULL"
_PAIRS = ", ".join(f"('{k}', '{a}', '{b}')" for k, v in ENDPOINTS.items() for a, b in v)


@query("p15_edge_violations", p.sql(f"""SELECT src, dst, edge_type, unnest(list_filter([CASE WHEN edge_type IN ('OpensPage', 'SetsParam', 'DataflowInternal') THEN 'never_emitted' WHEN edge_type NOT IN (SELECT k FROM pairs) THEN 'unknown_type' END, CASE WHEN st IS NULL OR dt IS NULL THEN 'missing_end' END,
 CASE WHEN st IS NOT NULL AND dt IS NOT NULL AND edge_type IN (SELECT k FROM pairs) AND (edge_type, st, dt) NOT IN (SELECT k, a, b FROM pairs) THEN 'bad_endpoints' END, CASE WHEN edge_type IN ('FieldWrite', 'FieldAlias') AND field_path IS NULL THEN 'missing_field_path' END], lambda x: x IS NOT NULL)) AS violation
 FROM (SELECT e.*, a.node_type AS st, b.node_type AS dt FROM (SELECT src, dst, edge_type, field_path FROM edges UNION ALL {_WRONG}) e LEFT JOIN nodes a ON a.id = src LEFT JOIN nodes b ON b.id = dst)""", f"pairs(k, a, b) AS (VALUES {_PAIRS})"))
def edge_violations(t):
    return rules.edge_violations(p.nodes(t), p.edges(t).select("src", "dst", "edge_type", "field_path").unionByName(t.spark.sql(_WRONG)))


@query("a03_field_types", "SELECT p_brand AS model, count(*) AS n, string_agg(concat(k, '=', c), ',' ORDER BY k) AS types FROM (SELECT p_brand, CASE WHEN p_size % 2 = 0 THEN 'N' ELSE 'C' END AS k, count(*) AS c FROM part GROUP BY 1, 2) GROUP BY 1".replace("count(*) AS n", "CAST(sum(c) AS BIGINT) AS n"))
def field_types(t):
    return output.field_types(t.part.select(F.col("p_brand").alias("model"), F.when(F.col("p_size") % 2 == 0, "N").otherwise("C").alias("data_type")))


@query("a04_evidence_summary", p.sql("SELECT path, count(*) AS total, least(count(*), 5) AS shown, count(*) FILTER (conf = 'high') AS high, count(*) FILTER (conf = 'low') AS low, bool_or(conf = 'low') AS derived FROM (SELECT path, CASE WHEN node_type IN ('Page', 'Model') THEN 'high' WHEN node_type = 'Condition' THEN 'low' ELSE 'medium' END AS conf FROM nodes) GROUP BY path"))
def evidence(t):
    conf = F.when(F.col("node_type").isin("Page", "Model"), "high").when(F.col("node_type") == "Condition", "low").otherwise("medium")
    return output.evidence_summary(p.nodes(t).select("path", conf.alias("confidence")), "path")


@query("a05_condition_dedup", p.sql("SELECT page, condition_type, effect_type, raw_expr AS expr, refs, min(id) AS condition_id, count(*) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, count(DISTINCT owner_id) AS n_owners FROM (SELECT *, array_to_string(list_sort(list_distinct(referenced_symbols)), ',') AS refs FROM conditions) GROUP BY 1, 2, 3, 4, 5"))
def condition_dedup(t):
    return cond.deduplicated(p.conditions(t)).select("page", "condition_type", "effect_type", "expr", "refs", "condition_id", "n", "ids", "n_owners")


@query("a07_source_groups", p.sql("SELECT path, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM nodes GROUP BY path HAVING count(*) >= 2"))
def source_groups(t):
    return p.nodes(t).groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("n >= 2")


_CONTRIB = "contributions AS (SELECT concat('orders', o_orderkey % 97, '.spg') AS origin_file, CASE WHEN o_orderstatus = 'F' THEN 'Definition' ELSE 'Reference' END AS kind, concat('model:c', o_custkey) AS entity_id, concat('{\"p\":', o_orderkey, '}') AS payload FROM orders)"


def _contributions(t):
    return t.orders.select(F.concat(F.lit("orders"), F.col("o_orderkey") % 97, F.lit(".spg")).alias("origin_file"), F.when(F.col("o_orderstatus") == "F", "Definition").otherwise("Reference").alias("kind"), F.concat(F.lit("model:c"), "o_custkey").alias("entity_id"), F.concat(F.lit('{"p":'), "o_orderkey", F.lit("}")).alias("payload"))


@query("a08_provenance_conflicts", f"WITH {_CONTRIB} SELECT entity_id, string_agg(DISTINCT origin_file, ',' ORDER BY origin_file) AS origins FROM contributions WHERE kind = 'Definition' GROUP BY 1 HAVING count(DISTINCT origin_file) > 1")
def provenance_conflicts(t):
    return rules.conflicts(_contributions(t))


@query("t04_provenance_rebuild", f"WITH {_CONTRIB} SELECT entity_id, CASE kind WHEN 'Definition' THEN 'Definition' ELSE 'Placeholder' END AS kind, origin_file, payload FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY kind, origin_file, payload) AS rn FROM contributions) WHERE rn = 1")
def provenance_rebuild(t):
    return rules.rebuilt(_contributions(t))


@query("u06_multiset_difference", p.sql("SELECT src, dst, edge_type, 'left' AS side FROM (SELECT src, dst, edge_type FROM edges EXCEPT ALL SELECT src, dst, edge_type FROM edges WHERE edge_type <> 'OutputsTo')"))
def multiset_difference(t):
    e = settled(p.edges(t).select("src", "dst", "edge_type"))
    return rules.multiset_difference(e, e.where("edge_type <> 'OutputsTo'"))


@query("s04_upsert_merge", """SELECT id, arg_max(model_type, (real, seq)) AS model_type, arg_max(meta, (real, has, seq)) AS meta, max(seq) AS seq FROM (SELECT *, model_type <> 'PhysicalTable' AS real, meta IS NOT NULL AS has FROM
 (SELECT concat('model:c', o_custkey) AS id, CASE WHEN o_orderstatus = 'P' THEN 'DataFlow' ELSE 'PhysicalTable' END AS model_type, concat('m', o_orderkey) AS meta, o_orderkey AS seq FROM orders)) GROUP BY id""")
def upsert_merge(t):
    return rules.merged_nodes(t.orders.select(F.concat(F.lit("model:c"), "o_custkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "DataFlow").otherwise("PhysicalTable").alias("model_type"), F.concat(F.lit("m"), "o_orderkey").alias("meta"), F.col("o_orderkey").alias("seq")))


@query("a13_condition_index", p.sql("SELECT owner_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS conditions FROM conditions GROUP BY owner_id"))
def condition_index(t):
    return cond.index(p.conditions(t))


# some conditions that ask for a number of rows and some that disable
_VARIED = "varied AS (SELECT id, owner_id, CASE WHEN length(id) % 4 = 0 THEN 'DisableCondition' WHEN length(id) % 4 = 1 THEN 'CalcCondition' ELSE condition_type END AS condition_type, CASE WHEN length(owner_id) % 3 = 0 THEN concat(raw_expr, ' + model1.totalRowCount__') ELSE raw_expr END AS raw_expr FROM conditions)"


def _varied(t):
    n = F.length("id")
    kind = F.when(n % 4 == 0, "DisableCondition").when(n % 4 == 1, "CalcCondition").otherwise(F.col("condition_type"))
    expr = F.when(F.length("owner_id") % 3 == 0, F.concat("raw_expr", F.lit(" + model1.totalRowCount__"))).otherwise(F.col("raw_expr"))
    return p.conditions(t).withColumn("condition_type", kind).withColumn("raw_expr", expr)


# the reference rule: five blocking types, then filters and totalRowCount__
@query("g31_condition_classes", p.sql("SELECT id, CASE WHEN condition_type IN ('VisibleCondition', 'DisableCondition', 'EnableCondition', 'ActionCondition', 'ActionConditionExp') THEN 'blocking' WHEN strpos(condition_type, 'Filter') > 0 OR strpos(raw_expr, 'totalRowCount__') > 0 THEN 'data_empty' ELSE 'supporting' END AS class FROM varied", _VARIED))
def condition_classes(t):
    return _varied(t).select("id", cond.condition_class(F.col("condition_type"), F.col("raw_expr")).alias("class"))


@query("g38_availability", p.sql("SELECT e.dst AS model, count(DISTINCT c.id) FILTER (effect_type = 'Show') AS n_blocking, count(DISTINCT c.id) FILTER (effect_type = 'Filter') AS n_data_empty, count(DISTINCT c.owner_id) AS n_components FROM edges e JOIN conditions c ON c.owner_id = e.src WHERE e.edge_type = 'Reads' AND e.dst LIKE 'model:%' GROUP BY 1"))
def availability(t):
    return cond.availability(p.conditions(t), p.edges(t))


# the reference rule: referenced models and components, and 3 for an entry point, 2 for a main panel, else 1
@query("k10_impact", p.sql("SELECT id, CASE WHEN length(id) % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN length(id) % 4 = 0 OR length(id) % 5 = 0 THEN 3 WHEN length(id) % 7 = 0 THEN 1 ELSE 2 END AS score FROM conditions"))
def impact(t):
    n = F.length("id")
    rows = p.conditions(t).withColumn("referenced_symbols", F.when(n % 3 == 0, F.concat("referenced_symbols", F.array(F.lit("model:a"), F.lit("comp:b")))).otherwise(F.col("referenced_symbols")))
    rows = rows.withColumn("owner_id", F.when(n % 4 == 0, "action:x").when(n % 7 == 0, "page:x").otherwise(F.col("owner_id"))).withColumn("effect_type", F.when(n % 5 == 0, "Execute").otherwise(F.col("effect_type")))
    return cond.impact(rows)


@query("a12_page_roles", p.sql("""SELECT page, n_entry, n_write, n_jump, CASE WHEN n_entry = 0 THEN 'readonly_dashboard' WHEN n_write > 0 AND n_jump > 0 THEN 'mixed_interaction_page' WHEN n_write > 0 THEN 'data_maintenance_page' WHEN n_jump > 0 THEN 'navigation_page' ELSE 'unknown' END AS role
FROM (SELECT n.id AS page, count(DISTINCT e.src) FILTER (e.edge_type = 'Triggers') AS n_entry, count(*) FILTER (e.edge_type IN ('Writes', 'ActionWrites')) AS n_write, count(*) FILTER (e.edge_type = 'ActionNavigates') AS n_jump FROM nodes n LEFT JOIN pages p ON p.page = n.id LEFT JOIN edges e ON e.src = p.id WHERE n.node_type = 'Page' GROUP BY 1)""", _PAGES.lstrip(", ")))
def page_roles(t):
    return output.page_roles(p.nodes(t), p.edges(t))


@query("g35_page_logic", p.sql("""SELECT n.id AS page, count(DISTINCT CASE WHEN e.edge_type = 'Triggers' THEN e.dst END) AS n_actions, count(DISTINCT CASE WHEN e.edge_type IN ('Reads', 'ActionReads') AND e.dst LIKE 'model:%' THEN e.dst END) AS n_sources, count(DISTINCT CASE WHEN e.edge_type IN ('Writes', 'ActionWrites') THEN e.dst END) AS n_sinks, count(DISTINCT CASE WHEN e.edge_type = 'ActionNavigates' THEN e.dst END) AS n_targets,
 coalesce(string_agg(DISTINCT CASE WHEN e.edge_type = 'ActionNavigates' THEN e.dst END, ',' ORDER BY CASE WHEN e.edge_type = 'ActionNavigates' THEN e.dst END), '') AS targets FROM nodes n LEFT JOIN pages p ON p.page = n.id LEFT JOIN edges e ON e.src = p.id WHERE n.node_type = 'Page' GROUP BY 1""", _PAGES.lstrip(", ")))
def page_logic(t):
    return output.page_logic(p.nodes(t), p.edges(t))


@query("g36_page_risks", p.sql("""SELECT page, unnest(list_filter([CASE WHEN n_entry = 0 THEN 'NO_ENTRYPOINT' END, CASE WHEN n_write = 0 THEN 'NO_WRITES' END, CASE WHEN n_jump = 0 THEN 'NO_NAVIGATION' END, CASE WHEN n_self > 0 THEN 'SELF_NAVIGATION' END], lambda x: x IS NOT NULL)) AS risk FROM
 (SELECT n.id AS page, count(DISTINCT e.src) FILTER (e.edge_type = 'Triggers') AS n_entry, count(*) FILTER (e.edge_type IN ('Writes', 'ActionWrites')) AS n_write, count(*) FILTER (e.edge_type = 'ActionNavigates') AS n_jump, count(*) FILTER (e.edge_type = 'ActionNavigates' AND e.dst = n.id) AS n_self FROM nodes n LEFT JOIN pages p ON p.page = n.id LEFT JOIN edges e ON e.src = p.id WHERE n.node_type = 'Page' GROUP BY 1)""", _PAGES.lstrip(", ")))
def page_risks(t):
    return output.page_risks(p.nodes(t), p.edges(t))


@query("g39_action_flows", p.sql("SELECT src AS action, count(*) FILTER (edge_type = 'ActionReads') AS n_reads, count(*) FILTER (edge_type = 'ActionWrites') AS n_writes, count(*) FILTER (edge_type = 'ActionLoadsData') AS n_loads, count(*) FILTER (edge_type = 'FieldWrite') AS n_fields, max(CASE WHEN edge_type = 'ActionNavigates' THEN dst END) AS goes_to, CASE WHEN count(*) FILTER (edge_type = 'ActionWrites') > 0 THEN 'data_write' WHEN count(*) FILTER (edge_type = 'ActionNavigates') > 0 THEN 'navigation' ELSE 'data_read' END AS category FROM edges WHERE src LIKE 'action:%' GROUP BY 1"))
def action_flows(t):
    return output.action_flows(p.edges(t))


@query("k06_truncated_lists", p.sql("SELECT src AS id, count(*) AS total, least(count(*), 5) AS shown, greatest(count(*) - 5, 0) AS remaining, array_to_string(list_sort(list(dst))[1:5], ',') AS items FROM edges WHERE edge_type = 'Contains' GROUP BY 1"))
def truncated(t):
    return output.truncated(p.edges(t).where("edge_type = 'Contains'"), "src", "dst", 5)


@query("k09_visual_cut", p.sql("SELECT src, dst, edge_type FROM (SELECT DISTINCT src, dst, edge_type FROM edges JOIN picked a ON a.id = src JOIN picked b ON b.id = dst) ORDER BY src, dst, edge_type LIMIT 500", "picked AS (SELECT id FROM nodes ORDER BY id LIMIT 20000)"))
def visual_cut(t):
    return output.visual_cut(p.nodes(t), p.edges(t), 20000, 500)


_KINDS = ("dialog", "input", "text", "button", "datePicker", "list", "panel")


# the reference rule: node type, component type, and what a node's edges do
@query("g28_importance", p.sql(f"""SELECT id, CASE node_type WHEN 'Page' THEN CASE WHEN nav OR wr THEN 'entrypoint' ELSE 'container' END WHEN 'Component' THEN CASE WHEN kind IN ('dialog', 'panel', 'embedsuperpage', 'form') THEN 'container' WHEN kind IN ('input', 'textarea', 'select', 'radio', 'checkbox', 'datePicker', 'number', 'search') THEN 'form_input'
 WHEN kind = 'text' AND rd THEN 'data_source_display' WHEN act THEN 'entrypoint' WHEN wr THEN 'action_target' WHEN rd THEN 'data_source_display' ELSE 'static_display' END WHEN 'Action' THEN CASE WHEN nav THEN 'entrypoint' WHEN wr THEN 'action_target' WHEN rd THEN 'data_source_display' ELSE 'static_display' END
 WHEN 'Condition' THEN 'condition' ELSE CASE WHEN wr THEN 'action_target' WHEN rd THEN 'data_source_display' ELSE 'unknown' END END AS importance
FROM (SELECT n.id, node_type, list_value({", ".join(f"'{k}'" for k in _KINDS)})[length(n.id) % {len(_KINDS)} + 1] AS kind, coalesce(bool_or(e.edge_type IN ('ActionNavigates', 'OpensPage')), false) AS nav, coalesce(bool_or(e.edge_type IN ('Writes', 'ActionWrites', 'FieldWrite')), false) AS wr, coalesce(bool_or(e.edge_type IN ('Reads', 'ActionReads')), false) AS rd, coalesce(bool_or(e.edge_type = 'Triggers'), false) AS act
 FROM nodes n LEFT JOIN (SELECT src AS id, edge_type FROM edges WHERE NOT regexp_matches(src, '^(model|field):') UNION ALL SELECT dst, edge_type FROM edges WHERE regexp_matches(dst, '^(model|field):')) e ON e.id = n.id GROUP BY n.id, node_type)"""))
def importances(t):
    from ..functions.actions import importance

    e = p.edges(t)
    data = lambda c: F.col(c).startswith("model:") | F.col(c).startswith("field:")
    ends = e.where(~data("src")).select(F.col("src").alias("id"), "edge_type").unionByName(e.where(data("dst")).select(F.col("dst").alias("id"), "edge_type"))
    any_ = lambda *kinds: F.coalesce(F.bool_or(F.col("edge_type").isin(*kinds)), F.lit(False))
    does = ends.groupBy("id").agg(any_("ActionNavigates", "OpensPage").alias("nav"), any_("Writes", "ActionWrites", "FieldWrite").alias("wr"), any_("Reads", "ActionReads").alias("rd"), any_("Triggers").alias("act"))
    rows = p.nodes(t).select("id", "node_type").join(does, "id", "left").na.fill(False)
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), F.length("id") % len(_KINDS))
    return rows.select("id", importance(F.col("node_type"), kind, F.col("nav"), F.col("wr"), F.col("rd"), F.col("act")).alias("importance"))


GQL = {
    "g26_gql_writes": ("MATCH (p:Page)-[:Contains]->(c:Component)-[:Triggers]->(a:Action)-[:ActionWrites]->(m:Model) RETURN p.id AS page, count(DISTINCT m) AS models, count(*) AS paths ORDER BY page", "SELECT p.src AS page, count(DISTINCT w.dst) AS models, count(*) AS paths FROM edges p JOIN edges t ON t.src = p.dst AND t.edge_type = 'Triggers' JOIN edges w ON w.src = t.dst AND w.edge_type = 'ActionWrites' WHERE p.edge_type = 'Contains' AND p.src LIKE 'page:%' GROUP BY 1"),
    "g26_gql_where": ("MATCH (c:Component)-[r:Reads|Writes]->(m:Model) WHERE m.id STARTS WITH 'model:part1' AND NOT c.path CONTAINS 'n1' RETURN DISTINCT c.id AS component, r.edge_type AS kind, m.name AS model", "SELECT DISTINCT c.id AS component, e.edge_type AS kind, m.name AS model FROM edges e JOIN nodes c ON c.id = e.src JOIN nodes m ON m.id = e.dst WHERE e.edge_type IN ('Reads', 'Writes') AND c.node_type = 'Component' AND m.node_type = 'Model' AND starts_with(m.id, 'model:part1') AND NOT contains(c.path, 'n1')"),
    "g26_gql_optional": ("MATCH (m:Model) OPTIONAL MATCH (m)-[i:DataflowInput]->(u:Model) RETURN m.id AS model, u.id AS input", "SELECT m.id AS model, e.dst AS input FROM nodes m LEFT JOIN edges e ON e.src = m.id AND e.edge_type = 'DataflowInput' WHERE m.node_type = 'Model'"),
    "g26_gql_reverse": ("MATCH (m:Model)<-[:ActionReads]-(a:Action)<-[:Triggers]-(c:Component) RETURN m.id AS model, count(DISTINCT c) AS components", "SELECT r.dst AS model, count(DISTINCT t.src) AS components FROM edges r JOIN edges t ON t.dst = r.src AND t.edge_type = 'Triggers' WHERE r.edge_type = 'ActionReads' GROUP BY 1"),
}
for _name, (_text, _check) in GQL.items():
    query(_name, p.sql(_check))(lambda t, text=_text: pattern.run(p.nodes(t), p.edges(t), text))
