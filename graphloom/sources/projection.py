"""The driver's relational tables as a metadata graph.

Nations are pages, suppliers container components, customers components inside them, orders actions, parts models with
two fields each, and urgent or low orders carry conditions. Every edge family is its own branch of a union with a
literal edge_type, so that a filter on edge_type prunes whole branches at planning time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Tables:
    """Column-pruned readers of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def page_id(key: Column | str) -> Column:
    return F.concat(F.lit("page:app/n"), key, F.lit(".spg"))


def page_path(key: Column | str) -> Column:
    return F.concat(F.lit("app/n"), key, F.lit(".spg"))


def component_id(nation: str, kind: str, key: str) -> Column:
    return F.concat(F.lit("comp:app/n"), nation, F.lit(f".spg|{kind}"), key)


def model_id(key: Column | str) -> Column:
    return F.concat(F.lit("model:part"), key)


def field_id(key: Column | str, name: Column) -> Column:
    return F.concat(F.lit("field:part"), key, F.lit("."), name)


def _action_id(nation: str) -> Column:
    return F.concat(F.lit("action:app/n"), nation, F.lit(".spg|c"), "c_custkey", F.lit("|o"), "o_orderkey")


def actions(t: Tables) -> DataFrame:
    """(o_orderkey, nation, status, priority, comp, action): one row for each order with its customer's component."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_custkey", F.col("c_nationkey").alias("nation"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        component_id("c_nationkey", "c", "c_custkey").alias("comp"),
        _action_id("c_nationkey").alias("action"),
    )


def conditions(t: Tables) -> DataFrame:
    """Condition records of urgent (display) and low (filter) orders."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    cust, order = F.col("c_custkey").cast("string"), F.col("o_orderkey").cast("string")
    expr = F.concat(F.lit("=c"), (F.col("c_custkey") % 50).cast("string"), F.lit(".value > "), (F.col("o_orderkey") % 7).cast("string"))
    rows = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.concat(F.lit("cond:app/n"), "c_nationkey", F.lit(".spg|c"), cust, F.when(urgent, "#visibleCondition#").otherwise("#itemFilter#"), order).alias("id"),
        page_path("c_nationkey").alias("page"),
        component_id("c_nationkey", "c", "c_custkey").alias("owner_id"),
        F.when(urgent, "visibleCondition").otherwise("itemFilter").alias("property"),
        F.when(urgent, "VisibleCondition").otherwise("ItemFilter").alias("condition_type"),
        F.when(urgent, "Show").otherwise("Filter").alias("effect_type"),
        expr.alias("raw_expr"),
        F.array(F.concat(F.lit("component:c"), (F.col("c_custkey") % 50).cast("string"))).alias("referenced_symbols"),
    )


def nodes(t: Tables) -> DataFrame:
    """(id, node_type, path, name)."""
    customers, suppliers = t.customer, t.supplier
    act = actions(t)
    table_path = F.concat(F.lit("data/part"), "p_partkey", F.lit(".tbl"))
    return reduce(
        DataFrame.unionByName,
        [
            t.nation.select(page_id("n_nationkey").alias("id"), F.lit("Page").alias("node_type"), page_path("n_nationkey").alias("path"), F.col("n_name").alias("name")),
            suppliers.select(component_id("s_nationkey", "s", "s_suppkey").alias("id"), F.lit("Component").alias("node_type"), page_path("s_nationkey").alias("path"), F.col("s_name").alias("name")),
            customers.select(component_id("c_nationkey", "c", "c_custkey").alias("id"), F.lit("Component").alias("node_type"), page_path("c_nationkey").alias("path"), F.col("c_name").alias("name")),
            act.select(F.col("action").alias("id"), F.lit("Action").alias("node_type"), page_path("nation").alias("path"), F.concat(F.lit("o"), "o_orderkey").alias("name")),
            t.part.select(model_id("p_partkey").alias("id"), F.lit("Model").alias("node_type"), table_path.alias("path"), F.col("p_name").alias("name")),
            t.part.select(F.explode(F.array(F.lit("qty"), F.lit("price"))).alias("f"), "p_partkey").select(field_id("p_partkey", F.col("f")).alias("id"), F.lit("Field").alias("node_type"), table_path.alias("path"), F.col("f").alias("name")),
            conditions(t).select("id", F.lit("Condition").alias("node_type"), F.col("page").alias("path"), F.col("property").alias("name")),
        ],
    )


def edges(t: Tables) -> DataFrame:
    """(src, dst, edge_type, field_path, operation)."""
    # Lines meet their order by numbers, and repeated ones go before ids are made of them: rows lie by order already, so an
    # action's need no other shuffle, a component's one of three numbers.
    act, part = actions(t), F.col("l_partkey")
    lines = t.lineitem.join(act.select("o_orderkey", "c_custkey", "nation"), F.col("l_orderkey") == F.col("o_orderkey"))
    by_action = lambda rows: rows.select("o_orderkey", "c_custkey", "nation", "l_partkey").distinct()
    by_component = lambda rows: rows.select("c_custkey", "nation", "l_partkey").distinct()
    of_action, of_component = _action_id("nation"), component_id("nation", "c", "c_custkey")
    flag = F.col("l_returnflag")
    place = W.partitionBy("s_nationkey")
    inside = t.supplier.select("s_nationkey", "s_suppkey", F.row_number().over(place.orderBy("s_suppkey")).alias("rn"), F.count("*").over(place).alias("cnt"))
    held = t.customer.join(inside, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("rn") == F.col("c_custkey") % F.col("cnt") + 1))
    both = t.part.select("p_partkey", F.explode(F.array(F.lit("qty"), F.lit("price"))).alias("f"))
    up = F.col("p_partkey") * 7 % 101 + 1

    def edge(df: DataFrame, src: Column, dst: Column, kind: Column | str, field: Column | None = None, operation: str | None = None) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return df.select(src.alias("src"), dst.alias("dst"), kind.alias("edge_type"), (field if field is not None else F.lit(None)).cast("string").alias("field_path"), F.lit(operation).cast("string").alias("operation"))

    comp = component_id("c_nationkey", "c", "c_custkey")
    container = component_id("s_nationkey", "s", "s_suppkey")
    first = lines.where("l_linenumber = 1")
    dataflow = t.part.where("p_size % 3 = 0")
    return reduce(
        DataFrame.unionByName,
        [
            edge(t.customer, page_id("c_nationkey"), comp, "Contains"),
            edge(t.supplier, page_id("s_nationkey"), container, "Contains"),
            edge(held, container, comp, "Contains"),
            edge(both, model_id("p_partkey"), field_id("p_partkey", F.col("f")), "Contains"),
            edge(act, F.col("comp"), F.col("action"), "Triggers"),
            *(edge(by_action(lines.where(flag == x if x else ~flag.isin("R", "A"))), of_action, model_id(part), kind) for x, kind in (("R", "ActionWrites"), ("A", "ActionReads"), (None, "ActionLoadsData"))),
            edge(act.where("status = 'P'"), F.col("action"), page_id(F.col("o_orderkey") % 25), "ActionNavigates"),
            edge(by_component(first), of_component, model_id(part), "Reads"),
            edge(by_component(first.where("l_quantity > 25")), of_component, field_id(part, F.lit("qty")), "Reads", F.lit("qty")),
            edge(by_component(lines.where("l_linenumber = 2 AND l_returnflag = 'R'")), of_component, model_id(part), "Writes"),
            edge(by_action(lines.where("l_returnflag = 'R'")), of_action, field_id(part, F.lit("price")), "FieldWrite", F.lit("price"), "write"),
            edge(dataflow, model_id("p_partkey"), model_id(up), "DataflowInput"),
            edge(dataflow, field_id("p_partkey", F.lit("qty")), field_id(up, F.lit("qty")), "FieldAlias", F.lit("qty")),
            edge(t.part.where("p_size % 7 = 0"), model_id("p_partkey"), model_id(F.col("p_partkey") * 11 % 97 + 1), "OutputsTo"),
            edge(conditions(t), F.col("id"), F.col("owner_id"), "DependsOn", operation="owner"),
        ],
    )


def component_refs(t: Tables) -> DataFrame:
    """(page, component, ref): component c refers to the (c * 13 mod n)-th component of its page, n being their number."""
    c = t.customer.select("c_nationkey", "c_custkey")
    place = W.partitionBy("c_nationkey")
    ranked = c.withColumn("k", F.row_number().over(place.orderBy("c_custkey")) - 1).withColumn("n", F.count("*").over(place))
    target = ranked.select(F.col("c_nationkey").alias("nation"), F.col("k").alias("at"), F.col("c_custkey").alias("target"))
    return ranked.join(target, (F.col("c_nationkey") == F.col("nation")) & (F.col("at") == (F.col("k") * 13 + 5) % F.col("n"))).select(page_path("c_nationkey").alias("page"), F.concat(F.lit("c"), "c_custkey").alias("component"), F.concat(F.lit("c"), "target").alias("ref"))


def feed(t: Tables) -> DataFrame:
    """(event_id, file_id, kind, updated_at_ms, deleted): the events table as a change feed with ties at whole minutes."""
    return t.events.select("event_id", F.col("user_id").alias("file_id"), F.when(F.col("event_type") == "error", "deleted").otherwise("active").alias("kind"), (F.unix_seconds(F.date_trunc("minute", F.col("ts")).cast("timestamp")) * 1000).alias("updated_at_ms"), (F.col("event_type") == "error").alias("deleted"))


# The same tables in SQL, for checks in another engine.
_ACT = """act AS (SELECT o_orderkey, c_custkey, c_nationkey AS nation, o_orderstatus AS status, o_orderpriority AS priority, concat('comp:app/n', c_nationkey, '.spg|c', c_custkey) AS comp,
  concat('action:app/n', c_nationkey, '.spg|c', c_custkey, '|o', o_orderkey) AS action FROM orders JOIN customer ON o_custkey = c_custkey)"""
_COND = """conditions AS (SELECT concat('cond:app/n', nation, '.spg|c', c_custkey, CASE WHEN priority = '1-URGENT' THEN '#visibleCondition#' ELSE '#itemFilter#' END, o_orderkey) AS id, concat('app/n', nation, '.spg') AS page, comp AS owner_id,
  CASE WHEN priority = '1-URGENT' THEN 'visibleCondition' ELSE 'itemFilter' END AS property, CASE WHEN priority = '1-URGENT' THEN 'VisibleCondition' ELSE 'ItemFilter' END AS condition_type,
  CASE WHEN priority = '1-URGENT' THEN 'Show' ELSE 'Filter' END AS effect_type, concat('=c', c_custkey % 50, '.value > ', o_orderkey % 7) AS raw_expr, [concat('component:c', c_custkey % 50)] AS referenced_symbols
  FROM act WHERE priority IN ('1-URGENT', '5-LOW'))"""
_NODES = """nodes AS (SELECT concat('page:app/n', n_nationkey, '.spg') AS id, 'Page' AS node_type, concat('app/n', n_nationkey, '.spg') AS path, n_name AS name FROM nation
  UNION ALL SELECT concat('comp:app/n', s_nationkey, '.spg|s', s_suppkey), 'Component', concat('app/n', s_nationkey, '.spg'), s_name FROM supplier
  UNION ALL SELECT concat('comp:app/n', c_nationkey, '.spg|c', c_custkey), 'Component', concat('app/n', c_nationkey, '.spg'), c_name FROM customer
  UNION ALL SELECT action, 'Action', concat('app/n', nation, '.spg'), concat('o', o_orderkey) FROM act
  UNION ALL SELECT concat('model:part', p_partkey), 'Model', concat('data/part', p_partkey, '.tbl'), p_name FROM part
  UNION ALL SELECT concat('field:part', p_partkey, '.', f), 'Field', concat('data/part', p_partkey, '.tbl'), f FROM part CROSS JOIN (SELECT 'qty' AS f UNION ALL SELECT 'price') x
  UNION ALL SELECT id, 'Condition', page, property FROM conditions)"""
_EDGES = """sup AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn, count(*) OVER (PARTITION BY s_nationkey) AS cnt FROM supplier),
lines AS (SELECT * FROM lineitem JOIN act ON l_orderkey = o_orderkey),
edges AS (SELECT concat('page:app/n', c_nationkey, '.spg') AS src, concat('comp:app/n', c_nationkey, '.spg|c', c_custkey) AS dst, 'Contains' AS edge_type, CAST(NULL AS VARCHAR) AS field_path, CAST(NULL AS VARCHAR) AS operation FROM customer
  UNION ALL SELECT concat('page:app/n', s_nationkey, '.spg'), concat('comp:app/n', s_nationkey, '.spg|s', s_suppkey), 'Contains', NULL, NULL FROM supplier
  UNION ALL SELECT concat('comp:app/n', s_nationkey, '.spg|s', s_suppkey), concat('comp:app/n', c_nationkey, '.spg|c', c_custkey), 'Contains', NULL, NULL FROM customer JOIN sup ON s_nationkey = c_nationkey AND rn = c_custkey % cnt + 1
  UNION ALL SELECT concat('model:part', p_partkey), concat('field:part', p_partkey, '.', f), 'Contains', NULL, NULL FROM part CROSS JOIN (SELECT 'qty' AS f UNION ALL SELECT 'price') x
  UNION ALL SELECT comp, action, 'Triggers', NULL, NULL FROM act
  UNION ALL SELECT DISTINCT action, concat('model:part', l_partkey), CASE l_returnflag WHEN 'R' THEN 'ActionWrites' WHEN 'A' THEN 'ActionReads' ELSE 'ActionLoadsData' END, NULL, NULL FROM lines
  UNION ALL SELECT action, concat('page:app/n', o_orderkey % 25, '.spg'), 'ActionNavigates', NULL, NULL FROM act WHERE status = 'P'
  UNION ALL SELECT DISTINCT comp, concat('model:part', l_partkey), 'Reads', NULL, NULL FROM lines WHERE l_linenumber = 1
  UNION ALL SELECT DISTINCT comp, concat('field:part', l_partkey, '.qty'), 'Reads', 'qty', NULL FROM lines WHERE l_linenumber = 1 AND l_quantity > 25
  UNION ALL SELECT DISTINCT comp, concat('model:part', l_partkey), 'Writes', NULL, NULL FROM lines WHERE l_linenumber = 2 AND l_returnflag = 'R'
  UNION ALL SELECT DISTINCT action, concat('field:part', l_partkey, '.price'), 'FieldWrite', 'price', 'write' FROM lines WHERE l_returnflag = 'R'
  UNION ALL SELECT concat('model:part', p_partkey), concat('model:part', p_partkey * 7 % 101 + 1), 'DataflowInput', NULL, NULL FROM part WHERE p_size % 3 = 0
  UNION ALL SELECT concat('field:part', p_partkey, '.qty'), concat('field:part', p_partkey * 7 % 101 + 1, '.qty'), 'FieldAlias', 'qty', NULL FROM part WHERE p_size % 3 = 0
  UNION ALL SELECT concat('model:part', p_partkey), concat('model:part', p_partkey * 11 % 97 + 1), 'OutputsTo', NULL, NULL FROM part WHERE p_size % 7 = 0
  UNION ALL SELECT id, owner_id, 'DependsOn', NULL, 'owner' FROM conditions)"""
_REFS = """ranked AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
refs AS (SELECT concat('app/n', a.c_nationkey, '.spg') AS page, concat('c', a.c_custkey) AS component, concat('c', b.c_custkey) AS ref FROM ranked a JOIN ranked b ON a.c_nationkey = b.c_nationkey AND b.k = (a.k * 13 + 5) % a.n)"""
_FEED = """feed AS (SELECT event_id, user_id AS file_id, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'active' END AS kind, epoch_ms(date_trunc('minute', ts)) AS updated_at_ms, event_type = 'error' AS deleted FROM events)"""


def sql(body: str, *more: str) -> str:
    """body over the SQL form of nodes, edges, conditions, refs and feed."""
    return "WITH RECURSIVE " + ",\n".join([_ACT, _COND, _NODES, _EDGES, _REFS, _FEED, *more]) + "\n" + body
