"""Dataflow metadata: filters, field traces and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .traversal import closure, dealt, settled


def filter_roles(df_nodes: DataFrame, df_deps: DataFrame) -> DataFrame:
    """(model, node_id, role): what the filter of a dataflow node filters. df_nodes has (model, node_id, type), df_deps (model, node_id, input_node_id)."""
    outputs = df_nodes.where("type = 'Output'").select("model", "node_id")
    feeds = df_deps.join(outputs, ["model", "node_id"]).select("model", F.col("input_node_id").alias("node_id")).distinct().withColumn("last", F.lit(True))
    role = F.when(F.col("type") == "ModelTable", "source_filter").when(F.col("type") == "Output", "output_filter").when(F.col("type") == "Union", "branch_filter").when(F.col("last"), "output_filter").otherwise("node_filter")
    return df_nodes.join(feeds, ["model", "node_id"], "left").select("model", "node_id", role.alias("role"))


def filter_fields(expr: Column) -> Column:
    """Fields of a filter expression: ``[node].[field]`` as node.field, then bare ``[field]``, each once, in order."""
    pair = "\\[([^\\[\\].\\n]+)\\]\\.\\[([^\\[\\].\\n]+)\\]"
    left, right = F.regexp_extract_all(expr, F.lit(pair), 1), F.regexp_extract_all(expr, F.lit(pair), 2)
    both = F.zip_with(left, right, lambda a, b: F.concat(a, F.lit("."), b))
    bare = F.regexp_extract_all(F.regexp_replace(expr, pair, ""), F.lit("\\[([^\\[\\]\\n]+)\\]"), 1)
    return F.array_distinct(F.concat(both, bare))


def filter_variables(expr: Column) -> Column:
    """``$user.x`` and ``$param.x``, then ``paramN``, each once, in order."""
    return F.array_distinct(F.concat(F.regexp_extract_all(expr, F.lit("(\\$(?:user|param)\\.[A-Za-z0-9_]+)"), 1), F.regexp_extract_all(expr, F.lit("\\b(param[0-9]+)\\b"), 1)))


def lineage(edges: DataFrame, kinds: tuple[str, ...] = ("DataflowInput",)) -> DataFrame:
    """(model, upstream, depth): every model that a model is made from, at its smallest distance; cycles end by themselves."""
    links = edges.where(F.col("edge_type").isin(*kinds)).select("src", "dst").distinct()
    seeds = links.select(F.col("src").alias("target"), F.col("src").alias("node"))
    return closure(seeds, links).where("depth > 0").select(F.col("target").alias("model"), F.col("node").alias("upstream"), "depth")


def field_origins(edges: DataFrame) -> DataFrame:
    """(field, origin, status, hops): where each aliased field's chain ends; ``proven`` at a field that is no alias itself, ``cycle`` otherwise.

    All chains advance by doubling: each round joins the table with itself, so n hops take log2(n) jobs.
    """
    alias = edges.where("edge_type = 'FieldAlias'").groupBy("src").agg(F.min("dst").alias("dst")).select(F.col("src").alias("field"), F.col("dst").alias("at"), F.lit(1).cast("long").alias("hops"))
    n = alias.count()
    jump = settled(alias)
    done = 1
    while done <= n:
        step = jump.select(F.col("field").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"))
        longer = jump.join(step, "at", "left").select("field", F.coalesce("to", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("to").isNotNull().alias("moved"))
        jump = settled(longer.drop("moved"))
        done *= 2
    ends = jump.join(alias.select(F.col("field").alias("at"), F.lit(True).alias("again")), "at", "left")
    status = F.when(F.col("again"), "cycle").otherwise("proven")
    return ends.select("field", F.when(status == "proven", F.col("at")).alias("origin"), status.alias("status"), F.when(status == "proven", F.col("hops")).alias("hops"))


def field_trace(fields: DataFrame, start: DataFrame) -> DataFrame:
    """(model, field, path, stop): the chain of nodes that an output field goes back through inside its dataflow.

    fields has (model, node, name, dbfield, original_field, original_node), start (model, node, field). A field matches
    a record by its name, else by its dbfield. It stops at an unknown node or field, at a record without an origin, or
    at a repetition, so every chain ends. Records are written once and meet each hop in parts of a limited size.
    """
    fields, key = settled(fields), ["model", "node", "field"]
    n = fields.count()
    by_name = fields.select("model", "node", F.col("name").alias("field"), "original_field", "original_node", F.lit(0).alias("way"))
    by_db = fields.where("dbfield <> name").select("model", "node", F.col("dbfield").alias("field"), "original_field", "original_node", F.lit(1).alias("way"))
    record = settled(dealt(by_name.unionByName(by_db), 2 * n, *key).groupBy(*key).agg(F.min(F.struct("way", "original_node", "original_field")).alias("r")))
    record = dealt(record, 2 * n, *key)
    at = start.select("model", F.col("field").alias("wanted"), "node", "field", F.array(F.concat_ws(".", "node", "field")).alias("path"))
    out = None
    while True:
        step = settled(at.join(record, key, "left"))
        to = F.concat_ws(".", "r.original_node", "r.original_field")
        stop = F.when(F.col("r").isNull(), "unknown").when(F.col("r.original_node").isNull() | F.col("r.original_field").isNull(), "origin").when(F.array_contains("path", to), "cycle")
        rows = step.withColumn("stop", stop)
        ended = rows.where("stop IS NOT NULL").select("model", F.col("wanted").alias("field"), F.array_join("path", "<").alias("path"), "stop")
        out = ended if out is None else out.unionByName(ended)
        at = rows.where("stop IS NULL").select("model", "wanted", F.col("r.original_node").alias("node"), F.col("r.original_field").alias("field"), F.concat("path", F.array(to)).alias("path"))
        if at.isEmpty():
            return out
