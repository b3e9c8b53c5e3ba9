"""Summaries, cuts and drawings of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .neighbours import parent_pages


def histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes and edges of each type."""
    n = nodes.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    return n.unionByName(edges.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n"))


def field_types(fields: DataFrame) -> DataFrame:
    """(model, n, types): fields of each declared type."""
    counts = fields.groupBy("model", "data_type").agg(F.count("*").alias("c"))
    return counts.groupBy("model").agg(F.sum("c").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "data_type", "c"))), ",").alias("types"))


def evidence_summary(evidence: DataFrame, key: str, shown: int = 5) -> DataFrame:
    """(key, total, shown, high, low, derived)."""
    total = F.count("*")
    return evidence.groupBy(key).agg(total.alias("total"), F.least(total, F.lit(shown)).cast("long").alias("shown"), F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "low").alias("low"), F.bool_or(F.col("confidence") == "low").alias("derived"))


def truncated(rows: DataFrame, key: str, item: str, shown: int) -> DataFrame:
    """(id, total, shown, remaining, items): the first items of each key; lists are cut before they are gathered."""
    ranked = rows.select(F.col(key).alias("id"), item).withColumn("k", F.row_number().over(W.partitionBy("id").orderBy(item)))
    total = F.count("*")
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.col(item)))), ",")
    return ranked.groupBy("id").agg(total.alias("total"), F.least(total, F.lit(shown)).cast("long").alias("shown"), F.greatest(total - shown, F.lit(0)).cast("long").alias("remaining"), first.alias("items"))


def visual_cut(nodes: DataFrame, edges: DataFrame, most_nodes: int = 200, most_edges: int = 500) -> DataFrame:
    """(src, dst, edge_type) of a drawing: the first nodes by id, edges between them alone, the first of those."""
    picked = nodes.select("id").orderBy("id").limit(most_nodes)
    inner = edges.join(picked.withColumnRenamed("id", "src"), "src", "left_semi").join(picked.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inner.select("src", "dst", "edge_type").distinct().orderBy("src", "dst", "edge_type").limit(most_edges)


def _page_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    pages = nodes.where("node_type = 'Page'").select(F.col("id").alias("page"))
    rows = edges.join(parent_pages(nodes, edges), F.col("src") == F.col("id")).select("page", "src", "dst", "edge_type")
    counts = rows.groupBy("page").agg(
        F.count_distinct(F.when(F.col("edge_type") == "Triggers", F.col("src"))).alias("n_entry"),
        F.count_if(F.col("edge_type").isin("Writes", "ActionWrites")).alias("n_write"),
        F.count_if(F.col("edge_type").isin("OpensPage", "ActionNavigates")).alias("n_jump"),
        F.count_if((F.col("edge_type") == "ActionNavigates") & (F.col("dst") == F.col("page"))).alias("n_self"),
    )
    return pages.join(counts, "page", "left").na.fill(0)


def page_roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(page, n_entry, n_write, n_jump, role); a page without entry points only shows, whatever else it holds."""
    role = F.when(F.col("n_entry") == 0, "readonly_dashboard").when((F.col("n_write") > 0) & (F.col("n_jump") > 0), "mixed_interaction_page").when(F.col("n_write") > 0, "data_maintenance_page").when(F.col("n_jump") > 0, "navigation_page").otherwise("unknown")
    return _page_counts(nodes, edges).select("page", "n_entry", "n_write", "n_jump", role.alias("role"))


def page_risks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(page, risk)."""
    found = F.array(F.when(F.col("n_entry") == 0, "NO_ENTRYPOINT"), F.when(F.col("n_write") == 0, "NO_WRITES"), F.when(F.col("n_jump") == 0, "NO_NAVIGATION"), F.when(F.col("n_self") > 0, "SELF_NAVIGATION"))
    return _page_counts(nodes, edges).select("page", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("risk"))


def page_logic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(page, n_actions, n_sources, n_sinks, n_targets, targets) of all pages at once."""
    kind, to_model = F.col("edge_type"), F.col("dst").startswith("model:")
    group = F.when(kind == "Triggers", "action").when(kind.isin("Reads", "ActionReads") & to_model, "source").when(kind.isin("Writes", "ActionWrites"), "sink").when(kind == "ActionNavigates", "target")
    # what no count needs is not joined, and an end counts once in its group, so plain counts do
    some = edges.select("src", "dst", group.alias("group")).where("group IS NOT NULL AND dst IS NOT NULL")
    rows = some.join(parent_pages(nodes, edges), F.col("src") == F.col("id")).select("page", "dst", "group").distinct()
    n = lambda x: F.count_if(F.col("group") == x)
    targets = F.array_join(F.array_sort(F.collect_list(F.when(F.col("group") == "target", F.col("dst")))), ",")
    counts = rows.groupBy("page").agg(n("action").alias("n_actions"), n("source").alias("n_sources"), n("sink").alias("n_sinks"), n("target").alias("n_targets"), targets.alias("targets"))
    pages = nodes.where("node_type = 'Page'").select(F.col("id").alias("page"))
    return pages.join(counts, "page", "left").na.fill(0).na.fill("")


def action_flows(edges: DataFrame) -> DataFrame:
    """(action, n_reads, n_writes, n_loads, n_fields, goes_to, category)."""
    n = lambda kind: F.count_if(F.col("edge_type") == kind)
    rows = edges.where("src LIKE 'action:%'").groupBy(F.col("src").alias("action")).agg(n("ActionReads").alias("n_reads"), n("ActionWrites").alias("n_writes"), n("ActionLoadsData").alias("n_loads"), n("FieldWrite").alias("n_fields"), F.max(F.when(F.col("edge_type") == "ActionNavigates", F.col("dst"))).alias("goes_to"))
    kind = F.when(F.col("n_writes") > 0, "data_write").when(F.col("goes_to").isNotNull(), "navigation").otherwise("data_read")
    return rows.withColumn("category", kind)


def envelope(kind: str, target: Column, details: Column) -> Column:
    """The JSON text of one answer."""
    return F.to_json(F.struct(F.lit("1").alias("schema_version"), F.lit(kind).alias("kind"), target.alias("query_target"), details.alias("details")))


def redacted(text: Column) -> Column:
    """Text without passwords, tokens and mail addresses."""
    out = F.regexp_replace(text, "(?i)(password|passwd|token|secret|api_?key)(\\s*[=:]\\s*)\\S+", "$1$2***")
    return F.regexp_replace(out, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "***@***")


def mermaid(nodes: DataFrame, edges: DataFrame, most_nodes: int = 200, most_edges: int = 500) -> str:
    """A drawing of a cut graph; its size is bounded by the cut."""
    rows = visual_cut(nodes, edges, most_nodes, most_edges).collect()
    ids = {x: f"n{k}" for k, x in enumerate(sorted({y for r in rows for y in (r.src, r.dst)}))}
    label = lambda x: x.replace('"', "'")
    return "\n".join(["graph LR", *(f'  {k}["{label(x)}"]' for x, k in ids.items()), *(f"  {ids[r.src]} -->|{r.edge_type}| {ids[r.dst]}" for r in rows)])
