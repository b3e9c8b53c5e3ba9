"""Composed answers: what a component, a page or a model is, why, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .traversal import page_subtree

# Diagnostic codes by what they say of an answer: it is uncertain, it is partial, a thing surely is not there,
# the target was not found, or how it was found. Other codes say nothing.
UNCERTAIN = (
    "UNKNOWN_ACTION_TYPE", "UNKNOWN_QUESTION_KIND", "EXPR_PARSE_ERROR", "EXPR_UNPARSED", "LINEAGE_EXPR_UNPARSED", "EXPR_UNRESOLVED_REF", "EXPR_UNSUPPORTED_FUNCTION",
    "LINEAGE_SOURCE_MISSING", "UNRESOLVED_MODEL_WRITE", "UNRESOLVED_PAGE_NAVIGATION", "MODEL_UNRESOLVED", "VISIBILITY_RULE_UNRESOLVED", "ACTION_FLOW_INCOMPLETE", "DATAFLOW_INPUT_PATH_UNRESOLVED",
    "CYCLE_DEPENDENCY", "EMPTY_CONDITION", "PARSE_ERROR", "METADATA_PARSE_ERROR", "EVIDENCE_INCOMPLETE", "EVIDENCE_LOCATION_MISSING", "EDGE_EVIDENCE_UNAVAILABLE", "AMBIGUOUS_RESOLUTION",
)
PARTIAL = (
    "OUTPUT_TRUNCATED", "PRIMARY_PATHS_TRUNCATED", "EVIDENCE_SAMPLED", "PAGE_INPUTS_DEFERRED", "AMBIGUOUS_TARGET_ANSWERED", "GRAPH_DB_PARTIAL_HYDRATE", "GRAPH_DB_NODE_DECODE_FAILED",
    "GRAPH_DB_EDGE_DECODE_FAILED", "GRAPH_DB_EDGE_DANGLING_ENDPOINT", "PAGE_SCOPED_TARGET_FALLBACK", "TRACE_INCOMPLETE", "DIAGNOSTIC_SERIALIZE_FAILED", "SUPPLEMENT_UNAVAILABLE",
)
DETERMINATE = ("NO_WRITE_TARGETS", "NO_ENTRYPOINTS", "DATAFLOW_NO_INPUTS", "DATAFLOW_NO_OUTPUT", "NO_MATCHES_FOUND")
ADDRESSING = ("TARGET_NOT_FOUND", "COMPONENT_NOT_FOUND", "DOCUMENT_NOT_FOUND", "AMBIGUOUS_TARGET")
ROUTING = ("RESOLVED_TARGET",)
# Items of a list at each budget; full has no limit.
BUDGETS = {"compact": 5, "normal": 20}

def impact(code: Column) -> Column:
    """What a diagnostic code says of an answer; null for a code that says nothing."""
    kinds = (("uncertain", UNCERTAIN), ("partial", PARTIAL), ("determinate", DETERMINATE), ("addressing", ADDRESSING), ("routing", ROUTING))
    out = F.lit(None).cast("string")
    for name, codes in reversed(kinds):
        out = F.when(code.isin(*codes), name).otherwise(out)
    return out


def confidence_rollup(diagnostics: DataFrame, key: str) -> DataFrame:
    """(key, confidence, reasons) of diagnostics (key, code, place): reduced where a code is uncertain, else partial where one is, else full.

    reasons are the codes that say anything of the answer, in the order of their first places, each as code=impact.
    """
    first = diagnostics.groupBy(key, "code").agg(F.min("place").alias("place")).withColumn("impact", impact(F.col("code")))
    has = lambda name: F.coalesce(F.max(F.col("impact") == name), F.lit(False))
    said = F.array_sort(F.collect_list(F.when(F.col("impact").isNotNull(), F.struct("place", "code", "impact"))))
    reasons = F.array_join(F.transform(said, lambda x: F.concat_ws("=", x["code"], x["impact"])), ",")
    return first.groupBy(key).agg(F.when(has("uncertain"), "reduced").when(has("partial"), "partial").otherwise("full").alias("confidence"), reasons.alias("reasons"))


def budgeted(items: Column, budget: str) -> Column:
    return F.slice(items, 1, BUDGETS[budget]) if budget in BUDGETS else items


def component_summary(nodes: DataFrame, edges: DataFrame, conditions: DataFrame) -> DataFrame:
    """(id, page, n_actions, n_reads, n_writes, n_conditions, kind) of every component, zeros included."""
    n = lambda *kinds: F.count_if(F.col("edge_type").isin(*kinds))
    comps = nodes.where("node_type = 'Component'").select("id", F.concat(F.lit("page:"), "path").alias("page"))
    out = edges.where("src LIKE 'comp:%'").groupBy("src").agg(n("Triggers").alias("n_actions"), n("Reads").alias("n_reads"), n("Writes").alias("n_writes"), n("Contains").alias("n_children"))
    conds = conditions.groupBy(F.col("owner_id").alias("src")).agg(F.count("*").alias("n_conditions"))
    rows = comps.join(out, F.col("id") == F.col("src"), "left").drop("src").join(conds, F.col("id") == F.col("src"), "left").drop("src").na.fill(0)
    kind = F.when(F.col("n_children") > 0, "container").when(F.col("n_writes") > 0, "editor").when(F.col("n_actions") > 0, "trigger").when(F.col("n_reads") > 0, "view").otherwise("decoration")
    return rows.select("id", "page", "n_actions", "n_reads", "n_writes", "n_conditions", kind.alias("kind"))


def component_query(refs: DataFrame) -> DataFrame:
    """(page, component, uses, used_by): each component with its references and its dependants."""
    uses = refs.groupBy("page", "component").agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("uses"))
    used = refs.groupBy("page", F.col("ref").alias("component")).agg(F.array_join(F.array_sort(F.collect_set("component")), ",").alias("used_by"))
    return uses.join(used, ["page", "component"], "full_outer").na.fill("")


def navigation(edges: DataFrame) -> DataFrame:
    """(page, jumps, embeds, params, absent): counts of the ways out of a page; only true zeros are listed as absent."""
    tree = page_subtree(edges)
    n = lambda kind: F.count_if(F.col("edge_type") == kind)
    rows = tree.join(edges, F.col("src") == F.col("node"), "left").groupBy("page").agg(n("ActionNavigates").alias("jumps"), n("EmbedsPage").alias("embeds"), n("PassesParam").alias("params"))
    absent = F.filter(F.array(*[F.when(F.col(c) == 0, c) for c in ("jumps", "embeds", "params")]), lambda x: x.isNotNull())
    return rows.withColumn("absent", F.array_join(absent, ","))


def health(nodes: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """One row of counts of a stored graph."""
    part = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return part(nodes, "nodes").unionByName(part(edges, "edges")).unionByName(part(states, "files"))


def tsv(rows: DataFrame) -> DataFrame:
    """(line): tab-separated values; tabs and line ends inside values become spaces, nulls empty."""
    return rows.select(F.concat_ws("\t", *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\\t\\r\\n]", " ") for c in rows.columns]).alias("line"))


def echarts(nodes: DataFrame, edges: DataFrame, most_nodes: int = 200, most_edges: int = 500) -> dict:
    """A graph series for a chart library, of a cut graph."""
    from .output import visual_cut

    links = visual_cut(nodes, edges, most_nodes, most_edges).collect()
    ids = sorted({x for r in links for x in (r.src, r.dst)})
    return {"type": "graph", "data": [{"id": x, "category": x.split(":", 1)[0]} for x in ids], "links": [{"source": r.src, "target": r.dst, "value": r.edge_type} for r in links]}


def answer_facts(nodes: DataFrame, edges: DataFrame, conditions: DataFrame, shown: int = 3) -> DataFrame:
    """(id, display, value_source, writer, action): the first facts of each block about every component that has any."""
    facts = conditions.where("effect_type = 'Show'").select(F.col("owner_id").alias("id"), F.lit("display").alias("block"), F.col("id").alias("fact"))
    for block, kind in (("value_source", "Reads"), ("writer", "Writes"), ("action", "Triggers")):
        facts = facts.unionByName(edges.where((F.col("edge_type") == kind) & F.col("src").startswith("comp:")).select(F.col("src").alias("id"), F.lit(block).alias("block"), F.col("dst").alias("fact")))
    top = facts.withColumn("k", F.row_number().over(W.partitionBy("id", "block").orderBy("fact"))).where(F.col("k") <= shown)
    of = lambda b: F.array_join(F.array_sort(F.collect_list(F.when(F.col("block") == b, F.col("fact")))), ",").alias(b)
    return top.groupBy("id").agg(*[of(b) for b in ("display", "value_source", "writer", "action")])


# The blocks that must answer a question, and those that must not stand for an answer.
CONTRACT = {"display": (("display",), ("writer",)), "value_source": (("value_source",), ("display",)), "writer": (("writer", "action"), ("display",)), "availability": (("display", "value_source"), ())}


def completion(intent: str, facts: DataFrame) -> DataFrame:
    """(id, status): complete if every block that a question needs has facts, partial if some have, else missing."""
    needed = [F.col(b) != "" for b in CONTRACT[intent][0]]
    every, some = needed[0], needed[0]
    for x in needed[1:]:
        every, some = every & x, some | x
    return facts.select("id", F.when(every, "complete").when(some, "partial").otherwise("missing").alias("status"))


def advice(target: str, known: bool) -> list[str]:
    """Questions to ask next about an id."""
    if not known:
        return [f"find {target.split(':', 1)[-1]}"]
    kind = target.split(":", 1)[0]
    more = {"page": "relations", "model": "lineage", "comp": "conditions", "action": "flows", "field": "lineage", "cond": "owners"}
    return [f"explain {target}", f"{more.get(kind, 'context')} {target}"]


# Bytes of an answer and least items of a cut list at each budget; full has no limit.
BYTE_BUDGETS = {"compact": (8_000, 1), "normal": (40_000, 2)}


def shrunk(answer: dict, peripheral: list[str], most: int, floor: int = 1) -> dict:
    """An answer whose JSON text has at most so many bytes, as far as cutting its peripheral lists to 8, 5, 3, 2 and 1 items, no fewer than floor, can make it so.

    The names of the lists that were cut are put under ``truncated`` after the last cut, so the note is not counted.
    """
    import json

    out, gone = dict(answer), []
    for n in (8, 5, 3, 2, 1):
        if n < floor or len(json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode()) <= most:
            break
        for key in peripheral:
            if isinstance(out.get(key), list) and len(out[key]) > n:
                out[key] = out[key][:n]
                gone += [] if key in gone else [key]
    return out | {"truncated": gone} if gone else out


def fitted(answer: dict, peripheral: list[str], budget: str) -> dict:
    """An answer cut to its budget's bytes."""
    return shrunk(answer, peripheral, *BYTE_BUDGETS[budget]) if budget in BYTE_BUDGETS else answer
