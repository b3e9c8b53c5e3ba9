"""Page and table documents (JSON files) as child tables, and the graph that they describe.

A document is one row; walking it needs recursion of unbounded depth, so one Arrow pass turns documents into flat
records, and everything after that is joins.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..model import ALWAYS_EXPRESSION, EDGE_SCHEMA, MAYBE_EXPRESSION, NODE_SCHEMA

# Keys that hold child components, and keys that never do.
CHILD_KEYS = ("components", "panels", "steps", "comps")
OTHER_KEYS = ("actions", "params", "sources", "fieldValues", "data", "submitComponent", "targetComponent", "referenceResources")
# Operations that write, validate or load, by action type.
WRITES = {"submitData": "submit", "updateData": "update", "insertData": "insert", "deleteData": "delete"}
LOADS = {"resetData": "reset", "newData": "new", "refreshData": "refresh", "refreshModels": "refresh", "loadData": "load"}
CONTROLS = ("showComponent", "hideComponent", "showDialog", "closeDialog", "switchPanel")

RECORD = "path string, kind string, id string, parent string, name string, value string, json_path string, seq int"


def discover(spark: SparkSession, directory: str) -> DataFrame:
    """(path, content, hash) of every .spg and .tbl file below a directory, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{spg,tbl}").load(directory)
    text = F.decode("content", "UTF-8")
    root = directory.rstrip("/").split("://")[-1].lstrip("/")
    return files.select(F.element_at(F.split("path", f"{root}/", 2), -1).alias("path"), text.alias("content"), F.xxhash64("content").alias("hash"))


def normalised_path(path: str) -> str | None:
    """A project-relative path without dots; None for absolute ones and those that leave the project."""
    path = path.replace("\\", "/")
    if path.startswith("/"):
        return None
    out: list[str] = []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part == "..":
            if not out:
                return None
            out.pop()
        else:
            out.append(part)
    return "/".join(out) or None


def resolved(reference: str, page: str) -> str | None:
    """The project file that a reference names: ``$TAPP:``, ``$APP:``, ``$ANA:`` and ``$DATA:`` from the project's folders, others from the page's folder."""
    for mark, folder in (("$TAPP:", "app"), ("$APP:", "app"), ("$ANA:", "ana"), ("$DATA:", "data")):
        if reference.startswith(mark):
            return normalised_path(posixpath.join(folder, reference[len(mark) :].lstrip("/")))
    if ":" in reference.split("/")[0]:
        return None
    return normalised_path(posixpath.join(posixpath.dirname(page), reference)) if not reference.startswith("/") else normalised_path(reference[1:])


def _scalar(value) -> str | None:
    if value is None or isinstance(value, (dict, list)):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def _children(component: dict) -> Iterator[tuple[str, int, dict]]:
    for key, value in component.items():
        if not isinstance(value, list) or not value or key in OTHER_KEYS:
            continue
        shaped = all(isinstance(x, dict) and isinstance(x.get("id"), str) and isinstance(x.get("type"), str) for x in value)
        if key in CHILD_KEYS or shaped:
            yield from ((key, i, x) for i, x in enumerate(value) if isinstance(x, dict) and isinstance(x.get("id"), str))


def _linked(path: str, kind: str, id_: str, parent: str | None, reference, at: str, seq: int) -> Iterator[tuple]:
    """A record with the file that a reference names, or a diagnostic."""
    if target := resolved(reference, path) if isinstance(reference, str) else None:
        yield path, kind, id_, parent, reference, target, at, seq
    else:
        yield path, "diagnostic", id_, parent, "UNRESOLVED_REFERENCE", str(reference), at, seq


def _page(path: str, doc: dict) -> Iterator[tuple]:
    for i, x in enumerate(doc.get("params") or []):
        yield path, "param", x.get("id"), None, x.get("name"), _scalar(x.get("value")), f"params[{i}]", i
    for i, x in enumerate(doc.get("sources") or []):
        yield path, "source", x.get("id"), None, x.get("modelType"), x.get("path"), f"sources[{i}]", i
        for j, c in enumerate((x.get("filter") or {}).get("clauses") or []):
            yield path, "source_filter", x.get("id"), None, str(j), c.get("exp") or " ".join(str(c.get(k) or "") for k in ("leftExp", "operator", "rightValue")), f"sources[{i}].filter.clauses[{j}]", j
    stack = [(doc.get("canvas"), None, "canvas")]
    seq = 0
    seen: set[str] = set()
    while stack:
        comp, parent, at = stack.pop()
        if not isinstance(comp, dict) or not isinstance(comp.get("id"), str):
            continue
        cid = comp["id"]
        if cid in seen:
            yield path, "diagnostic", cid, None, "DUPLICATE_COMPONENT_ID", None, at, seq
        seen.add(cid)
        yield path, "component", cid, parent, comp.get("type"), comp.get("dataSet") or comp.get("source"), at, seq
        if comp.get("resPath"):
            yield from _linked(path, "embeds", cid, None, comp["resPath"], at, seq)
        if comp.get("submitField"):
            yield path, "submit_field", cid, None, None, _scalar(comp["submitField"]), at, seq
        for name in (*ALWAYS_EXPRESSION, *MAYBE_EXPRESSION):
            if isinstance(comp.get(name), str):
                yield path, "property", cid, None, name, comp[name], f"{at}.{name}", seq
        for i, a in enumerate(comp.get("actions") or []):
            aid = a.get("id") or str(i)
            where = f"{at}.actions[{i}]"
            yield path, "action", aid, cid, a.get("actionType"), a.get("dataSet"), where, i
            for name in ("conditionExp", "condition"):
                if a.get(name):
                    yield path, "action_condition", aid, cid, name, _scalar(a[name]), f"{where}.{name}", i
            if a.get("path"):
                yield from _linked(path, "action_path", aid, cid, a["path"], where, i)
            for x in a.get("fieldValues") or []:
                yield path, "field_value", aid, cid, x.get("name"), _scalar(x.get("value")), where, i
            for x in a.get("data") or []:
                yield path, "passed_param", aid, cid, x.get("name"), _scalar(x.get("value")), where, i
            for x in a.get("params") or []:
                yield path, "set_param", aid, cid, x.get("name"), _scalar(x.get("value")), where, i
            for x in [*(a.get("targetComponent") or []), *[a[k] for k in ("panelbook", "panel", "dialog") if isinstance(a.get(k), str)]]:
                yield path, "action_target", aid, cid, None, x, where, i
        seq += 1
        kids = list(_children(comp))
        stack += [(x, cid, f"{at}.{key}[{i}]") for key, i, x in reversed(kids)]


def _table(path: str, doc: dict) -> Iterator[tuple]:
    props = doc.get("properties") or {}
    name = posixpath.splitext(posixpath.basename(path))[0]
    landed = props.get("dbTableName")
    yield path, "model", name, None, props.get("modelDataType"), landed, "properties", 0
    for i, x in enumerate(props.get("depends") or []):
        yield path, "depends", name, None, None, x, f"properties.depends[{i}]", i
    for i, x in enumerate(doc.get("dimensions") or []):
        yield path, "dimension", name, x.get("inputField"), x.get("name"), x.get("dataType"), f"dimensions[{i}]", i
    for i, (key, node) in enumerate(((doc.get("dataFlow") or {}).get("nodes") or {}).items()):
        at = f"dataFlow.nodes.{key}"
        yield path, "df_node", key, node.get("alias"), node.get("type"), node.get("moduleTablePath"), at, i
        for j, x in enumerate(node.get("inputNodes") or []):
            yield path, "df_dep", key, x, None, None, at, j
        for j, x in enumerate(node.get("fields") or []):
            yield path, "df_field", key, x.get("originalNode"), x.get("name"), x.get("originalField") or x.get("inputField"), f"{at}.fields[{j}]", j
        for j, x in enumerate((node.get("filter") or {}).get("clauses") or []):
            yield path, "df_filter", key, None, str(j), x.get("exp") or " ".join(str(x.get(k) or "") for k in ("leftExp", "operator", "rightValue")), f"{at}.filter.clauses[{j}]", j
        for j, x in enumerate(node.get("joinConditions") or []):
            yield path, "df_join", key, x.get("leftTable"), x.get("joinType"), x.get("rightTable"), f"{at}.joinConditions[{j}]", j
        for j, x in enumerate(node.get("unionMapArray") or []):
            yield path, "df_union", key, None, str(bool(x.get("visible"))), json.dumps(x.get("values")), f"{at}.unionMapArray[{j}]", j


def walk(path: str, content: str) -> list[tuple]:
    """Flat records of one document; one that can't be read gives a diagnostic and nothing else."""
    try:
        doc = json.loads(content)
        if not isinstance(doc, dict):
            raise ValueError("not an object")
        return [(*r[:5], _scalar(r[5]) if not isinstance(r[5], str) else r[5], *r[6:]) for r in (_page if path.endswith(".spg") else _table)(path, doc)]
    except (ValueError, AttributeError, TypeError) as e:
        return [(path, "diagnostic", None, None, "PARSE_ERROR", str(e)[:200], None, 0)]


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 7 + [pa.int32()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in batches:
        rows = [r for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in walk(path, text or "")]
        for at in range(0, len(rows), 1 << 14):
            columns = list(zip(*rows[at : at + (1 << 14)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def records(files: DataFrame) -> DataFrame:
    """All records of (path, content) documents."""
    return files.select("path", "content").mapInArrow(_walked, RECORD)


def diagnostics(rows: DataFrame) -> DataFrame:
    """(path, code, n, first_at)."""
    return rows.where("kind = 'diagnostic'").groupBy("path", F.col("name").alias("code")).agg(F.count("*").alias("n"), F.min("json_path").alias("first_at"))


def _ids(rows: DataFrame) -> dict:
    comp = F.concat(F.lit("comp:"), "path", F.lit("|"), F.col("id"))
    action = F.concat(F.lit("action:"), "path", F.lit("|"), F.col("parent"), F.lit("|"), F.col("id"))
    return {"comp": comp, "action": action, "page": F.concat(F.lit("page:"), "path"), "model": F.concat(F.lit("model:"), F.col("id"))}


def graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of walked documents. Edges whose ends don't exist are left out by a join at the end, once all nodes are known."""
    i = _ids(rows)
    of = lambda kind: rows.where(F.col("kind") == kind)
    stem = lambda c: F.regexp_extract(c, "([^/]+?)(\\.[^./]*)?$", 1)

    def node(df, id_, kind, name, meta=None):
        return df.select(id_.alias("id"), F.lit(kind).alias("node_type"), F.col("path"), name.alias("name"), (meta if meta is not None else F.lit(None)).cast("string").alias("meta"), F.col("path").alias("origin_file"))

    def edge(df, src, dst, kind, field=None, operation=None):
        field = field if field is not None else F.lit(None)
        operation = operation if operation is not None else F.lit(None)
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), field.cast("string").alias("field_path"), operation.cast("string").alias("operation"), F.lit(None).cast("string").alias("meta"), F.col("path").alias("origin_file"))

    parsed = ex.parse(of("property").where(ex.is_expression(F.col("name"), F.col("value"))).select("path", "id", "name", F.col("value").alias("raw_expr")))
    refs = ex.references(parsed.withColumnRenamed("id", "owner"), ["path", "owner", "name"])
    sources = of("source").select("path", F.col("id").alias("source"), stem(F.col("value")).alias("physical"))
    owner = F.concat(F.lit("comp:"), "path", F.lit("|"), F.col("owner"))
    on_source = refs.where("kind = 'model_field'").join(sources.withColumnRenamed("path", "p"), (F.col("path") == F.col("p")) & (F.col("id") == F.col("source")), "left").withColumn("model", F.coalesce("physical", "id")).drop("p")
    bound = lambda df: df.join(sources.withColumnRenamed("path", "p"), (F.col("path") == F.col("p")) & (F.col("value") == F.col("source")), "left").withColumn("model", F.coalesce("physical", "value")).drop("p")
    model, field = F.concat(F.lit("model:"), "model"), F.concat(F.lit("field:"), "model", F.lit("."), "member")
    acts = bound(of("action").where("value IS NOT NULL"))
    values = of("field_value").withColumnRenamed("value", "given").join(acts.select("path", "parent", "id", "model", F.col("name").alias("action_type")), ["path", "parent", "id"])
    action_type = F.col("name")
    verbs = lambda m: F.create_map(*[F.lit(x) for p in m.items() for x in p])
    conds = of("property").where(F.col("name").isin("visibleCondition", "visible", "enable", "disableCondition", "itemFilter", "calcCondition", "validExp") & ex.is_expression(F.col("name"), F.col("value")))
    cond_id = F.concat(F.lit("cond:"), "path", F.lit("|"), F.col("id"), F.lit("#"), F.col("name"), F.lit("#0"))
    act_conds = of("action_condition")
    act_cond_id = F.concat(F.lit("cond:"), "path", F.lit("|"), F.col("parent"), F.lit("#"), F.col("id"), F.lit("#"), F.col("name"))
    links, embeds = of("action_path"), of("embeds")
    inputs = of("depends").select("path", "id", "value").unionByName(of("df_node").where("value IS NOT NULL").select("path", stem(F.col("path")).alias("id"), "value")).withColumn("input", stem(F.col("value"))).distinct()
    params = lambda kind: of(kind).where("name IS NOT NULL")
    param = F.concat(F.lit("param:"), F.col("name"))
    pages = rows.select("path").distinct().where("path LIKE '%.spg'")

    def symbols(df, id_, name):
        return df.select(id_.alias("id"), F.lit("Field").alias("node_type"), F.col("path"), name.alias("name"), F.lit(None).cast("string").alias("meta"), F.col("path").alias("origin_file"))

    made = [
        node(pages, i["page"], "Page", stem(F.col("path"))),
        node(of("component"), i["comp"], "Component", F.col("id"), F.col("name")),
        node(of("action"), i["action"], "Action", F.col("id"), F.col("name")),
        node(of("model"), i["model"], "Model", F.col("id"), F.col("name")),
        node(sources.withColumnRenamed("physical", "id"), F.concat(F.lit("model:"), "id"), "Model", F.col("id"), F.lit("PhysicalTable")),
        node(inputs, F.concat(F.lit("model:"), "input"), "Model", F.col("input"), F.lit("PhysicalTable")),
        node(of("model").where("value <> ''"), F.concat(F.lit("model:"), "value"), "Model", F.col("value"), F.lit("PhysicalTable")),
        node(of("dimension"), F.concat(F.lit("field:"), "id", F.lit("."), "name"), "Field", F.col("name"), F.col("value")),
        symbols(on_source.where("member <> ''"), field, F.col("member")),
        symbols(values, F.concat(F.lit("field:"), "model", F.lit("."), "name"), F.col("name")),
        symbols(params("passed_param"), param, F.col("name")),
        symbols(params("set_param"), param, F.col("name")),
        node(conds, cond_id, "Condition", F.col("name"), F.col("value")),
        node(act_conds, act_cond_id, "Condition", F.col("name"), F.col("value")),
    ]
    # one row for an id: a real model goes before a placeholder, then the smaller origin
    rank = F.struct((F.col("meta") == "PhysicalTable").alias("placeholder"), "origin_file")
    nodes = reduce(DataFrame.unionByName, made).groupBy("id").agg(*[F.min_by(c, rank).alias(c) for c in NODE_SCHEMA.names if c != "id"]).select(*NODE_SCHEMA.names)
    found = [
        edge(of("component"), i["page"], i["comp"], "Contains"),
        edge(of("component").where("parent IS NOT NULL"), F.concat(F.lit("comp:"), "path", F.lit("|"), F.col("parent")), i["comp"], "Contains"),
        edge(of("action"), F.concat(F.lit("comp:"), "path", F.lit("|"), F.col("parent")), i["action"], "Triggers"),
        edge(on_source, owner, model, "Reads", operation=F.col("name")),
        edge(on_source.where("member <> ''"), owner, field, "Reads", F.col("member"), F.col("name")),
        edge(refs.where("kind IN ('component_value', 'component_property')"), owner, F.concat(F.lit("comp:"), "path", F.lit("|"), F.col("id")), "DependsOn", operation=F.col("name")),
        edge(acts.where(action_type.isin(*WRITES)), i["action"], model, "ActionWrites", operation=verbs(WRITES)[action_type]),
        edge(acts.where(action_type.isin(*LOADS)), i["action"], model, "ActionLoadsData", operation=verbs(LOADS)[action_type]),
        edge(acts.where(action_type == "validateData"), i["action"], model, "ActionValidates", operation=F.lit("validate")),
        edge(values.where(F.col("action_type").isin(*WRITES)), i["action"], F.concat(F.lit("field:"), "model", F.lit("."), "name"), "FieldWrite", F.col("name"), verbs(WRITES)[F.col("action_type")]),
        edge(links, i["action"], F.concat(F.lit("page:"), "value"), "ActionNavigates"),
        edge(embeds, i["comp"], F.concat(F.lit("page:"), "value"), "EmbedsPage"),
        edge(params("passed_param"), i["action"], param, "PassesParam"),
        edge(params("set_param"), i["action"], param, "ActionSetsParam"),
        edge(of("action_target"), i["action"], F.concat(F.lit("comp:"), "path", F.lit("|"), F.col("value")), "ActionControlsComponent"),
        edge(inputs.where("id <> input"), F.concat(F.lit("model:"), "id"), F.concat(F.lit("model:"), "input"), "DataflowInput"),
        edge(of("model").where("value <> ''"), i["model"], F.concat(F.lit("model:"), "value"), "OutputsTo"),
        edge(of("dimension"), i["model"], F.concat(F.lit("field:"), "id", F.lit("."), "name"), "Contains"),
        edge(conds, cond_id, i["comp"], "DependsOn", operation=F.lit("owner")),
        edge(act_conds, act_cond_id, i["action"], "DependsOn", operation=F.lit("owner")),
    ]
    edges = reduce(DataFrame.unionByName, found).select(*EDGE_SCHEMA.names).distinct()
    ids = nodes.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*EDGE_SCHEMA.names)
    return nodes, edges


def read_project(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a project directory."""
    return graph(records(discover(spark, directory)))
