"""Where a model's fields come from: mappings, expressions, dataflows that make them, actions that write them, and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import parse, ref_kind
from .paths import SINK_EDGES
from .traversal import settled

_ROW = ["field", "source", "sources", "expr", "via", "confidence"]


def _row(df: DataFrame, source: str | Column, sources: Column, expr: Column, via: Column, confidence: str | Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("field", lit(source).alias("source"), sources.cast("array<string>").alias("sources"), expr.cast("string").alias("expr"), via.cast("string").alias("via"), lit(confidence).alias("confidence")).distinct()


def _dimension(dims: DataFrame, by_column: bool) -> DataFrame:
    """(model, field_name, dim): a model's first dimension of a name; by_column: or of a database column."""
    d = dims.select("model", "place", F.struct("name", "dbfield", "input_field", "exp").alias("dim"))
    named = d.select("model", F.col("dim.name").alias("field_name"), "place", "dim")
    if by_column:
        named = named.unionByName(d.select("model", F.col("dim.dbfield").alias("field_name"), "place", "dim"))
    return named.where("field_name <> ''").groupBy("model", "field_name").agg(F.min_by("dim", "place").alias("dim"))


def model_field_lineage(nodes: DataFrame, edges: DataFrame, fields: DataFrame, dims: DataFrame) -> DataFrame:
    """(field, source, sources, expr, via, confidence): every origin of each field (fields: field, input_field, expr, expr_models).

    input_field: the mapped field of its own model, high. expression: the models that its expression names, medium, or low
    if there are none. producer: for each dataflow that leads to the field, and each input of that dataflow, the field that
    the dataflow's dimension of this name maps, high, or medium without one. writer: the fields that a writing action's
    expression names (a write of the field, or of its model with a field path that ends so), medium if some reference is
    unknown, else high. A field without any of these has, medium, for each
    dataflow input of its model the field of this name or database column (input_dimension), else the input's node of this
    name (input_node), and the same of the dataflows that output its model (producer_dimension). dims: model, place, name,
    dbfield, input_field, exp.
    """
    named = nodes.select("id", "name")
    held = edges.where("edge_type = 'Contains' AND dst LIKE 'field:%'").join(named.withColumnRenamed("name", "model_name"), F.col("src") == F.col("id"))
    parent = held.groupBy(F.col("dst").alias("field")).agg(F.min(F.struct(F.col("src").alias("model"), "model_name")).alias("p"))
    own = fields.join(named.select(F.col("id").alias("field"), F.col("name").alias("field_name")), "field").join(parent, "field", "left")
    own = settled(own.select("field", "field_name", "input_field", "expr", "expr_models", "p.model", "p.model_name"))
    none, no_expr = F.expr("cast(array() as array<string>)"), F.lit(None)
    field_of = lambda model, name: F.concat(F.lit("field:"), model, F.lit("."), name)
    out = [_row(own.where("input_field IS NOT NULL"), "input_field", F.array(field_of(F.coalesce("model_name", F.lit("?")), F.col("input_field"))), no_expr, F.col("model"), "high")]
    models = F.transform(F.coalesce("expr_models", none), lambda m: F.concat(F.lit("model:"), m))
    out.append(_row(own.where("expr IS NOT NULL"), "expression", models, F.col("expr"), F.col("model"), F.when(F.size(models) > 0, "medium").otherwise("low")))
    inputs = settled(edges.where("edge_type = 'DataflowInput'").join(named.select(F.col("id").alias("dst"), F.col("name").alias("input_name")), "dst").select("src", "dst", "input_name").distinct())
    made = own.join(edges.where("edge_type = 'DataflowInput'").select(F.col("dst").alias("field"), F.col("src").alias("producer")).distinct(), "field")
    made = made.join(_dimension(dims, False).withColumnRenamed("model", "producer"), ["producer", "field_name"], "left").join(inputs.withColumnRenamed("src", "producer"), "producer")
    mapped = F.coalesce("dim.input_field", "dim.exp")
    out.append(_row(made, "producer", F.when(mapped.isNotNull(), F.array(field_of(F.col("input_name"), mapped))).otherwise(none), mapped, F.col("producer"), F.when(mapped.isNotNull(), "high").otherwise("medium")))
    said = F.get_json_object("meta", "$.source_expr") if "meta" in edges.columns else F.lit(None).cast("string")
    writes = settled(edges.where(F.col("edge_type").isin(*SINK_EDGES)).select("src", "dst", "edge_type", "field_path", said.alias("expr")).distinct())
    direct = own.select("field").join(writes, F.col("field") == F.col("dst")).select("field", "src", "expr")
    through = own.select("field", "field_name", "model").join(writes.where("field_path IS NOT NULL"), F.col("model") == F.col("dst")).where(F.substring_index("field_path", ".", -1) == F.col("field_name")).select("field", "src", "expr")
    writer = settled(direct.unionByName(through).distinct())
    read = parse(writer.where("expr IS NOT NULL").select(F.col("expr").alias("key"), F.col("expr").alias("raw_expr")).distinct())
    kinds = read.select("key", F.transform("refs", lambda r: ref_kind(r["token"])).alias("kinds"))
    wrote = writer.join(kinds, F.col("expr") == F.col("key"), "left")
    named_fields = F.array_distinct(F.transform(F.filter(F.coalesce("kinds", F.array().cast(kinds.schema["kinds"].dataType)), lambda k: k["kind"] == "model_field"), lambda k: field_of(k["id"], k["member"])))
    unknown = (F.size("kinds") == 0) | F.exists("kinds", lambda k: k["kind"] == "other")
    out.append(_row(wrote, "writer", named_fields, F.col("expr"), F.col("src"), F.when(F.coalesce(unknown, F.lit(False)), "medium").otherwise("high")))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    found = settled(found)
    left = settled(own.join(found.select("field").distinct(), "field", "left_anti").where("model IS NOT NULL").select("field", "field_name", "model"))
    by_dim = _dimension(dims, True)
    chain = left.join(inputs.withColumnRenamed("src", "model"), "model").join(by_dim.withColumnRenamed("model", "dst"), ["dst", "field_name"], "left")
    exists = nodes.where("id LIKE 'field:%'").select(F.col("id").alias("node"))
    one = _row(chain.where("dim IS NOT NULL"), "input_dimension", F.array(field_of(F.col("input_name"), F.col("dim.name"))), no_expr, F.col("model"), "medium")
    two = chain.where("dim IS NULL").withColumn("node", field_of(F.col("input_name"), F.col("field_name"))).join(exists, "node", "left_semi")
    two = _row(two, "input_node", F.array("node"), no_expr, F.col("model"), "medium")
    outputs = edges.where("edge_type = 'OutputsTo'").select(F.col("dst").alias("model"), F.col("src").alias("producer")).distinct().join(named.select(F.col("id").alias("producer"), F.col("name").alias("producer_name")), "producer")
    three = left.join(outputs, "model").join(by_dim.withColumnRenamed("model", "producer"), ["producer", "field_name"])
    three = _row(three, "producer_dimension", F.array(field_of(F.col("producer_name"), F.col("dim.name"))), no_expr, F.col("producer"), "medium")
    return found.unionByName(one).unionByName(two).unionByName(three).select(*_ROW)


def lineage_diagnostics(fields: DataFrame, lineage: DataFrame) -> DataFrame:
    """(field, code): an expression that names no model, and fields without any origin."""
    unread = lineage.where("source = 'expression' AND size(sources) = 0").select("field", F.lit("LINEAGE_EXPR_UNPARSED").alias("code"))
    lost = fields.select("field").join(lineage.select("field"), "field", "left_anti").select("field", F.lit("LINEAGE_SOURCE_MISSING").alias("code"))
    return unread.unionByName(lost).distinct()


def table_field_lineage(dims: DataFrame) -> DataFrame:
    """(model, name, sources, transform, confidence) of a table's dimensions (model, name, input_field, exp, original_field, original_node).

    Sources are the mapped field, the model fields that the expression names, and the original field, each once. An
    expression whose references are no model fields makes it medium. Dimensions with neither of the three have no row.
    """
    rows = dims.select("model", "name", "input_field", "exp", "original_field", "original_node").distinct()
    read = parse(rows.where("exp IS NOT NULL").select(F.col("exp").alias("key"), F.col("exp").alias("raw_expr")).distinct())
    kinds = read.select("key", F.transform("refs", lambda r: ref_kind(r["token"])).alias("kinds"))
    rows = rows.join(kinds, F.col("exp") == F.col("key"), "left")
    empty = F.array().cast(kinds.schema["kinds"].dataType)
    named = F.transform(F.filter(F.coalesce("kinds", empty), lambda k: k["kind"] == "model_field"), lambda k: F.concat(k["id"], F.lit("."), k["member"]))
    before = F.array_compact(F.array("input_field"))
    sources = F.array_distinct(F.concat(before, named, F.array_compact(F.array("original_field"))))
    none = F.size(F.array_distinct(F.concat(before, named))) == 0
    medium = F.col("exp").isNotNull() & none & (F.size(F.coalesce("kinds", empty)) > 0)
    origin = F.concat(F.lit("originalField: "), "original_field", F.lit(" (node: "), F.coalesce("original_node", F.lit("?")), F.lit(")"))
    told = F.array_join(F.array_compact(F.array(F.concat(F.lit("inputField: "), "input_field"), F.concat(F.lit("exp: "), "exp"), origin)), "; ")
    out = rows.select("model", "name", sources.alias("sources"), told.alias("transform"), F.when(medium, "medium").otherwise("high").alias("confidence"), "exp", "input_field")
    return out.where("size(sources) > 0 OR exp IS NOT NULL OR input_field IS NOT NULL").drop("exp", "input_field")


def output_field_origins(outputs: DataFrame, df_nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(model, field, table, original_node, original_field, origin, confidence, missing): what a dataflow's output field physically is.

    outputs (model, node_id, name, dbfield, original_node, original_field) are the fields of output nodes, a wanted field
    (model, field) matches by name, else by database column, at the first node; df_nodes is (model, node_id, alias,
    table_path). It is proven if its original node, by alias, has a table, else a candidate with what is missing.
    """
    name = outputs.select("model", F.col("name").alias("field"), F.lit(0).alias("way"), "node_id", "dbfield", "original_node", "original_field")
    column = outputs.select("model", F.col("dbfield").alias("field"), F.lit(1).alias("way"), "node_id", "dbfield", "original_node", "original_field")
    first = name.unionByName(column).groupBy("model", "field").agg(F.min(F.struct("node_id", "way", "dbfield", "original_node", "original_field")).alias("r"))
    alias = df_nodes.where("alias IS NOT NULL").groupBy("model", F.col("alias").alias("original_node")).agg(F.min_by(F.struct("node_id", "table_path"), "node_id").alias("o"))
    own = df_nodes.groupBy("model", "node_id").agg(F.first("alias", True).alias("own_alias"), F.first("table_path", True).alias("own_path"))
    rows = wanted.select("model", "field").distinct().join(first, ["model", "field"], "left").select("model", "field", "r.*")
    rows = rows.join(own, ["model", "node_id"], "left").join(alias, ["model", "original_node"], "left")
    missing = (
        F.when(F.col("node_id").isNull(), "output field not found in DataFlow outputs")
        .when(F.col("o").isNull(), "missing originalNode alias in aliasMap")
        .when(F.col("o.table_path").isNull(), F.concat(F.lit("original node "), "original_node", F.lit(" has no moduleTablePath")))
        .when(F.col("o.table_path") == "", "moduleTablePath is empty")
    )
    origin = F.when(missing.isNull() & F.col("original_field").isNotNull(), F.concat("o.table_path", F.lit("."), "original_field"))
    table = F.when(F.col("node_id").isNotNull(), F.coalesce("own_path", "own_alias", "node_id")).otherwise("")
    return rows.select("model", "field", table.alias("table"), "original_node", "original_field", origin.alias("origin"), F.when(missing.isNull(), "proven").otherwise("candidate").alias("confidence"), missing.alias("missing"))
