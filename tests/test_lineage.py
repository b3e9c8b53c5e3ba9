"""Field lineage, case by case."""

from graphloom.operators import lineage as op

NODE = "id string, node_type string, path string, name string"
EDGE = "src string, dst string, edge_type string, field_path string, meta string"


def test_model_field_lineage(spark):
    models = ["a", "b", "flow", "raw", "raw2", "phys", "maker"]
    names = {"a": ["mapped", "calc", "odd", "made", "written", "lone"], "flow": ["x", "y", "z"], "phys": ["p"], "raw2": ["y"], "raw": ["x0"]}
    nodes = [(f"model:{m}", "Model", f"{m}.tbl", m) for m in models] + [(f"field:{m}.{f}", "Field", f"{m}.tbl", f) for m, fs in names.items() for f in fs] + [("action:w", "Action", "p", "w"), ("action:v", "Action", "p", "v")]
    edges = [(f"model:{m}", f"field:{m}.{f}", "Contains", None, None) for m, fs in names.items() for f in fs]
    edges += [
        ("model:maker", "field:a.made", "DataflowInput", None, None), ("model:maker", "model:raw", "DataflowInput", None, None), ("model:maker", "model:raw2", "DataflowInput", None, None),
        ("model:b", "field:a.made", "DataflowInput", None, None), ("model:b", "model:raw", "DataflowInput", None, None),
        ("action:w", "field:a.written", "ActionWrites", "written", '{"source_expr": "=model7.q + in1.value + model7.q"}'), ("action:v", "model:a", "ActionWrites", "a.written", None), ("action:v", "model:a", "ActionWrites", "a.other", None), ("action:v", "field:a.lone", "FieldWrite", "lone", None),
        ("action:w", "field:a.written", "Writes", "again", '{"source_expr": "=5"}'),
        ("model:flow", "model:raw", "DataflowInput", None, None), ("model:flow", "model:raw2", "DataflowInput", None, None), ("model:maker", "model:phys", "OutputsTo", None, None),
    ]
    fields = [("field:a.mapped", "src", None, None), ("field:a.calc", None, "=m1.x", ["m1", "m2"]), ("field:a.odd", "src", "=??", []), ("field:a.made", None, None, None), ("field:a.written", None, None, None), ("field:a.lone", None, None, None), ("field:flow.x", None, None, None), ("field:flow.y", None, None, None), ("field:flow.z", None, None, None), ("field:phys.p", None, None, None)]
    dims = [("model:maker", 0, "made", "m", "orig", None), ("model:maker", 1, "made", "m", "later", None), ("model:maker", 2, "pp", "p", None, None), ("model:raw", 0, "x0", "x", None, None), ("model:raw", 1, "x", "xx", None, None)]
    f = spark.createDataFrame(fields, "field string, input_field string, expr string, expr_models array<string>")
    rows = op.model_field_lineage(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), f, spark.createDataFrame(dims, "model string, place int, name string, dbfield string, input_field string, exp string"))
    got = {}
    for r in rows.collect():
        got.setdefault(r.field[6:], []).append((r.source, tuple(r.sources), r.expr, r.via, r.confidence))
    # a dataflow that leads to a field has that field among its inputs, too
    expected = {
        "a.mapped": [("input_field", ("field:a.src",), None, "model:a", "high")],
        "a.calc": [("expression", ("model:m1", "model:m2"), "=m1.x", "model:a", "medium")],
        "a.odd": [("expression", (), "=??", "model:a", "low"), ("input_field", ("field:a.src",), None, "model:a", "high")],
        "a.made": [("producer", (), None, "model:b", "medium"), ("producer", ("field:made.orig",), "orig", "model:maker", "high"), ("producer", ("field:raw.orig",), "orig", "model:maker", "high"), ("producer", ("field:raw2.orig",), "orig", "model:maker", "high")],
        "a.written": [("writer", (), "=5", "action:w", "medium"), ("writer", (), None, "action:v", "high"), ("writer", ("field:model7.q",), "=model7.q + in1.value + model7.q", "action:w", "high")],
        "flow.x": [("input_dimension", ("field:raw.x0",), None, "model:flow", "medium")],  # the first dimension of that name or column
        "flow.y": [("input_node", ("field:raw2.y",), None, "model:flow", "medium")],
        "phys.p": [("producer_dimension", ("field:maker.pp",), None, "model:maker", "medium")],
    }
    in_order = lambda of: {k: sorted(v, key=repr) for k, v in of.items()}
    assert in_order(got) == in_order(expected)
    assert {tuple(r) for r in op.lineage_diagnostics(f, rows).collect()} == {("field:a.odd", "LINEAGE_EXPR_UNPARSED"), ("field:a.lone", "LINEAGE_SOURCE_MISSING"), ("field:flow.z", "LINEAGE_SOURCE_MISSING")}


def test_table_field_lineage(spark):
    dims = [("t", "a", "in1", None, None, None), ("t", "b", None, "=model1.x + model1.x + model2.y", "o", "n1"), ("t", "c", None, "=in2.value", None, None), ("t", "d", None, None, "o", None), ("t", "e", None, None, None, None), ("t", "f", "o", "=1", "o", "n")]
    rows = op.table_field_lineage(spark.createDataFrame(dims, "model string, name string, input_field string, exp string, original_field string, original_node string"))
    assert {r["name"]: (r.sources, r.transform, r.confidence) for r in rows.collect()} == {
        "a": (["in1"], "inputField: in1", "high"),
        "b": (["model1.x", "model2.y", "o"], "exp: =model1.x + model1.x + model2.y; originalField: o (node: n1)", "high"),
        "c": ([], "exp: =in2.value", "medium"),
        "d": (["o"], "originalField: o (node: ?)", "high"),
        "f": (["o"], "inputField: o; exp: =1; originalField: o (node: n)", "high"),
    }


def test_output_field_origins(spark):
    outputs = spark.createDataFrame([("m", "out", "a", "da", "src", "col"), ("m", "out", "b", "db", "gone", "col"), ("m", "out", "c", "dc", "bare", "col"), ("m", "out", "d", "dd", "empty", "col"), ("m", "out", "e", "de", "src", None)], "model string, node_id string, name string, dbfield string, original_node string, original_field string")
    nodes = spark.createDataFrame([("m", "out", "o", "out.tbl"), ("m", "n1", "src", "t.tbl"), ("m", "n2", "bare", None), ("m", "n3", "empty", "")], "model string, node_id string, alias string, table_path string")
    wanted = spark.createDataFrame([("m", x) for x in ["a", "db", "c", "d", "e", "zz"]], "model string, field string")
    assert {r.field: (r.table, r.origin, r.confidence, r.missing) for r in op.output_field_origins(outputs, nodes, wanted).collect()} == {
        "a": ("out.tbl", "t.tbl.col", "proven", None),
        "db": ("out.tbl", None, "candidate", "missing originalNode alias in aliasMap"),
        "c": ("out.tbl", None, "candidate", "original node bare has no moduleTablePath"),
        "d": ("out.tbl", None, "candidate", "moduleTablePath is empty"),
        "e": ("out.tbl", None, "proven", None),
        "zz": ("", None, "candidate", "output field not found in DataFlow outputs"),
    }
