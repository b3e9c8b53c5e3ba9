"""The expression grammar, patterns and small lookups."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import actions as act
from graphloom.functions import expressions as ex
from graphloom.functions.expressions import Parser, parse, ref_kind, references, tokens
from graphloom.operators import output, pattern

CASES = [
    ("=a.value + b", ["a.value", "b"], []),
    ("=if(x > 1, 'y', z)", ["x", "z"], []),
    ("=IF(ISNULL(a), b.c, ${model1.f})", ["a", "b.c", "${model1.f}"], []),
    ("=unknown(a)", ["a"], ["EXPR_UNSUPPORTED_FUNCTION"]),
    ("=-a", [], ["EXPR_PARSE_ERROR"]),
    ("=a in (1, 2)", ["a"], ["EXPR_PARSE_ERROR"]),
    ("=a in (b)", ["a", "b"], []),
    ("=not a and !b or c", ["a", "b", "c"], []),
    ("=a is null", ["a", "NULL"], []),
    ("=x between 1 and y", ["x", "y"], []),
    ("='it\\'s' & \"q\"", [], []),
    ("='open", [], ["EXPR_UNTERMINATED"]),
    ("=${open", ["${open"], ["EXPR_UNTERMINATED"]),
    ("", [], ["EXPR_EMPTY"]),
    ("=", [], ["EXPR_EMPTY"]),
    ("a b", ["a"], ["EXPR_TRAILING"]),
    ("=$user.name == @now", ["$user.name", "@now"], []),
    ("=1.5 * (p + 2) % 3", ["p"], []),
    ("=名前.value", ["名前.value"], []),
    ("=a <> b && c >= d || e <= f", ["a", "b", "c", "d", "e", "f"], []),
]


@pytest.mark.parametrize("text,refs,codes", CASES)
def test_grammar(text, refs, codes):
    p = Parser(text).run()
    assert [r[0] for r in p.refs] == refs and p.codes == codes
    assert all(text[a:b] == t or t == "NULL" for t, a, b in p.refs)


def test_tokens_keep_places():
    text = "  abc+ 'd e'"
    found, closed = tokens(text)
    assert closed and [text[a:b] for _, _, a, b in found] == ["abc", "+", "'d e'"]


def test_reference_kinds(spark):
    cases = {
        "a": ("component_value", "a", "bare"), "a.value": ("component_value", "a", "value"), "a.b.value": ("component_property", "a", "b.value"), "a.step": ("component_property", "a", "step"),
        "a.b": ("other", "a.b", None), "model1.x.y": ("model_field", "model1", "x.y"), "${m.f}": ("model_field", "m", "f"), "${m}": ("model_field", "m", ""), "${param1}": ("param", "param1", None),
        "${$user.id}": ("user_property", "user.id", None), "${$now}": ("system_var", "$now", None), "$user.id": ("user_property", "user.id", None), "$now": ("system_var", "$now", None),
        "param2": ("param", "param2", None), "NULL": ("other", "NULL", None), "9a": ("other", "9a", None), "${a b}": ("other", "${a b}", None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", ref_kind(F.col("t")).alias("k")).collect()
    assert {r.t: tuple(r.k) for r in rows} == cases


def test_parse_rows(spark):
    df = spark.createDataFrame([("p", "c", "=a.value + model1.x"), ("p", "d", None)], "page string, component string, raw_expr string")
    got = {(r.component, r.occurrence): (r.kind, r.id) for r in references(parse(df), ["page", "component"]).collect()}
    assert got == {("c", 0): ("component_value", "a"), ("c", 1): ("model_field", "model1")}


@pytest.mark.parametrize("text", ["DELETE (n)", "CREATE (n)", "MATCH (n) RETURN n " + " " * 17000, "MATCH (n) LOAD CSV RETURN n", ""])
def test_patterns_only_read(text):
    with pytest.raises(ValueError):
        pattern.check(text)


@pytest.mark.parametrize("text", ["MATCH (a)-[:X]-(b) RETURN a.id", "MATCH (a)-[:X]-> RETURN a.id", "MATCH (a) WHERE a.id ~ 'x' RETURN a.id", "MATCH (a) OPTIONAL MATCH (b)-[]->(c) RETURN c.id"])
def test_patterns_that_cant_be_read(spark, text):
    n = spark.createDataFrame([], "id string, node_type string")
    e = spark.createDataFrame([], "src string, dst string, edge_type string")
    with pytest.raises(ValueError):
        pattern.run(n, e, text)


def test_pattern_rows(spark):
    n = spark.createDataFrame([("a", "Page"), ("b", "Model"), ("c", "Model")], "id string, node_type string")
    e = spark.createDataFrame([("a", "b", "Reads"), ("a", "c", "Writes"), ("b", "c", "Reads")], "src string, dst string, edge_type string")
    run = lambda q: [tuple(r) for r in pattern.run(n, e, q).collect()]
    assert run("MATCH (x:Page)-[r]->(y) RETURN y.id, r.edge_type ORDER BY y.id DESC LIMIT 1") == [("c", "Writes")]
    assert run("MATCH (x)-[:Reads]->(y)-[:Reads]->(z) RETURN x.id AS x, z.id AS z") == [("a", "c")]
    assert run("MATCH (x) WHERE x.id = 'a' OR x.id ENDS WITH 'c' RETURN count(*) AS n") == [(2,)]


def test_output(spark):
    row = spark.createDataFrame([("mail a@b.org password: hunter2",)], "t string").select(output.redacted(F.col("t")).alias("t"), output.envelope("page", F.lit("p"), F.struct(F.lit(1).alias("n"))).alias("e")).first()
    assert row.t == "mail ***@*** password: ***" and '"query_target":"p"' in row.e
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b", "Reads"), ("a", "z", "Reads")], "src string, dst string, edge_type string")
    assert output.mermaid(n, e).splitlines() == ["graph LR", '  n0["a"]', '  n1["b"]', "  n0 -->|Reads| n1"]


def test_optional_where_quotes_and_lists(spark):
    n = spark.createDataFrame([("page:a", "Page", "A"), ("page:b", "Page", "B AND C"), ("comp:x", "Component", "it's"), ("comp:y", "Component", "or")], "id string, node_type string, name string")
    e = spark.createDataFrame([("page:a", "comp:x", "Contains"), ("page:a", "comp:y", "Contains")], "src string, dst string, edge_type string")
    run = lambda q: [tuple(r) for r in pattern.run(n, e, q).collect()]
    assert run("MATCH (p:Page) OPTIONAL MATCH (p)-[:Contains]->(c) WHERE c.name = 'or' RETURN p.id, c.id ORDER BY p.id") == [("page:a", "comp:y"), ("page:b", None)]
    assert run("MATCH (p:Page) WHERE p.name = 'B AND C' OR p.name = 'x OR y' RETURN p.id") == [("page:b",)]
    assert run("MATCH (c:Component) WHERE c.name = 'it\\'s' RETURN c.id") == [("comp:x",)]
    assert run("MATCH (p:Page) WHERE p.id = 'page:b' OPTIONAL MATCH (p)-[:Contains]->(c) RETURN p.id, count(c) AS n") == [("page:b", 0)]
    assert run("UNWIND ['a', 'b'] AS x RETURN x ORDER BY x DESC") == [("b",), ("a",)] and run("FOR x IN [3, 4] RETURN x") == [(3,), (4,)]
    assert run("RETURN 1 AS one, 'q' AS two") == [(1, "q")]
    assert run("UNWIND ['page:a', 'page:z'] AS x MATCH (p:Page) WHERE p.id = x RETURN p.name, x") == [("A", "page:a")]
    cut = pattern.answer(n, e, "MATCH (n) RETURN n.id ORDER BY n.id", most=3)
    assert cut["total_rows"] == 4 and cut["truncated"] and cut["columns"] == ["n_id"] and cut["rows"][0] == ["comp:x"]
    assert not pattern.answer(n, e, "MATCH (n:Page) RETURN n.id", most=2)["truncated"]


def test_action_words(spark):
    lit = F.lit
    none = lit(None).cast("string")
    row = spark.range(1).select(act.category(lit("link")).alias("a"), act.category(lit("x")).alias("b"), act.wait_previous(none).alias("c"), act.wait_previous(lit("b1.visible")).alias("d"), act.wait_previous(lit("b1.go")).alias("e")).first()
    assert (row.a, row.b, tuple(row.c)) == ("navigation", "unknown", (None, None, None, False, None))
    assert (row.d.component_id, row.d.action_id, row.d.resolved) == ("b1", None, False) and row.d.reason and (row.e.action_id, row.e.resolved) == ("go", True)
    said = spark.range(1).select(act.sentence(lit("link"), lit("b"), F.array(lit("P"), lit("Q"))).alias("a"), act.sentence(lit("submitData"), lit("b"), F.array().cast("array<string>")).alias("b"), act.sentence(lit("own"), lit("b"), F.array(lit("x"))).alias("c")).first()
    assert tuple(said) == ("点击 b 后跳转到 P, Q", "点击 b 后提交数据（未识别目标字段）", "点击 b 后执行 own 动作")
    flags = lambda *x: [lit(v) for v in x]
    part = spark.range(1).select(*[act.importance(lit(n), lit(k), *flags(*x)).alias(f"c{i}") for i, (n, k, x) in enumerate([
        ("Page", "", (False, True, False, False)), ("Page", "", (False, False, True, True)), ("Component", "panel", (False, True, True, True)), ("Component", "text", (False, False, True, True)),
        ("Component", "button", (False, True, True, True)), ("Component", "button", (False, False, False, False)), ("Action", "", (True, True, True, False)), ("Model", "", (True, False, False, True)), ("Condition", "", (True, True, True, True)),
    ])]).first()
    assert tuple(part) == ("entrypoint", "container", "container", "data_source_display", "entrypoint", "static_display", "entrypoint", "unknown", "condition")


def test_bare_symbols(spark):
    rows = spark.createDataFrame([("${X}",), (" ${ a_1 } ",), ("=${X}",), ("${a.b}",), ("${é}",), ("${}",), ("${a}b",), (None,)], "e string")
    assert [r.s for r in rows.select(ex.bare_symbol(F.col("e")).alias("s")).collect()] == ["X", "a_1", None, None, None, None, None, None]



def test_values_of_expression_fields_are_the_templates(spark):
    from graphloom.plans import registry

    got = registry.queries()["e07_expression_fields"](spark, "/root/testdata/sf0.001").collect()
    shapes = [lambda k: f"=c{k}.value", lambda k: f"plain {k}", lambda k: f"a ${{model{k}.x}}", lambda k: ""]
    assert got and all(r.value == shapes[r.o_orderkey % 4](r.o_orderkey % 9) for r in got)
