"""Traversals, rules and ranking on small hand-made graphs, and documents read from files."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import dataflow, lookup, neighbours, ranking, rules, search
from graphloom.operators import traversal as tr
from graphloom.sources import documents as d


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, edge_type string")


def test_reach_ends_in_cycles(spark):
    links = edges(spark, [("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("c", "d", "x"), ("e", "e", "x")])
    seeds = spark.createDataFrame([("a", "a"), ("e", "e"), ("q", "q")], "target string, node string")
    got = {(r.target, r.node): r.depth for r in tr.closure(seeds, links.select("src", "dst")).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("e", "e"): 0, ("q", "q"): 0}
    assert tr.reach(seeds, links.select("src", "dst"), 1).where("target = 'a'").count() == 2


def test_levels_leave_cycles_out(spark):
    refs = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "x", "y"), ("p", "y", "x"), ("p", "z", "x"), ("p", "s", "s")], "page string, component string, ref string")
    nodes = spark.createDataFrame([("p", x) for x in "abcxyzs"], "page string, component string")
    assert {r.component: r.level for r in tr.levels(refs, nodes).collect()} == {"c": 0, "b": 1, "a": 2}
    assert {r.cycle for r in tr.cycles(refs, 3).collect()} == {"x>y", "s"}


def test_ancestors_prefer_components(spark):
    e = edges(spark, [("page:p", "comp:a", "Contains"), ("page:p", "comp:b", "Contains"), ("comp:a", "comp:b", "Contains"), ("comp:b", "action:x", "Triggers"), ("comp:k", "comp:l", "Contains"), ("comp:l", "comp:k", "Contains")])
    got = {(r.id, r.ancestor): r.distance for r in tr.ancestors(e).collect()}
    # components around a component only: no page, no trigger
    assert got == {("comp:b", "comp:a"): 1, ("comp:k", "comp:l"): 1, ("comp:l", "comp:k"): 1}


def test_simple_paths_and_their_cap(spark):
    e = edges(spark, [("a", "b", "Reads"), ("a", "c", "Reads"), ("b", "a", "Reads"), ("b", "d", "FieldWrite")])
    starts = spark.createDataFrame([("a",)], "start string")
    assert {tuple(r.nodes) for r in tr.simple_paths(e, starts, 3).collect()} == {("a", "b"), ("a", "c"), ("a", "b", "d")}
    assert {tuple(r.nodes) for r in tr.simple_paths(e, starts, 2, per_start=1).collect()} == {("a", "b"), ("a", "b", "d")}


def test_page_rank(spark):
    e = edges(spark, [("a", "b", "Reads"), ("b", "c", "Reads"), ("c", "d", "Contains"), ("z", "y", "Reads")])
    seeds = spark.createDataFrame([("a", 2.0), ("a", 0.0), ("nowhere", 0.0)], "node string, score double")
    ranks = {r.node: r.score for r in ranking.page_rank(e, seeds, "value_source", iterations=60, tolerance=1e-8).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and "y" not in ranks and ranks["b"] > ranks["c"] > ranks["d"]
    with pytest.raises(ValueError):
        ranking.page_rank(e, seeds.where("score = 0"), "writer")
    hanging = ranking.page_rank(e, spark.createDataFrame([("q", 1.0)], "node string, score double"), "writer", iterations=3)
    assert [(r.node, round(r.score, 6)) for r in hanging.collect()] == [("q", 1.0)]


def test_retrieval_metrics(spark):
    found = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "case_id int, node string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (1, "z"), (2, "y")], "case_id int, node string")
    assert tuple(ranking.retrieval_metrics(found, relevant, 2).first()) == (0.25, 0.25)


def test_guard(spark):
    n = spark.createDataFrame([("page:a", "Page", "a", "a"), ("model:m", "Model", "m", "m")], "id string, node_type string, path string, name string")
    e = spark.createDataFrame([("page:a", "model:m", "Reads", None)], "src string, dst string, edge_type string, field_path string")
    rules.guard(n, e.limit(0))
    with pytest.raises(ValueError, match="bad_endpoints"):
        rules.guard(n, e)
    with pytest.raises(ValueError, match="wrong_prefix"):
        rules.guard(n.unionByName(spark.createDataFrame([("x", "Page", "x", "x")], n.schema)), e.limit(0))


def test_incremental_equals_rebuilt(spark):
    schema = "origin_file string, kind string, entity_id string, payload string"
    old = spark.createDataFrame([("a", "Definition", "m", "1"), ("b", "Reference", "m", "2"), ("b", "Reference", "n", "3")], schema)
    new_a = spark.createDataFrame([("a", "Reference", "m", "9"), ("a", "Definition", "n", "8")], schema)
    state = rules.applied(old, new_a.select("origin_file"), new_a)
    whole = old.where("origin_file = 'b'").unionByName(new_a)
    assert rules.multiset_difference(rules.rebuilt(state), rules.rebuilt(whole)).isEmpty()
    got = {r.entity_id: (r.kind, r.payload) for r in rules.rebuilt(state).collect()}
    assert got == {"m": ("Placeholder", "9"), "n": ("Definition", "8")}


def test_field_trace_stops(spark):
    fields = spark.createDataFrame([("m", "n2", "x", "dbx", "y", "n1"), ("m", "n1", "y", "y", None, None), ("m", "n3", "c", "c", "c", "n3"), ("m", "n4", "u", "u", "v", "gone")], "model string, node string, name string, dbfield string, original_field string, original_node string")
    start = spark.createDataFrame([("m", "n2", "dbx"), ("m", "n3", "c"), ("m", "n4", "u")], "model string, node string, field string")
    got = {r.field: (r.path, r.stop) for r in dataflow.field_trace(fields, start).collect()}
    assert got == {"dbx": ("n2.dbx<n1.y", "origin"), "c": ("n3.c", "cycle"), "u": ("n4.u<gone.v", "unknown")}


def test_missing_edges_and_lookup(spark):
    n = spark.createDataFrame([("page:a", "Page", "a", "Alpha"), ("model:b1", "Model", "b", "Beta")], "id string, node_type string, path string, name string")
    e = edges(spark, [("page:a", "model:b1", "Reads"), ("page:a", "model:zz", "Reads")])
    assert neighbours.existing(n, e).count() == 1
    assert [r.id for r in lookup.find(n, ["ALPHA"]).collect()] == ["page:a"]
    targets = spark.createDataFrame([("model:b2",), ("model:bb1",), ("page:b1",)], "target string")
    got = {(r.target, r.id, r.score) for r in search.candidates(search.text_index(n), targets).collect()}
    assert got == {("model:b2", "model:b1", 55), ("model:bb1", "model:b1", 80), ("page:b1", "model:b1", 70), ("page:b1", "page:a", 45)}
    assert lookup.by_id(n, spark.createDataFrame([("page:a",), ("x",)], "target string")).where("id IS NULL").count() == 1


PAGE = {
    "version": "1", "params": [{"id": "param1", "name": "param1"}],
    "sources": [{"id": "model1", "modelType": "dwtable", "path": "$DATA:/t.tbl", "filter": {"clauses": [{"exp": "model1.a > 1"}]}}],
    "canvas": {"id": "root", "type": "canvas", "components": [
        {"id": "in1", "type": "input", "value": "=${model1.a}", "visibleCondition": "=in2.value > 1", "text": "plain"},
        {"id": "in2", "type": "input", "weird": [{"id": "kid", "type": "label", "exp": "=model1.b"}], "actions": [
            {"id": "act1", "actionType": "submitData", "dataSet": "model1", "fieldValues": [{"name": "a", "value": "=in1.value"}], "conditionExp": "=in1 = 1"},
            {"id": "act2", "actionType": "link", "path": "../b/two.spg", "data": [{"name": "p", "value": "1"}]},
            {"id": "act3", "actionType": "hideComponent", "targetComponent": ["in1"]}]},
        {"id": "in1", "type": "input"}]},
}


def test_documents(spark, tmp_path):
    (tmp_path / "app/a").mkdir(parents=True)
    (tmp_path / "app/b").mkdir()
    (tmp_path / "data").mkdir()
    (tmp_path / "app/a/one.spg").write_text(json.dumps(PAGE))
    (tmp_path / "app/b/two.spg").write_text(json.dumps({"canvas": {"id": "root", "type": "canvas"}}))
    (tmp_path / "app/b/bad.spg").write_text("{")
    (tmp_path / "app/b/skip.SPG").write_text("{}")
    (tmp_path / "data/t.tbl").write_text(json.dumps({"properties": {"modelDataType": "DataFlow", "dbTableName": "phys", "depends": ["u.tbl"]}, "dimensions": [{"name": "a", "dataType": "C"}], "dataFlow": {"nodes": {"n": {"id": "n", "type": "ModelTable", "moduleTablePath": "v.tbl"}}}}))
    files = d.discover(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == ["app/a/one.spg", "app/b/bad.spg", "app/b/two.spg", "data/t.tbl"]
    rows = d.records(files)
    assert {(r.path, r.code) for r in d.diagnostics(rows).collect()} == {("app/b/bad.spg", "PARSE_ERROR"), ("app/a/one.spg", "DUPLICATE_COMPONENT_ID")}
    nodes, found = d.graph(rows)
    got = {(r.src, r.dst, r.edge_type) for r in found.collect()}
    p = "app/a/one.spg"
    for x in [
        (f"page:{p}", f"comp:{p}|kid", "Contains"), (f"comp:{p}|in2", f"comp:{p}|kid", "Contains"), (f"comp:{p}|in1", "model:t", "Reads"), (f"comp:{p}|in1", "field:t.a", "Reads"),
        (f"comp:{p}|kid", "field:t.b", "Reads"), (f"comp:{p}|in1", f"comp:{p}|in2", "DependsOn"), (f"action:{p}|in2|act1", "model:t", "ActionWrites"), (f"action:{p}|in2|act1", "field:t.a", "FieldWrite"),
        (f"action:{p}|in2|act2", "page:app/b/two.spg", "ActionNavigates"), (f"action:{p}|in2|act2", "param:p", "PassesParam"), (f"action:{p}|in2|act3", f"comp:{p}|in1", "ActionControlsComponent"),
        ("model:t", "model:u", "DataflowInput"), ("model:t", "model:v", "DataflowInput"), ("model:t", "model:phys", "OutputsTo"), ("model:t", "field:t.a", "Contains"),
        (f"cond:{p}|in1#visibleCondition#0", f"comp:{p}|in1", "DependsOn"), (f"cond:{p}|in2#act1#conditionExp", f"action:{p}|in2|act1", "DependsOn"),
    ]:
        assert x in got, x
    kinds = {r.id: (r.node_type, r.meta) for r in nodes.collect()}
    assert kinds["model:t"] == ("Model", "DataFlow") and kinds["model:u"] == ("Model", "PhysicalTable")
    assert rules.node_violations(nodes).isEmpty()
    assert {r.violation for r in rules.edge_violations(nodes, found).collect()} <= {"missing_field_path"}


@pytest.mark.parametrize("text,page,out", [("../x.spg", "app/a/p.spg", "app/x.spg"), ("$APP:/m/x.spg", "q", "app/m/x.spg"), ("../../x", "a/p", None), ("http://x/y", "a/p", None), ("/a/./b.spg", "q", "a/b.spg"), ("x\\y.spg", "a/p", "a/x/y.spg")])
def test_references_to_files(text, page, out):
    assert d.resolved(text, page) == out


def test_prefix_ancestors(spark):
    rows = spark.createDataFrame([("p", "a", "canvas"), ("p", "b", "canvas.components[1]"), ("p", "c", "canvas.components[10]"), ("p", "d", "canvas.components[1].actions[0]"), ("q", "e", "canvas.x")], "page string, id string, json_path string")
    assert {tuple(r) for r in tr.prefix_ancestors(rows).collect()} == {("b", "a"), ("c", "a"), ("d", "a"), ("d", "b")}


def test_drawing_and_budgets(spark):
    from graphloom.operators import explain

    n = spark.createDataFrame([("page:a",), ("model:b",)], "id string")
    e = edges(spark, [("page:a", "model:b", "Reads")])
    assert explain.echarts(n, e)["links"] == [{"source": "page:a", "target": "model:b", "value": "Reads"}]
    row = spark.range(1).selectExpr("sequence(1, 30) AS a").select(*[explain.budgeted(F.col("a"), b).alias(b) for b in ("compact", "normal", "full")]).first()
    assert [len(row[b]) for b in ("compact", "normal", "full")] == [5, 20, 30]


def test_shrinking_and_advice():
    from graphloom.operators import explain

    answer = {"main": ["x" * 50], "near": ["y" * 20] * 30, "far": list(range(4))}
    small = explain.shrunk(answer, ["near", "far"], 300)
    assert len(small["near"]) == 8 and small["truncated"] == ["near"] and len(small["far"]) == 4 and small["main"] == answer["main"]
    assert explain.shrunk(answer, ["near"], 10**6) == answer and len(explain.shrunk(answer, ["near"], 10)["near"]) == 1
    assert explain.advice("model:x", True) == ["explain model:x", "lineage model:x"] and explain.advice("x", False) == ["find x"]


def test_byte_budgets():
    from graphloom.operators import explain

    answer = {"near": ["x" * 1090] * 30, "main": "y"}
    assert len(explain.fitted(answer, ["near"], "compact")["near"]) == 5 and explain.fitted(answer, ["near"], "normal") == answer == explain.fitted(answer, ["near"], "full")
    large = {"near": ["x" * 30000] * 9}
    assert len(explain.fitted(large, ["near"], "normal")["near"]) == 2 and len(explain.fitted(large, ["near"], "compact")["near"]) == 1


def test_targets_are_normalised(spark):
    ids = ["page:app/actions_test.spg", "page:app/b/other.spg", "action:app/f.spg|button2|a1", "action:app/g.spg|button3|a1", "action:app/g.spg|button3|a2", "comp:app/f.spg|button2", "model:m1", "model:df_b", "comp:app/actions_test.spg|solo"]
    nodes = spark.createDataFrame([(x, "", "", "") for x in ids], "id string, node_type string, path string, name string")
    asked = {
        "page:actions_test": ("page:app/actions_test.spg", 1, "resolved"), "action:f|button2": ("action:app/f.spg|button2|a1", 3, "resolved"), "dataflow:df_b": ("model:df_b", 2, "resolved"),
        "model:actions_test|m1": ("model:m1", 4, "resolved"), "comp:SOLO": ("comp:app/actions_test.spg|solo", 5, "resolved"), "comp:made/up.spg|button2": ("comp:app/f.spg|button2", 6, "resolved"),
        "action:g.spg|button3": ("action:app/g.spg|button3|a1,action:app/g.spg|button3|a2", 3, "ambiguous"), "page:other.SPG": ("page:app/b/other.spg", 1, "resolved"), "model:m1": ("model:m1", 0, "exact"),
        "model:none": ("", -1, "not_found"), "plain": ("", -1, "not_found"), "page:ther": ("", -1, "not_found"),
    }
    got = lookup.normalise_targets(nodes, spark.createDataFrame([(x,) for x in asked], "target string")).collect()
    assert {r.target: (r.ids, r.tier, r.status) for r in got} == asked


def test_few_targets_are_sent_to_the_nodes_and_cut_before_their_ids_meet(spark, monkeypatch):
    ids = [f"comp:app/p.spg|c{k:03}" for k in range(200)] + [f"action:app/p.spg|c{k:03}|a" for k in range(200)]
    nodes = spark.createDataFrame([(x,) for x in ids], "id string")
    written, real = [], lookup.settled
    monkeypatch.setattr(lookup, "settled", lambda df: written.append(df) or real(df))
    got = lookup.normalise_targets(nodes, spark.createDataFrame([("comp:p",), ("action:P.spg",), ("action:q.spg|c003|a",)], "target string")).collect()
    assert {r.target: (r.tier, r.status, r.ids.split(",")) for r in got} == {"comp:p": (3, "ambiguous", ids[:12]), "action:P.spg": (3, "ambiguous", ids[200:212]), "action:q.spg|c003|a": (6, "resolved", [ids[203]])}
    cut = [df for df in written if "tier" in df.columns]
    plan = cut[0]._jdf.queryExecution().executedPlan().toString()
    assert len(cut) == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and cut[0].count() <= 3 * 12


def test_cross_relations(spark):
    e = edges(spark, [("p", "m", "Reads"), ("p", "m", "Contains"), ("q", "m", "Writes"), ("q", "n", "Reads"), ("r", "n", "Reads")])
    pairs = spark.createDataFrame([("p", "q"), ("q", "r"), ("p", "r")], "a string, b string")
    assert {tuple(r) for r in neighbours.cross_relations(e, pairs).collect()} == {("p", "q", "m", "Contains", "Writes"), ("q", "r", "n", "Reads", "Reads")}


def test_context_summary_sums_up_the_rows_of_context(spark):
    edges = [(f"comp:{k}", f"model:{k % 3}", kind) for k in range(12) for kind in ("Reads", "Writes")[: 1 + k % 2]]
    edges += [(f"model:{k}", "model:hub", "DataflowInput") for k in range(3)] + [("model:hub", "model:0", "OutputsTo"), ("model:0", "model:0", "Self")] + [edges[0]]
    e = spark.createDataFrame(edges, "src string, dst string, edge_type string")
    seeds = spark.createDataFrame([(f"model:{k}",) * 2 for k in (0, 1, 2, "hub", "alone")], "target string, node string")
    for depth in (1, 2, 3):
        rows = {}
        for r in tr.context(e, seeds, depth).collect():
            rows.setdefault((r.target, r.direction, r.edge_type), []).append((r.src, r.dst))
        got = {(r.target, r.direction, r.edge_type): (r.n, r.first_src, r.last_dst) for r in tr.context_summary(e, seeds, depth).collect()}
        assert got == {k: (len(x), min(x)[0], max(d for _, d in x)) for k, x in rows.items()}
