"""Models of a page on a small graph, case by case."""

from graphloom.operators import explain, paths, scope

NODE = "id string, node_type string, path string, name string, meta string"
EDGE = "src string, dst string, edge_type string, field_path string, meta string"
FLOW = '{"modelType": "DataFlow"}'


def graph(spark):
    nodes = [
        ("page:app/p.spg", "Page", "app/p.spg", "p", None), ("page:app/q.spg", "Page", "app/q.spg", "q", None),
        ("comp:app/p.spg|c", "Component", "app/p.spg", "c", None), ("comp:app/p.spg|inner", "Component", "app/p.spg", "Model1 box", None), ("comp:app/q.spg|d", "Component", "app/q.spg", "d", None),
        ("comp:emb|e", "Component", "emb.spg", "e", None), ("action:app/p.spg|c|a", "Action", "app/p.spg", "a", None),
        ("model:model1", "Model", "data/t1.tbl", "One", None), ("model:MODEL1", "Model", "x", "Other", None), ("model:model2", "Model", "", "Two", None), ("model:model3", "Model", "data/t3.tbl", "Three", None),
        ("model:alone", "Model", "data/alone.tbl", "Alone", None),
        ("model:flowA", "Model", "data/tables/sub/f1.tbl", "A", FLOW), ("model:flowB", "Model", "$DATA:/sub/f1.tbl", "B", FLOW), ("model:flowC", "Model", "other/t3.tbl", "C", FLOW), ("model:flowD", "Model", "x/d.tbl", "D", FLOW),
    ]
    edges = [
        ("page:app/p.spg", "comp:app/p.spg|c", "Contains", None, None), ("page:app/p.spg", "comp:app/p.spg|inner", "Contains", None, None), ("page:app/q.spg", "comp:app/q.spg|d", "Contains", None, None),
        ("comp:app/p.spg|c", "action:app/p.spg|c|a", "Triggers", None, None), ("comp:app/p.spg|c", "comp:emb|e", "Contains", None, None),
        # p names model1 at two paths: the first in order counts
        ("comp:app/p.spg|c", "model:model1", "Reads", None, '{"target_model_path": "$DATA:/sub/f1.tbl"}'), ("action:app/p.spg|c|a", "model:model1", "ActionWrites", None, None),
        # q reads it plainly
        ("comp:app/q.spg|d", "model:model1", "Reads", None, None),
        # what is embedded in p leads to model3, and to model2 under the name of model3x
        ("comp:emb|e", "model:model3", "Reads", None, None), ("comp:emb|e", "model:model1", "Reads", None, '{"target_model": "model2", "target_model_path": "x/d.tbl"}'),
        # inputs of the flows: B has two, so A is meant; model2's input is a flow elsewhere
        ("model:flowB", "model:flowA", "DataflowInput", "sub/one.tbl", None), ("model:flowB", "model:model1", "DataflowInput", None, None), ("model:model2", "model:flowC", "DataflowInput", "nowhere", None),
    ]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def test_page_scoped_models(spark):
    nodes, edges = graph(spark)
    targets = spark.createDataFrame([("model:app/p.spg|model1",), ("model:page:app/q.spg | model1",), ("model:app/p.spg|model3",), ("model:app/p.spg|model2",), ("model:app/q.spg|alone",), ("model:app/p.spg|nothing",), ("model:|x",), ("model:model1",), ("comp:a|b",)], "target string")
    requests = scope.scoped_requests(targets)
    assert sorted(tuple(r) for r in requests.select("page", "model").collect()) == [("page:app/p.spg", "model1"), ("page:app/p.spg", "model2"), ("page:app/p.spg", "model3"), ("page:app/p.spg", "nothing"), ("page:app/q.spg", "alone"), ("page:app/q.spg", "model1")]
    got = {(r.page[-5], r.model): (r.path, r.dataflow) for r in scope.page_scoped_models(nodes, edges, requests).collect()}
    assert got == {
        ("p", "model1"): ("$DATA:/sub/f1.tbl", "model:flowA"),  # two flows at that path, the one with fewer inputs
        ("q", "model1"): ("data/t1.tbl", None),
        ("p", "model3"): ("data/t3.tbl", "model:flowC"),  # only what p holds leads to it; a flow of that file name
        ("p", "model2"): ("x/d.tbl", "model:flowC"),  # the path is that of flowD, but an input comes first
        ("q", "alone"): (None, None),
        ("p", "nothing"): (None, None),
    }


def test_page_models(spark):
    nodes, edges = graph(spark)
    asked = [("page:app/p.spg", "model1"), ("page:app/p.spg", "COMP:app/p.spg|C"), ("page:app/q.spg", "model:Model2"), ("page:none", "model1"), ("page:app/q.spg", "zz"), ("page:app/p.spg", "C")]
    got = {}
    for r in scope.page_models(nodes, edges, spark.createDataFrame(asked, "page string, name string")).orderBy("id").collect():
        got.setdefault((r.page, r.name), []).append((r.id, r.score, r.resolved, r.ambiguous))
    assert got == {
        asked[0]: [("comp:app/p.spg|inner", 80, 3, True), ("model:MODEL1", 60, 3, True), ("model:model1", 60, 3, True)],
        asked[1]: [("comp:app/p.spg|c", 100, 1, False)],
        asked[2]: [("model:model2", 60, 1, False)],
        asked[5]: [("comp:app/p.spg|c", 80, 2, True), ("comp:app/p.spg|inner", 80, 2, True)],
    }


def test_paths_that_are_the_same(spark):
    rows = [("$DATA:/a/b.tbl", "a/b.tbl", "b"), ("data/tables/x.y.tbl", "x.y.tbl", "x.y"), ("data\\q.tbl/", "q.tbl", "q"), ("//r", "r", "r"), (".hidden", ".hidden", ".hidden"), ("", "", "")]
    got = spark.createDataFrame(rows, "p string, same string, stem string").select(scope.same_path("p"), "same", scope.stem(scope.same_path("p")), "stem").collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)


def test_confidence_reasons_keep_their_order(spark):
    rows = [("a", "NO_ENTRYPOINTS", 1), ("a", "DATAFLOW_INPUT_PATH_UNRESOLVED", 3), ("a", "OWN", 0), ("a", "NO_ENTRYPOINTS", 5), ("b", "OUTPUT_TRUNCATED", 2), ("b", "TARGET_NOT_FOUND", 1), ("c", "OWN", 1), ("d", "RESOLVED_TARGET", 1)]
    got = {r.k: (r.confidence, r.reasons) for r in explain.confidence_rollup(spark.createDataFrame(rows, "k string, code string, place int"), "k").collect()}
    assert got == {
        "a": ("reduced", "NO_ENTRYPOINTS=determinate,DATAFLOW_INPUT_PATH_UNRESOLVED=uncertain"),
        "b": ("partial", "TARGET_NOT_FOUND=addressing,OUTPUT_TRUNCATED=partial"),
        "c": ("full", ""),
        "d": ("full", "RESOLVED_TARGET=routing"),
    }


def test_intents(spark):
    rows = [(["Reads", "FieldAlias"], "primary"), (["Reads", "Writes"], "primary"), (["Contains"], "candidate"), (["Triggers"], "rejected")]
    df = spark.createDataFrame(rows, "kinds array<string>, class string")
    status = lambda intent: [(r.status, r.reject_reason) for r in paths.partitioned(df, intent).collect()]
    bad, gone = ("rejected", "edge_type_not_allowed_for_value_source_intent"), ("rejected", "path_selector_rejected")
    assert status("value_source") == [("proven", None), bad, bad, gone]
    need = ("rejected", "writer_intent_requires_write_edge")
    assert status("writer") == [need, ("proven", None), need, gone]
    assert status("context") == [("proven", None), ("proven", None), ("candidate", None), gone]


def test_page_models_meet_texts_by_the_ends_of_names(spark, monkeypatch):
    nodes = [("page:p", "Page", "p", "p"), ("page:q", "Page", "q", "q"), ("model:Ab", "Model", "m", "x")]
    nodes += [(f"comp:p|c{k}", "Component", "p", f"Long name {k}") for k in (1, 12, 123)] + [("comp:q|c1", "Component", "q", "abab")]
    edges = [("page:p", n[0], "Contains") for n in nodes if n[0].startswith("comp:p")] + [("page:q", "comp:q|c1", "Contains")]
    names = ["", "C1", "c123", "ng NAME 12", "COMP:P|C12", "c", "nothing", "ab", "longer than any text of a node", "name 1"]
    n, e = spark.createDataFrame(nodes, "id string, node_type string, path string, name string"), spark.createDataFrame(edges, "src string, dst string, edge_type string")
    asked = spark.createDataFrame([(p, x) for p in ("page:p", "page:q", "page:r") for x in names], "page string, name string")
    want = {}
    for page, _, _ in {(x[0], 0, 0) for x in edges}:
        for name in names:
            for id_, _, _, called in nodes:
                if (page, id_, "Contains") in edges and (name.lower() in id_.lower() or name.lower() in called.lower()):
                    want[page, name, id_] = 100 if id_.lower() == name.lower() else 80
            if name.lower() == "ab":
                want[page, name, "model:Ab"] = 60
    plans, write = [], scope.settled
    monkeypatch.setattr(scope, "settled", lambda df: plans.append(df.columns) or write(df))
    found = scope.page_models(n, e, asked)
    assert {(r.page, r["name"], r.id): r.score for r in found.collect()} == want
    assert ["page", "name", "key"] in plans  # not every name with every node of its page
