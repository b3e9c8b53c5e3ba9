"""What a query shuffles or keeps must not grow faster than its input: read off plans, with joins by broadcast turned off."""

from contextlib import contextmanager

import pytest

from graphloom.operators import paths, ranking, rules, traversal
from graphloom.operators.traversal import few, settled
from graphloom.plans import registry
from graphloom.sources import projection as p

SF = "/root/testdata/sf0.001"


@contextmanager
def _merged(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["ActionReads", "ActionWrites", "ActionLoadsData", "FieldWrite"])
def test_action_edges_are_distinct_without_a_shuffle_of_ids(spark, kind):
    with _merged(spark):
        plan = _plan(p.edges(p.Tables(spark, SF)).where(f"edge_type = '{kind}'"))
    # orders and customers meet by customer, lines and orders by order; nothing after that
    assert plan.count("Exchange hashpartitioning") == 4
    assert "hashpartitioning(src" not in plan


def test_edges_of_another_family_read_no_lines(spark):
    plan = _plan(p.edges(p.Tables(spark, SF)).where("edge_type = 'Contains'"))
    assert "lineitem" not in plan and "l_partkey" not in plan


def test_few_rows_do_not_shuffle_the_other_side(spark):
    with _merged(spark):
        ids = settled(spark.createDataFrame([("a",), ("b",)], "id string"))
        plan = _plan(spark.range(1000).selectExpr("cast(id as string) AS id").join(few(ids), "id", "left_semi"))
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan


def test_first_steps_of_a_node_lead_to_nodes_alone(spark):
    nodes = spark.createDataFrame([(x, "Component", "p") for x in ("a", "c", "d", "e")], "id string, node_type string, path string")
    edges = spark.createDataFrame([("a", x, "Contains", None) for x in ("b", "c", "c", "d", "e")], "src string, dst string, edge_type string, field_path string")
    starts = settled(spark.createDataFrame([("a",)], "id string"))
    # b is no node and takes no place, c counts once
    assert sorted(r.dst for r in paths.causal_steps(nodes, edges, starts, 2).collect()) == ["c", "d"]
    assert sorted(r.dst for r in paths.causal_steps(nodes, edges, starts).collect()) == ["c", "d", "e"]


def test_multiset_difference_groups_once_and_tells_both_sides(spark):
    a = spark.createDataFrame([("x",)] * 3 + [("y",)] + [(None,)] * 2, "k string")
    b = spark.createDataFrame([("x",)] + [("y",)] + [("z",)] * 2, "k string")
    found = rules.multiset_difference(a, b)
    assert _plan(found).count("Exchange hashpartitioning") == 1
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [("x", "left")] * 2 + [(None, "left")] * 2 + [("z", "right")] * 2))
    many = rules.multiset_difference(spark.range(25_003).selectExpr("'x' AS k"), b.where("k = 'z'"))
    assert {r.side: r["count"] for r in many.groupBy("side").count().collect()} == {"left": 25_003, "right": 2}


@pytest.mark.parametrize("query", ["g35_page_logic", "j07_model_query"])
def test_no_row_is_repeated_to_be_counted(spark, query):
    assert "Expand" not in _plan(registry.queries()[query](spark, SF))


@pytest.mark.parametrize("query", ["j01_neighbours", "j17_existing_edges"])
def test_edges_are_made_once(spark, query):
    assert "lineitem" not in _plan(registry.queries()[query](spark, SF))


def test_late_hops_do_not_shuffle_what_is_known(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(traversal, "settled", lambda df: (seen.append(_plan(df)), settled(df))[1])
    seeds = spark.createDataFrame([("t", "n0")], "target string, node string")
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(4)] + [("n4", "n1"), ("n0", "n3")], "src string, dst string")
    with _merged(spark):
        found = traversal.closure(seeds, links)
    assert sorted((r.node, r.depth) for r in found.collect()) == [("n0", 0), ("n1", 1), ("n2", 2), ("n3", 1), ("n4", 2)]
    assert any("LeftAnti" in x and "BroadcastHashJoin" in x for x in seen)


def test_page_rank_converges_in_few_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", "Reads"), ("b", "c", "Contains"), ("c", "d", "DataflowInput"), ("d", "a", "Reads"), ("c", "e", "FieldAlias")], "src string, dst string, edge_type string")
    seeds = spark.createDataFrame([("a", 3.0), ("lone", 1.0)], "node string, score double")  # lone has no arcs and flows back
    written = []
    monkeypatch.setattr(ranking, "settled", lambda df: (written.append(1), settled(df))[1])
    got = {r.node: r.score for r in ranking.page_rank(edges, seeds, "value_source").collect()}
    assert len(written) < 60  # plain steps need about a hundred rounds
    arcs, start = ranking.arcs(edges, "value_source").collect(), {"a": 0.75, "lone": 0.25}
    rank = dict(start)
    for _ in range(200):
        lost = sum(v for k, v in rank.items() if k not in {r.src for r in arcs})
        step = {k: v * (0.2 + 0.8 * lost) for k, v in start.items()}
        for r in arcs:
            step[r.dst] = step.get(r.dst, 0.0) + 0.8 * rank.get(r.src, 0.0) * r.p
        rank = step
    assert got.keys() == rank.keys()
    assert max(abs(got[k] - rank[k]) for k in rank) < 1e-9


def test_field_trace_deals_its_records_by_their_number(spark, monkeypatch):
    from graphloom.operators import dataflow

    monkeypatch.setattr(traversal, "SHARE", 2)
    written = []
    monkeypatch.setattr(dataflow, "settled", lambda df: written.append(df.rdd.getNumPartitions()) or settled(df))
    rows = [("m", f"n{k}", "f", f"db{k}", "f" if k > 1 else None, f"n{k - 1}" if k > 1 else None) for k in range(1, 21)]
    fields = spark.createDataFrame(rows, "model string, node string, name string, dbfield string, original_field string, original_node string")
    got = dataflow.field_trace(fields, spark.createDataFrame([("m", "n20", "db20")], "model string, node string, field string")).collect()
    assert [(r.path, r.stop) for r in got] == [("<".join(["n20.db20", *[f"n{k}.f" for k in range(19, 0, -1)]]), "origin")]
    assert max(written) == 20  # 40 records, though a shuffle has 4 parts by default


def test_field_lineage_writes_models_and_fields_alone(spark, monkeypatch):
    from graphloom.plans import traversals

    written = []
    monkeypatch.setattr(traversals, "settled", lambda df: written.append(settled(df)) or written[-1])
    at = "/root/testdata/sf0.001"
    assert registry.queries()["g15_field_lineage"](spark, at).count() > 0
    assert len(written) == 1 and written[0].count() == 3 * spark.read.parquet(f"{at}/part.parquet").count()


def test_requests_of_page_models_are_made_once(spark):
    from pyspark.sql import functions as F

    from graphloom.operators import scope

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(x):
        seen.add(1)
        return x

    nodes = spark.createDataFrame([("page:p", "Page", "p"), ("comp:a", "Component", "p"), ("model:m", "Model", "m.tbl"), ("model:n", "Model", "")], "id string, node_type string, path string")
    said = '{"target_model_path": "k.tbl"}'
    edges = spark.createDataFrame([("comp:a", "model:m", "Reads", None, said), ("comp:a", "model:m", "Writes", None, None), ("comp:a", "model:n", "Reads", None, None)], "src string, dst string, edge_type string, field_path string, meta string")
    asked = spark.createDataFrame([("page:p", x) for x in ("m", "n", "o")], "page string, model string").select("page", made("model").alias("model"))
    got = {r.model: r.path for r in scope.page_scoped_models(nodes, edges, asked).collect()}
    assert got == {"m": "k.tbl", "n": None, "o": None} and seen.value == 3


def test_levels_of_value_traces_look_no_value_up(spark, monkeypatch):
    from graphloom.operators import values

    plans = []

    def spied(df):
        if "stack" in df.columns and "refs" not in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df)

    monkeypatch.setattr(values, "settled", spied)
    e = spark.createDataFrame([("p", "a", "value", "=b.value + 1"), ("p", "b", "value", "=c.value + gone.value"), ("p", "c", "value", "=2")], "page string, component_id string, field string, raw_expr string")
    comps = spark.createDataFrame([("p", x) for x in ("a", "b", "c", "gone")], "page string, id string")
    none = spark.createDataFrame([], "page string, id string")
    got = {r.component_id: (r.expanded, [i["code"] for i in r.issues]) for r in values.value_traces(e, comps, none, none).collect()}
    assert got["a"] == ("=(2 + gone.value) + 1", ["TRACE_MISSING_VALUE"]) and len(plans) == 4 and not any("Join" in x for x in plans)


def test_keywords_are_looked_up_without_an_index_of_all_texts(spark):
    from graphloom.operators import search

    names = ["Customer#000000012", "customer#000000123", "aaaaaaaaaaaa", "green mint", "x", "ÄÖÜ ärger", "o1"]
    nodes = spark.createDataFrame([(f"comp:app/n{i}.spg|S{i}2", "Component", f"app/n{i}.spg", x) for i, x in enumerate(names)] + [("model:m", "Model", None, "S12")], "id string, node_type string, path string, name string")
    words = ["customer#0000000", "CUSTOMER#000000012", "aaaaaaaaa", "a", "n1", "s12", "S1", "n3.SPG", "ärger", "0000000000", "green min", "nothing of it", "app/n", "comp:app/n2.spg|s22"]
    index = search.text_index(nodes)
    with _merged(spark):
        found = search.find(index, spark.createDataFrame([(x,) for x in words], "keyword string"), 4)
        assert "Exchange hashpartitioning(text" not in _plan(found) and "Exchange hashpartitioning(piece" not in _plan(found)
    assert index.written == []
    expected = set()
    for w in words:
        t, best = w.lower(), []
        for r in nodes.collect():
            i, n = r.id.lower(), r.name.lower()
            score = 100 if t in (i, n) else 80 if t in i or t in n else 50 if t in (r.path or "").lower() else 0
            best += [(-score, r.id, r.node_type)] * (score > 0)
        expected |= {(w, k, i, kind, -s) for k, (s, i, kind) in enumerate(sorted(best)[:4], 1)}
    assert {tuple(r) for r in found.select("keyword", "rank", "id", "node_type", "score").collect()} == expected


def test_rounds_of_page_rank_shuffle_ranks_alone(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", "Reads"), ("b", "c", "Contains"), ("c", "d", "DataflowInput")], "src string, dst string, edge_type string")
    rounds = []
    monkeypatch.setattr(ranking, "settled", lambda df: ("next" in df.columns and rounds.append((df.schema["node"].dataType.simpleString(), _plan(df))), settled(df))[1])
    with _merged(spark):
        got = ranking.page_rank(edges, spark.createDataFrame([("a", 1.0)], "node string, score double"), "value_source", iterations=3, tolerance=0.0)
    assert {r.node for r in got.collect()} == {"a", "b", "c", "d"}
    # arcs are met as they lie: below the join no exchange but that of the ranks, and the one sum's
    assert len(rounds) == 4
    for kind, plan in rounds[1:]:
        scan = next(x for x in plan.split("\n") if "InMemoryTableScan" in x)
        assert kind == "bigint" and "Exchange" not in plan.split(scan)[0].split("SortMergeJoin")[1].split("Exchange", 1)[1]


def test_context_of_neighbours_writes_edges_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(traversal, "settled", lambda df: (written.append(df.columns), settled(df))[1])
    edges = spark.createDataFrame([("a", "b", "Reads"), ("b", "a", "Reads"), ("b", "c", "Writes"), ("c", "d", "Reads")], "src string, dst string, edge_type string")
    seeds = spark.createDataFrame([("a", "a")], "target string, node string")
    got = {(r.direction, r.edge_type): (r.n, r.first_src, r.last_dst) for r in traversal.context_summary(edges, seeds, 2).collect()}
    assert got == {("downstream", "Reads"): (2, "a", "b"), ("upstream", "Reads"): (2, "a", "b"), ("downstream", "Writes"): (1, "b", "c")}
    assert [x for x in written if "src" in x] == [["src", "dst", "edge_type"]]
