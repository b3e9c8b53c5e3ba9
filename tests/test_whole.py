"""Queries without SQL, over the whole job, against brute force on the smallest tables."""

import itertools

from graphloom.operators import ranking
from graphloom.operators import traversal as tr
from graphloom.plans import registry
from graphloom.sources import projection as p

SF = "/root/testdata/sf0.001"


def cycles_of(links):
    """Cycles of (page, component, ref) by all orders of each page's components, for small pages."""
    out = set()
    for page in {x for x, _, _ in links}:
        step = {(a, b) for x, a, b in links if x == page}
        names = sorted({a for a, _ in step})
        for n in range(1, len(names) + 1):
            for path in itertools.permutations(names, n):
                if path[0] == min(path) and all(x in step for x in zip(path, (*path[1:], path[0]))):
                    out.add((page, ">".join(path)))
    return out


def test_all_cycles_of_a_dense_page(spark):
    links = [("p", a, b) for a in "abcdef" for b in "abcdef" if (a, b) not in {("a", "b"), ("f", "c")}] + [("q", "a", "b"), ("q", "b", "c"), ("q", "c", "x"), ("r", "z", "z"), ("r", "y", "z"), ("r", "y", "z")]
    got = [tuple(r) for r in tr.all_cycles(spark.createDataFrame(links, "page string, component string, ref string")).collect()]
    assert len(got) == len(set(got)) and set(got) == cycles_of(links) and max(len(c) for _, c in got) == 11


def test_all_cycles_query(spark):
    refs = {(r.page, r.component): r.ref for r in p.component_refs(p.Tables(spark, SF)).collect()}  # one for each component
    expected = set()
    for page, start in refs:
        path = [start]
        while refs[page, path[-1]] not in path:
            path.append(refs[page, path[-1]])
        loop = path[path.index(refs[page, path[-1]]) :]
        k = loop.index(min(loop))
        expected.add((page, ">".join(loop[k:] + loop[:k])))
    got = [tuple(r) for r in registry.queries()["g07_all_cycles"](spark, SF).select("page", "cycle").collect()]
    assert sorted(got) == sorted(expected) and max(c.count(">") for _, c in got) >= 4


def test_page_rank_is_converged(spark):
    t = p.Tables(spark, SF)
    arcs = [tuple(r) for r in ranking.arcs(p.edges(t), "value_source").select("src", "dst", "p").collect()]
    pages = [r.id for r in p.nodes(t).where("node_type = 'Page'").collect()]
    seed, out = {x: 1 / len(pages) for x in pages}, {a for a, _, _ in arcs}
    score = dict(seed)
    for _ in range(200):
        lost = sum(v for x, v in score.items() if x not in out)
        after = {x: v * (0.2 + 0.8 * lost) for x, v in seed.items()}
        for a, b, w in arcs:
            if a in score:
                after[b] = after.get(b, 0.0) + 0.8 * score[a] * w
        score = after
    got = {r.node: r.score for r in registry.queries()["g23_converged_page_rank"](spark, SF).collect()}
    assert got.keys() == {x for x, v in score.items() if v > 2.3e-16} and all(abs(got[x] - score[x]) < 2e-9 for x in got)


def test_refreshed_index_equals_a_rebuild(spark):
    import random

    rng = random.Random(11)
    nodes = {"page": [f"page:{k}" for k in range(6)], "comp": [f"comp:{k}" for k in range(12)], "action": [f"action:{k}" for k in range(8)], "model": [f"model:{k}" for k in range(8)], "field": [f"field:{k}" for k in range(8)]}
    kinds = [("page", "comp", "Contains"), ("comp", "action", "Triggers"), ("comp", "model", "Reads"), ("action", "field", "FieldWrite"), ("model", "field", "Contains"), ("field", "field", "FieldAlias"), ("model", "model", "DataflowInput")]

    def some(n):
        return {(rng.choice(nodes[a]), rng.choice(nodes[b]), kind) for a, b, kind in rng.choices(kinds, k=n)}

    frame = lambda rows: spark.createDataFrame(sorted(rows), "src string, dst string, edge_type string")
    edges, ways = some(45), []
    index = tr.settled(tr.page_index(frame(edges)))
    for _ in range(5):
        gone, new = set(rng.sample(sorted(edges), 2)), some(2)
        edges = (edges - gone) | new
        found, way = tr.refreshed_index(index, frame(edges), frame(gone | new), 0.9)
        ways.append(way)
        index = tr.settled(found)
        assert sorted(map(tuple, index.collect())) == sorted(map(tuple, tr.page_index(frame(edges)).collect()))
    assert "patched" in ways
    odd = spark.createDataFrame([("comp:1", None)], "src string, dst string")
    assert tr.refreshed_index(index, frame(edges), odd)[1] == "rebuilt"
    everything = frame({(p, "comp:1", "Contains") for p in nodes["page"]})
    assert tr.refreshed_index(index, frame(edges), everything)[1] == "rebuilt"
