"""Causal paths against a search that follows one path at a time."""

import random

import pytest

from graphloom.model import CAUSAL_EDGES
from graphloom.operators import paths as op
from graphloom.operators import ranking

NODE = "id string, node_type string, path string, name string"
EDGE = "src string, dst string, edge_type string, field_path string, meta string"
TYPES = {"page": "Page", "comp": "Component", "action": "Action", "model": "Model", "field": "Field", "cond": "Condition"}


def graph(seed, pages=3, size=4):
    """Pages with components, actions and conditions over shared models and fields."""
    rng = random.Random(seed)
    nodes, edges = [], []

    def node(id_, path):
        nodes.append((id_, TYPES[id_.split(":")[0]], path, id_.split("|")[-1]))

    models = [f"model:m{k}" for k in range(4)]
    fields = [f"field:m{k}.{f}" for k in range(4) for f in ("a", "phoneNumber")]
    for x in models + fields:
        node(x, f"data/{x.split(':')[1].split('.')[0]}.tbl")
    for f in fields:
        edges.append((f"model:{f.split(':')[1].split('.')[0]}", f, "Contains", None, None))
        if rng.random() < 0.5:
            edges.append((f, rng.choice(fields), "FieldAlias", rng.choice(["x.tbl.a", "a"]), None))
    for p in range(pages):
        path = f"app/p{p}.spg"
        node(f"page:{path}", path)
        for k in range(size):
            comp = f"comp:{path}|c{k}"
            node(comp, path)
            edges.append((f"page:{path}", comp, "Contains", None, None))
            for _ in range(rng.randrange(3)):
                target = rng.choice(models + fields)
                meta = rng.choice([None, '{"json_path": "canvas.x"}', '{"source_expr": "%s"}' % target.split(":")[1]])
                edges.append((comp, target, rng.choice(["Reads", "Reads", "Writes"]), rng.choice([None, "fact_x.a", "a"]), meta))
            if rng.random() < 0.6:
                action = f"action:{path}|c{k}|t"
                node(action, path)
                edges.append((comp, action, "Triggers", None, None))
                edges.append((action, rng.choice(models + fields), rng.choice(["ActionWrites", "ActionReads", "FieldWrite", "ActionLoadsData"]), rng.choice([None, "phoneNumber"]), None))
            if rng.random() < 0.5:
                edges.append((comp, f"comp:{path}|c{rng.randrange(size)}", rng.choice(["Contains", "DependsOn"]), None, None))
            if rng.random() < 0.6:
                cond = f"cond:{path}|c{k}#v#"
                node(cond, path)
                edges.append((cond, rng.choice([comp, rng.choice(models)]), "DependsOn", None, None))
                edges.append((comp, cond, "DependsOn", None, None))
    edges = [e for e in edges if e[0] != e[1] or rng.random() < 0.3]
    return nodes, edges + [edges[0]]


def meta_of(e, key):
    import json

    return json.loads(e[4]).get(key) if e[4] else None


def anchors_of(nodes, edges):
    path = {i: p for i, _, p, _ in nodes}
    kind = {i: t for i, t, _, _ in nodes}
    out = set()
    for page in [i for i, t, _, _ in nodes if t == "Page"]:
        own = {d for s, d, t, _, _ in edges if t == "Contains" and s == page}
        own |= {d for s, d, t, _, _ in edges if t == "Triggers" and s in own}
        ranks, data = {}, set()
        for e in edges:
            s, d, t, fp, _ = e
            if s not in own:
                continue
            rank = 0 if t in op.SOURCE_EDGES else 1 if t in op.SINK_EDGES else 2 if t == "Triggers" else None
            if rank is None:
                continue
            if kind[s] == "Component":
                ranks[s] = min(rank, ranks.get(s, 9))
            if rank == 0:
                out.add((page, "source", d, None))
                data |= {d} if d.startswith(("model:", "field:")) else set()
                expr = meta_of(e, "source_expr")
                if expr and 0 < expr.find(".") < len(expr) - 1 and not expr.startswith("$"):
                    out.add((page, "source", "field:" + expr, None))
            if rank == 1:
                out.add((page, "sink", d, None))
                if fp and "." in fp:
                    out.add((page, "sink", fp, None))
        out |= {(page, "target", i, r) for i, r in ranks.items()}
        for s, d, t, _, _ in edges:
            if d in data and path[s] != path[page]:
                if t in op.WRITER_EDGES:
                    out.add((page, "bridge", s, None))
                if t == "DependsOn" and s.startswith("cond:"):
                    out.add((page, "excluded", s, None))
    return out


def brute(nodes, edges, depth, most):
    """page -> list of (rank, anchor, nodes, steps) in order."""
    path, kind = {i: p for i, _, p, _ in nodes}, {i: t for i, t, _, _ in nodes}
    roles = {}
    for page, anchor, i, rank in anchors_of(nodes, edges):
        roles.setdefault(page, {}).setdefault(i, {})[anchor] = rank
    after = {}
    for e in edges:
        s, d, t, fp, _ = e
        if t in CAUSAL_EDGES and s in path and d in path:
            after.setdefault(s, {}).setdefault(d, []).append((t, False, fp or "", meta_of(e, "json_path") or "", fp, meta_of(e, "json_path")))
            if t in op.WRITER_EDGES and d.startswith(("model:", "field:")):
                after.setdefault(d, {}).setdefault(s, []).append((t, True, fp or "", meta_of(e, "json_path") or "", fp, meta_of(e, "json_path")))
    out = {}
    for page, of in roles.items():
        rows = []
        for start in [i for i, r in of.items() if "target" in r]:
            every, todo = {}, [([start], [])]
            while todo:
                at, steps = todo.pop()
                for d, options in after.get(at[-1], {}).items():
                    usable = [o for o in options if d not in at or o[0] == ("FieldWrite" if o[1] else "FieldAlias")]
                    if not usable:
                        continue
                    best = min(usable)
                    new = (at + [d], steps + [(best[0], best[1], best[4], best[5], at[-1], d)])
                    if len(new[1]) >= 2 or set(of.get(d, {})) & {"target", "source", "sink", "bridge"}:
                        every[tuple(new[0])] = new[1]
                    if len(new[1]) < depth:
                        todo.append(new)
            first = sorted(every.items(), key=lambda x: (len(x[0]), x[0]))[:most]
            rows += [(of[start]["target"], start, k, v) for k, v in first]
        out[page] = sorted(rows, key=lambda r: (r[0], r[1], len(r[2]), r[2]))
    return out, roles, path, kind


def facts(page, at, steps, roles, path, kind):
    here = page[5:]
    has = lambda role: any(role in roles.get(page, {}).get(n, {}) for n in at)
    fields = [s[2] or "" for s in steps]
    f = {"target": has("target"), "read": has("source"), "write": has("sink"), "cross": has("bridge") or any(s[0] in op.WRITER_EDGES and path[s[5]] != here for s in steps)}
    f |= {"field_write": any(s[0] == "FieldWrite" for s in steps), "alias": any(s[0] == "FieldAlias" for s in steps), "cond": any(kind[n] == "Condition" for n in at)}
    f |= {"same": any(path[s[4]] == here == path[s[5]] for s in steps), "physical": any(x in y for x in op.PHYSICAL for y in fields), "phone": any("phoneNumber" in y for y in fields)}
    f |= {"filter": any(s[0] == "DependsOn" and (s[4].startswith("model:") or s[5].startswith("model:")) for s in steps), "json": any(s[3] is not None for s in steps)}
    bridge = lambda n: "bridge" in roles.get(page, {}).get(n, {})
    off = any((path[s[4]] != here or path[s[5]] != here) and not f["cross"] and not bridge(s[4]) and not bridge(s[5]) for s in steps)
    data = f["read"] or f["write"] or f["cond"] or f["physical"]
    if all(s[0] in ("Contains", "Triggers") for s in steps):
        cls = "rejected"
    elif len(steps) > 6:
        cls = "rejected"
    elif off and not f["physical"] and not f["cross"]:
        cls = "related"
    elif f["alias"] and f["field_write"] and f["cross"] and f["target"] and f["physical"]:
        cls = "primary"
    elif data and f["target"] and (f["physical"] or f["cross"]):
        cls = "primary"
    elif data and f["target"] and f["same"] and (f["read"] or f["write"]):
        cls = "primary"
    elif f["cond"] and f["same"] and (f["filter"] or f["target"]):
        cls = "supporting"
    else:
        cls = "candidate" if data else "related"
    n = len(steps)
    f["score"] = 3 * f["physical"] + 2 * f["target"] + 2 * f["cross"] + (2 if n <= 2 else 1 if n == 3 else 0) + f["filter"] + 5 * f["phone"] + 4 * f["alias"]
    f["confidence"] = "high" if f["physical"] and f["target"] else "medium" if f["read"] or f["write"] else "low"
    return f, cls


MEETS = {
    "action_write": lambda f: f["write"],
    "cross_page_writer": lambda f: f["cross"],
    "data_prerequisite": lambda f: f["filter"] or f["cond"],
    "display_gate": lambda f: f["target"] and f["cond"],
    "target_component": lambda f: f["target"],
    "value_source": lambda f: f["physical"] and (f["read"] or f["write"]),
}


def select(rows):
    """rows of one page: (anchor, nodes, facts, class) in order -> nodes: (class, promoted, order), and the guarantees not met."""
    pools = {c: [r for r in rows if r[3] == c] for c in ("primary", "candidate", "supporting", "related", "rejected")}
    met = {g: any(m(r[2]) for r in pools["primary"]) for g, m in MEETS.items()}
    promoted = {}
    for g in op.GUARANTEES:
        if met[g]:
            continue
        for pool in ("candidate", "supporting"):
            hit = next((r for r in pools[pool] if MEETS[g](r[2])), None)
            if hit:
                pools[pool].remove(hit)
                pools["primary"].append(hit)
                promoted[hit[1]] = g
                break
    pools["primary"].sort(key=lambda r: (-r[2]["score"], len(r[1])))
    out, counts, n = {}, {}, 0
    for r in pools["primary"]:
        if counts.get(r[0], 0) < 3 and n < 100:
            counts[r[0]], n = counts.get(r[0], 0) + 1, n + 1
            out[r[1]] = ("primary", promoted.get(r[1]), n)
        else:
            out[r[1]] = ("candidate", promoted.get(r[1]), None)
    for c in ("candidate", "supporting", "related", "rejected"):
        out |= {r[1]: (c, None, None) for r in pools[c]}
    return out, {g for g, x in met.items() if not x}


@pytest.mark.parametrize("seed,depth,most,size", [(1, 5, 15, 4), (2, 5, 4, 5), (3, 3, 1000, 3), (4, 2, 3, 6), (5, 5, 40, 4)])
def test_paths_equal_brute_force(spark, seed, depth, most, size):
    nodes, edges = graph(seed, size=size)
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    anchors = op.page_anchors(n, e)
    assert {tuple(r) for r in anchors.select("page", "anchor", "id", "rank").collect()} == anchors_of(nodes, edges)
    expected, roles, path, kind = brute(nodes, edges, depth, most)
    found = op.causal_paths(n, e, anchors, depth, most)
    rows = {}
    for r in found.orderBy("place").collect():
        rows.setdefault(r.page, []).append((r["rank"], r.anchor, tuple(r.nodes), [(s.edge_type, s.back, s.field_path, s.json_path, a, b) for s, a, b in zip(r.steps, r.nodes, r.nodes[1:])]))
    assert rows == {p: x for p, x in expected.items() if x}
    classed = op.classified(found)
    chosen = op.selected(classed)
    got = {(r.page, tuple(r.nodes)): r for r in chosen.collect()}
    missing = {}
    for r in op.unmet_guarantees(classed).collect():
        missing.setdefault(r.page, set()).add(r.guarantee)
    assert len(got) == sum(map(len, expected.values()))
    for page, of in expected.items():
        known = [(a, at, *facts(page, at, steps, roles, path, kind)) for _, a, at, steps in of]
        classes, unmet = select(known)
        assert missing.get(page, set()) == (unmet if of else set())
        for (_, at, f, _), (_, _, _, steps) in zip(known, of):
            r = got[page, at]
            assert (r["class"], r.promoted, r.order) == classes[at]
            assert (r.score, r.confidence, r.length, r.kinds) == (f["score"], f["confidence"], len(steps), [s[0] for s in steps])
            names = {"has_target": "target", "has_read": "read", "has_write": "write", "has_cross_writer": "cross", "has_field_write": "field_write", "has_alias": "alias", "has_condition": "cond", "same_page": "same", "has_physical": "physical", "has_filter": "filter", "has_json_path": "json"}
            assert {x: r[x] for x in names} == {x: f[y] for x, y in names.items()}
            assert r.n_files == len({path[x] for x in at})


def test_a_full_page_is_searched_no_further(spark, monkeypatch):
    nodes, edges = graph(3, pages=2, size=12)
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    whole = {(r.page, r.place, tuple(r.nodes), tuple(r.roles)) for r in op.causal_paths(n, e, op.page_anchors(n, e), 4, 4).collect()}
    asked, search = [], op._searched
    monkeypatch.setattr(op, "_searched", lambda n, e, known, starts, *a: asked.append(starts.count()) or search(n, e, known, starts, *a))
    got = {(r.page, r.place, tuple(r.nodes), tuple(r.roles)) for r in op.causal_paths(n, e, None, 4, 4, per_page=6).collect()}
    assert got == {x for x in whole if x[1] <= 6} and len(got) == 12
    anchors = op.page_anchors(n, e).where("anchor = 'target'").count()
    assert 0 < sum(asked) < anchors, (asked, anchors)
    asked.clear()
    short = [{(r.page, r.place, tuple(r.nodes)) for r in op.causal_paths(n, e, None, 1, 4, per_page=k).collect()} for k in (9, 1000)]
    assert short[0] == {x for x in short[1] if x[1] <= 9}
    assert len(asked) > 2  # the first anchors don't fill a page


def test_field_paths_name_the_writer_of_the_field(spark):
    nodes = [("page:p", "Page", "p", "p"), ("comp:p|c", "Component", "p", "c"), ("field:fact.phone", "Field", "fact.tbl", "phone"), ("field:loc.phone", "Field", "p", "phone"), ("action:q|b|w", "Action", "q", "w"), ("action:p|c|own", "Action", "p", "own"), ("action:q|b|other", "Action", "q", "other")]
    edges = [
        ("page:p", "comp:p|c", "Contains", None, None), ("comp:p|c", "model:loc", "Reads", "loc.phone", '{"source_expr": "${loc.phone}", "json_path": "x"}'),
        ("field:loc.phone", "field:fact.phone", "FieldAlias", None, None), ("action:q|b|w", "field:fact.phone", "FieldWrite", "fact.tbl.phone", None),
        ("action:p|c|own", "field:fact.phone", "FieldWrite", "phone", None), ("action:q|b|other", "field:fact.phone", "FieldWrite", "mail", None),
    ]
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    rows = op.field_paths(n, e).collect()
    assert [r.nodes for r in rows] == [["comp:p|c", "field:loc.phone", "field:fact.phone", "action:q|b|w"]]
    every = op.selected(op.classified(op.page_candidates(n, e, op.page_anchors(n, e)))).collect()
    assert [(r["class"], r.reason, r.confidence, r.order) for r in every if len(r.nodes) == 4] == [("primary", "field_chain", "high", 1)]


def test_no_anchors_no_paths(spark):
    n, e = spark.createDataFrame([("page:p", "Page", "p", "p")], NODE), spark.createDataFrame([], EDGE)
    assert op.selected(op.classified(op.page_candidates(n, e, op.page_anchors(n, e)))).collect() == []


@pytest.mark.parametrize("seed", [1, 7])
def test_anchor_counts_equal_the_anchors_counted(spark, seed):
    nodes, edges = graph(seed)
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges + edges[:5], EDGE)
    ids = {}
    for r in op.page_anchors(n, e).collect():
        ids.setdefault((r.page, r.anchor), set()).add(r.id)
    assert {"target", "source", "sink", "bridge", "excluded"} >= {a for _, a in ids} >= {"target", "source", "bridge"}
    assert {(r.page, r.anchor): (r.n, r.first_id) for r in op.anchor_counts(n, e).collect()} == {k: (len(x), min(x)) for k, x in ids.items()}


def test_pushed_ranks_equal_page_rank(spark):
    nodes, edges = graph(7)
    e = spark.createDataFrame(edges, EDGE)
    pages = [n[0] for n in nodes if n[1] == "Page"]
    seeds = [(p, p, 1.0) for p in pages] + [("both", pages[0], 3.0), ("both", "model:m1", 1.0), ("alone", "nowhere", 2.0)]
    got = {}
    for r in ranking.seed_ranks(e, spark.createDataFrame(seeds, "seed string, node string, score double"), "context", least=1e-3).collect():
        got.setdefault(r.seed, {})[r.node] = r.score
    for name in ("both", "alone"):
        own = spark.createDataFrame([(n, x) for s, n, x in seeds if s == name], "node string, score double")
        exact = {r.node: r.score for r in ranking.page_rank(e, own, "context", tolerance=1e-3).collect()}
        assert all(abs(got[name].get(n, 0) - exact.get(n, 0)) < 0.02 for n in exact | got[name])
        assert sum(got[name].values()) > 0.95
    best = ranking.bridges(e, spark.createDataFrame([(p,) for p in pages], "target string"), "context", k=4, least=1e-3).collect()
    for p in pages:
        ranked = sorted(((-round(v, 12), n) for n, v in got[p].items() if n != p))[:4]
        assert [r.id for r in sorted((r for r in best if r.target == p), key=lambda r: r.rank)] == [n for _, n in ranked]
    n = spark.createDataFrame(nodes, NODE)
    with_more = op.page_anchors(n, e, spark.createDataFrame([(r.target, r.id) for r in best], "page string, id string"))
    held = {(r.page, r.id) for r in with_more.where("anchor = 'bridge'").collect()}
    assert held >= {(r.target, r.id) for r in best} and held >= {(p, i) for p, a, i, _ in anchors_of(nodes, edges) if a == "bridge"}
