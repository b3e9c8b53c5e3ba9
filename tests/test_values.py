"""Value traces against a plain recursion over one page."""

import random

import pytest

from graphloom.operators import values as op

EXPR = "page string, component_id string, field string, raw_expr string"
ID = "page string, id string"


def trace(values, component, expr, field, comps, sources, params, depth):
    """The expansion of one expression, its issues and its chain, by recursion."""
    issues, chain, stack = [], [], set()

    def issue(*x):
        if x not in issues:
            issues.append(x)

    def expand(name, field, text, left):
        if left == 0:
            issue("TRACE_DEPTH_LIMIT", name, text)
            return text
        if (name, field) in stack:
            issue("TRACE_CYCLE", name, text)
            return text
        stack.add((name, field))
        clean = text.removeprefix("=")
        if op.Parser(clean).run().codes:
            issue("TRACE_UNSUPPORTED_EXPRESSION", name, text)
        out, upto = "", 0
        for token, word, begin, end in op.occurrences(clean):
            put, bare = None, word[2:-1] if word.startswith("${") else word
            head, _, rest = bare.partition(".")
            if rest == "value" or (head in comps and not rest):  # a value is a component's, whether the page has it or not
                if head in values:
                    inner = expand(head, "value", values[head], left - 1)
                    if (head, values[head]) not in chain:
                        chain.append((head, values[head]))
                    put = inner.removeprefix("=")
                    if op.composite(put) and (begin, end) != (0, len(clean)):
                        put = f"({put})"
                else:
                    issue("TRACE_MISSING_VALUE", name, token)
            elif head in comps:
                issue("TRACE_PROPERTY_NOT_EXPANDED", name, token)
            elif head in sources and rest:
                put = f"({head}.{rest})"
            elif head in params and not rest:
                put = f"({head})"
            elif not word.startswith("$"):
                issue("TRACE_UNRESOLVED_REFERENCE", name, token)
            out += clean[upto:begin] + (put if put is not None else token)
            upto = end
        stack.discard((name, field))
        return "=" + out + clean[upto:]

    return expand(component, field, expr, depth), issues, chain


def page(seed, n=9):
    """Expressions of one page; component k names others, some of them in cycles."""
    rng = random.Random(seed)
    refs = lambda: rng.choice([f"c{rng.randrange(n)}.value", f"c{rng.randrange(n)}", "${c%d}" % rng.randrange(n), "model1.A", "param1", "c%d.text" % rng.randrange(n), "x.y", "$user.id", "${model1.B}", "c99.value", "gone.value"])
    forms = [lambda: f"={refs()}", lambda: f"={refs()} + {refs()}", lambda: f"=({refs()})", lambda: f"=CONCAT('c1.value', {refs()}, \"é\")", lambda: "5", lambda: f"=NOT {refs()}", lambda: f"=({refs()} - 1) * {refs()}", lambda: f"={refs()} +"]
    return {f"c{k}": rng.choice(forms)() for k in range(n) if k not in (4,)}


@pytest.mark.parametrize("depth", [10, 2])
def test_traces_equal_recursion(spark, depth):
    rows, expected = [], {}
    comps = [f"c{k}" for k in range(9)] + ["c99"]
    for seed in range(25):
        values = page(seed)
        rows += [(f"p{seed}", c, "value", x) for c, x in values.items()]
        rows.append((f"p{seed}", "c0", "visible", "=c1.value > 2"))
        for c, f, x in [(c, "value", x) for c, x in values.items()] + [("c0", "visible", "=c1.value > 2")]:
            expected[f"p{seed}", c, f] = trace(values, c, x, f, set(comps), {"model1"}, {"param1"}, depth)
    pages = [f"p{s}" for s in range(25)]
    known = lambda ids: spark.createDataFrame([(p, i) for p in pages for i in ids], ID)
    out = op.value_traces(spark.createDataFrame(rows, EXPR), known(comps), known(["model1"]), known(["param1"]), depth).collect()
    got = {(r.page, r.component_id, r.field): (r.expanded, [tuple(x) for x in r.issues], [(x.component_id, x.expr) for x in r.chain]) for r in out}
    for key, want in expected.items():
        assert got[key] == want, key
    codes = {i[0] for x in expected.values() for i in x[1]}
    assert len(out) == len(rows) and codes >= {"TRACE_CYCLE", "TRACE_MISSING_VALUE", "TRACE_PROPERTY_NOT_EXPANDED", "TRACE_UNRESOLVED_REFERENCE", "TRACE_UNSUPPORTED_EXPRESSION"} and (depth > 2 or "TRACE_DEPTH_LIMIT" in codes)


def test_known_traces(spark):
    """Cases whose results are known: levels, both branches, a property, text in quotes, a constant."""
    cases = {"input1": "=param1", "input2": "=input1.value", "input3": "=input2.value + model1.A", "st": "=input1.step", "zh": '=CONCAT("合同金额：", input1, "元")', "lit": '=CONCAT("input1", input1)', "text3": "=123", "wrap": "=input3.value * 2"}
    rows = spark.createDataFrame([("p", c, "value", x) for c, x in cases.items()], EXPR)
    known = lambda *ids: spark.createDataFrame([("p", i) for i in ids], ID)
    got = {r.component_id: r for r in op.value_traces(rows, known(*cases), known("model1"), known("param1"), 5).collect()}
    assert {c: r.expanded for c, r in got.items()} == {"input1": "=(param1)", "input2": "=(param1)", "input3": "=(param1) + (model1.A)", "st": "=input1.step", "zh": '=CONCAT("合同金额：", (param1), "元")', "lit": '=CONCAT("input1", (param1))', "text3": "=123", "wrap": "=((param1) + (model1.A)) * 2"}
    assert [tuple(x) for x in got["st"].issues] == [("TRACE_PROPERTY_NOT_EXPANDED", "st", "input1.step")]
    assert [(x.component_id, x.source_type) for x in got["input3"].chain] == [("input1", "param"), ("input2", "computed")] and got["input1"].external


def test_levels_cycles_and_values_that_are_not_there(spark):
    cases = {"a": "=b.value + 1", "b": "=c * 2", "c": "3", "x": "=y", "y": "=x + 1", "z": "plain.value"}
    known = lambda *ids: spark.createDataFrame([("p", i) for i in ids], ID)
    got = {r.component_id: r for r in op.value_traces(spark.createDataFrame([("p", c, "value", x) for c, x in cases.items()], EXPR), known(*cases), known("m"), known("n")).collect()}
    assert got["a"].expanded == "=(3 * 2) + 1" and not got["a"].issues
    assert got["x"].expanded == "=y + 1" and [i.code for i in got["x"].issues] == ["TRACE_CYCLE"]
    assert got["z"].expanded == "=plain.value" and [tuple(i) for i in got["z"].issues] == [("TRACE_MISSING_VALUE", "z", "plain.value")]


def test_traces_of_nothing(spark):
    none = spark.createDataFrame([], ID)
    assert op.value_traces(spark.createDataFrame([], EXPR), none, none, none).collect() == []
