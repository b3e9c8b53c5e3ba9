"""Expressions, actions and dataflow filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import actions as act
from ..functions import expressions as ex
from ..model import ACTION_CATEGORY, ALWAYS_EXPRESSION, CONDITION_TYPE, EFFECT_TYPE, MAYBE_EXPRESSION
from ..operators import conditions as cond
from ..operators import dataflow, values
from ..sources import projection as p
from .registry import query

#: Templates; # stands for a key modulo 9.
_SHAPES = ["${model#.f#}", "${$user.dept#}", "${param#}", "$now#", "$user.x#", "model#.a.b", "c#.value", "c#.items.step", "c#.other", "param#", "NULL", "#abc", "input#", "${a b#}", "${tbl#}"]


def _cases(templates: list[str], key: str) -> str:
    """SQL text that picks a template by key."""

    def one(x: str) -> str:
        return "concat(" + f", {key} % 9, ".join("'" + y.replace("'", "''") + "'" for y in x.split("#")) + ")"

    return f"CASE {key} % {len(templates)} " + " ".join(f"WHEN {i} THEN {one(x)}" for i, x in enumerate(templates)) + " END"


def _pick(templates: list[str], key: str):
    """The same as a column."""
    k = (F.col(key) % 9).cast("string")
    filled = [F.concat(*[y for i, x in enumerate(t.split("#")) for y in ((k, F.lit(x)) if i else (F.lit(x),))]) for t in templates]
    return F.get(F.array(*filled), (F.col(key) % len(templates)).cast("int"))


_TOKENS = _cases(_SHAPES, "o_orderkey")


def _tokens(t):
    return t.orders.select("o_orderkey", _pick(_SHAPES, "o_orderkey").alias("token"))


@query("e02_ref_kinds", f"""SELECT o_orderkey, CASE WHEN braced AND NOT regexp_matches(inn, '^[\\p{{L}}\\p{{N}}_.$@]*$') THEN 'other' WHEN braced AND contains(inn, '.') THEN 'model_field' WHEN braced AND starts_with(inn, 'param') THEN 'param' WHEN braced THEN 'model_field' WHEN starts_with(tk, '$') AND contains(tk, '.') THEN 'user_property' WHEN starts_with(tk, '$') THEN 'system_var'
 WHEN contains(tk, '.') AND starts_with(tk, 'model') THEN 'model_field' WHEN regexp_matches(tk, '^[^.]+\\.value$') THEN 'component_value' WHEN regexp_matches(tk, '\\.(value|step)$') THEN 'component_property' WHEN contains(tk, '.') THEN 'other' WHEN starts_with(tk, 'param') THEN 'param' WHEN lower(tk) IN ('null', 'true', 'false') OR regexp_matches(tk, '^[0-9]') THEN 'other' ELSE 'component_value' END AS kind,
 CASE WHEN braced AND NOT regexp_matches(inn, '^[\\p{{L}}\\p{{N}}_.$@]*$') THEN tk WHEN braced THEN split_part(inn, '.', 1) WHEN starts_with(tk, '$') AND contains(tk, '.') THEN substr(tk, 2) WHEN starts_with(tk, '$') THEN tk WHEN contains(tk, '.') AND (starts_with(tk, 'model') OR regexp_matches(tk, '\\.(value|step)$')) THEN split_part(tk, '.', 1) ELSE tk END AS id
 FROM (SELECT o_orderkey, tk, starts_with(tk, '${{') AS braced, substr(tk, 3, length(tk) - 3) AS inn FROM (SELECT o_orderkey, CASE WHEN starts_with(token, '${{$') THEN substr(token, 3, length(token) - 3) ELSE token END AS tk FROM (SELECT o_orderkey, {_TOKENS} AS token FROM orders)))""")
def ref_kinds(t):
    return _tokens(t).select("o_orderkey", ex.ref_kind(F.col("token")).alias("r")).select("o_orderkey", "r.kind", "r.id")


@query("e06_ref_confidence", "SELECT o_orderkey, CASE WHEN k = 0 THEN 'high' WHEN k = 1 THEN 'unresolved' WHEN o_custkey % 2 = 0 THEN 'high' WHEN k = 2 AND NOT regexp_matches(id, '^(model|tbl|fact_)') THEN 'low' ELSE 'medium' END AS confidence FROM (SELECT o_orderkey, o_custkey, o_orderkey % 5 AS k, CASE o_orderkey % 3 WHEN 0 THEN 'model1' WHEN 1 THEN 'fact_x' ELSE 'zz' END AS id FROM orders)")
def ref_confidence(t):
    kind = F.get(F.array(*[F.lit(x) for x in ("user_property", "other", "model_field", "param", "component_value")]), (F.col("o_orderkey") % 5).cast("int"))
    id_ = F.get(F.array(F.lit("model1"), F.lit("fact_x"), F.lit("zz")), (F.col("o_orderkey") % 3).cast("int"))
    return t.orders.select("o_orderkey", ex.ref_confidence(kind, F.col("o_custkey") % 2 == 0, id_).alias("confidence"))


_FIELDS = ("exp", "value", "text", "visible", "caption", "name", "validExp", "badge")
_VALUES = ["=c#.value", "plain #", "a ${model#.x}", ""]


def _quoted(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


@query("e07_expression_fields", f"SELECT o_orderkey, field, value, field IN ({_quoted(ALWAYS_EXPRESSION)}) OR (field IN ({_quoted(MAYBE_EXPRESSION)}) AND (starts_with(value, '=') OR contains(value, '${{'))) AS is_expression FROM (SELECT o_orderkey, {_cases(list(_FIELDS), 'o_custkey')} AS field, {_cases(_VALUES, 'o_orderkey')} AS value FROM orders)")
def expression_fields(t):
    rows = t.orders.select("o_orderkey", _pick(list(_FIELDS), "o_custkey").alias("field"), _pick(_VALUES, "o_orderkey").alias("value"))
    return rows.withColumn("is_expression", ex.is_expression(F.col("field"), F.col("value")))


_SOURCES = ["=$user.a#", "x $project", "=param#", "param#", "=model#.a", "plain", "=c#.value", "${z#}", "a=param"]


@query("g09_source_types", f"SELECT o_orderkey, CASE WHEN contains(x, '$user') OR contains(x, '$project') THEN 'system' WHEN starts_with(x, '=param') OR (contains(x, 'param') AND NOT contains(x, '=')) THEN 'param' WHEN contains(x, 'model') THEN 'model_auto' WHEN NOT starts_with(x, '=') AND NOT starts_with(x, '${{') THEN 'constant' WHEN contains(x, '.value') OR contains(x, '.checked') THEN 'computed' ELSE 'unknown' END AS source_type FROM (SELECT o_orderkey, {_cases(_SOURCES, 'o_orderkey')} AS x FROM orders)")
def source_types(t):
    return t.orders.select("o_orderkey", _pick(_SOURCES, "o_orderkey").alias("x")).select("o_orderkey", ex.source_type(F.col("x")).alias("source_type"))


@query("g10_priority", "SELECT o_custkey, CASE WHEN d AND e AND c THEN 'ExpWithCalcConditionDefaultValueFallback' WHEN d AND e THEN 'ExpDominatesNoCalcCondition' WHEN e THEN 'OnlyExp' ELSE 'OnlyDefaultValue' END AS result FROM (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS d, bool_or(o_orderstatus = 'O') AS e, bool_or(o_orderstatus = 'P') AS c FROM orders GROUP BY 1)")
def priorities(t):
    has = t.orders.groupBy("o_custkey").agg(*[F.bool_or(F.col("o_orderstatus") == s).alias(n) for s, n in (("F", "d"), ("O", "e"), ("P", "c"))])
    return has.select("o_custkey", ex.priority(F.col("d"), F.col("e"), F.col("c")).alias("result"))


_TYPES = (*ACTION_CATEGORY, "other")


@query("e10_action_categories", f"SELECT kind, CASE {' '.join(f'''WHEN kind = '{k}' THEN '{v}' ''' for k, v in ACTION_CATEGORY.items())} ELSE 'unknown' END AS category, count(*) AS n FROM (SELECT {_cases(list(_TYPES), 'o_orderkey')} AS kind FROM orders) GROUP BY 1, 2")
def action_categories(t):
    return t.orders.select(_pick(list(_TYPES), "o_orderkey").alias("kind")).groupBy("kind", act.category(F.col("kind")).alias("category")).agg(F.count("*").alias("n"))


@query("e09_condition_types", f"SELECT prop, kind, CASE {' '.join(f'''WHEN kind = '{k}' THEN '{v}' ''' for k, v in EFFECT_TYPE.items())} END AS effect, count(*) AS n FROM (SELECT prop, CASE {' '.join(f'''WHEN prop = '{k}' THEN '{v}' ''' for k, v in CONDITION_TYPE.items())} ELSE 'FieldExp' END AS kind FROM (SELECT {_cases([*CONDITION_TYPE, 'tip'], 'o_orderkey')} AS prop FROM orders)) GROUP BY 1, 2, 3")
def condition_types(t):
    rows = t.orders.select(_pick([*CONDITION_TYPE, 'tip'], "o_orderkey").alias("prop")).withColumn("kind", cond.condition_type(F.col("prop")))
    return rows.groupBy("prop", "kind", cond.effect_type(F.col("kind")).alias("effect")).agg(F.count("*").alias("n"))


# the reference rule: ${X} alone, X of ASCII letters, digits and underscores
@query("e14_bare_symbols", f"SELECT o_orderkey, regexp_extract(token, '^\\s*\\$\\{{\\s*([A-Za-z0-9_]+)\\s*\\}}\\s*$', 1) AS symbol FROM (SELECT o_orderkey, {_TOKENS} AS token FROM orders) WHERE regexp_matches(token, '^\\s*\\$\\{{\\s*([A-Za-z0-9_]+)\\s*\\}}\\s*$')")
def bare_symbols(t):
    return _tokens(t).select("o_orderkey", ex.bare_symbol(F.col("token")).alias("symbol")).where("symbol IS NOT NULL")


_WAITS = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('button', o_custkey, '.action', o_orderkey % 4) WHEN 2 THEN concat('input', o_custkey, '.', list_value('value', 'text', 'checked', 'visible', 'values')[o_orderkey % 4 + 1]) WHEN 3 THEN 'a.b.c' ELSE concat('button', o_custkey) END"


# the reference rule: component.action, unless the second part is one of eight properties
@query("e12_wait_previous", f"SELECT o_orderkey, raw, CASE WHEN len(p) = 2 THEN p[1] END AS component_id, CASE WHEN len(p) = 2 AND NOT prop THEN p[2] END AS action_id, coalesce(len(p) = 2 AND NOT prop, false) AS resolved, CASE WHEN prop THEN 'second part looks like a component property, not an action id' END AS reason FROM (SELECT *, len(p) = 2 AND p[2] IN ('value', 'text', 'checked', 'selected', 'visible', 'disabled', 'readonly', 'hidden') AS prop FROM (SELECT *, string_split(raw, '.') AS p FROM (SELECT o_orderkey, {_WAITS} AS raw FROM orders)))")
def wait_previous(t):
    k = F.col("o_orderkey") % 5
    prop = F.get(F.array(*[F.lit(x) for x in ("value", "text", "checked", "visible", "values")]), (F.col("o_orderkey") % 4).cast("int"))
    raw = F.when(k == 1, F.concat(F.lit("button"), "o_custkey", F.lit(".action"), F.col("o_orderkey") % 4)).when(k == 2, F.concat(F.lit("input"), "o_custkey", F.lit("."), prop)).when(k == 3, "a.b.c").when(k == 4, F.concat(F.lit("button"), "o_custkey"))
    return t.orders.select("o_orderkey", act.wait_previous(raw).alias("w")).select("o_orderkey", "w.*")


_SAID = [*act.SENTENCES, "ownAction"]


def _sentence_sql() -> str:
    of = lambda form: "concat(" + ", ".join({"c": "comp", "t": "array_to_string(targets, ', ')", "a": "kind"}[x] if k % 2 else f"'{x}'" for k, x in enumerate(form.replace("}", "{").split("{")) if x) + ")"
    rows = [f"WHEN kind = '{k}' AND len(targets) = 0 THEN {of(f[1])} WHEN kind = '{k}' THEN {of(f[0])}" if len(f) == 2 else f"WHEN kind = '{k}' THEN {of(f[0])}" for k, f in act.SENTENCES.items()]
    return f"CASE {' '.join(rows)} ELSE {of(act.OTHER_SENTENCE)} END"


# the reference rule: one sentence for each action type, with its targets or saying that none is known
@query("e11_action_sentences", f"SELECT o_orderkey, {_sentence_sql()} AS sentence FROM (SELECT o_orderkey, list_value({', '.join(repr(x) for x in _SAID)})[o_orderkey % {len(_SAID)} + 1] AS kind, concat('button', o_custkey) AS comp, list_value(concat('m', o_custkey), 'n')[1:CAST(o_custkey % 3 AS INTEGER)] AS targets FROM orders)")
def action_sentences(t):
    kind = F.get(F.array(*[F.lit(x) for x in _SAID]), (F.col("o_orderkey") % len(_SAID)).cast("int"))
    targets = F.slice(F.array(F.concat(F.lit("m"), "o_custkey"), F.lit("n")), F.lit(1), (F.col("o_custkey") % 3).cast("int"))
    return t.orders.select("o_orderkey", act.sentence(kind, F.concat(F.lit("button"), "o_custkey"), targets).alias("sentence"))


_FILTERS = ["[n#].[f#] = $user.dept and [g#] > param#", "[a] = [a] or [b#] in (1)", "$param.x# = xparam1 and param#", "1 = 1"]


@query("p13_filter_refs", f"""SELECT l_orderkey, l_linenumber, array_to_string(list_distinct_ordered, ',') AS fields, vars FROM (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN [concat('n', k, '.f', k), concat('g', k)] WHEN 1 THEN ['a', concat('b', k)] ELSE [] END AS list_distinct_ordered, CASE l_orderkey % 4 WHEN 0 THEN concat('$user.dept,param', k) WHEN 2 THEN concat('$param.x', k, ',param', k) ELSE '' END AS vars FROM (SELECT *, l_orderkey % 9 AS k FROM lineitem))""")
def filter_refs(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", _pick(_FILTERS, "l_orderkey").alias("e"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(dataflow.filter_fields(F.col("e")), ",").alias("fields"), F.array_join(dataflow.filter_variables(F.col("e")), ",").alias("vars"))


@query("p12_filter_roles", """WITH n AS (SELECT l_orderkey AS model, l_linenumber AS node_id, CASE l_linenumber WHEN 1 THEN 'ModelTable' WHEN 2 THEN 'Select' WHEN 3 THEN 'Union' WHEN 4 THEN 'Join' ELSE 'Output' END AS type FROM lineitem GROUP BY ALL),
 up AS (SELECT DISTINCT a.model, a.node_id FROM n a JOIN n b ON b.model = a.model AND b.node_id = a.node_id + 1 AND b.type = 'Output') SELECT n.model, n.node_id, CASE WHEN type = 'ModelTable' THEN 'source_filter' WHEN type = 'Output' THEN 'output_filter' WHEN type = 'Union' THEN 'branch_filter' WHEN up.model IS NOT NULL THEN 'output_filter' ELSE 'node_filter' END AS role FROM n LEFT JOIN up ON up.model = n.model AND up.node_id = n.node_id""")
def filter_roles(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("model"), F.col("l_linenumber").alias("node_id")).distinct()
    kind = F.when(F.col("node_id") == 1, "ModelTable").when(F.col("node_id") == 2, "Select").when(F.col("node_id") == 3, "Union").when(F.col("node_id") == 4, "Join").otherwise("Output")
    return dataflow.filter_roles(rows.withColumn("type", kind), rows.select("model", "node_id", (F.col("node_id") - 1).alias("input_node_id")))


_EXPRESSIONS = ["=c#.value + model#.qty", "=if(param# > 3, 'x', $user.name)", "=foo(a#, \"b\")", "= - a#", "=(c#.value", "=${model#.a} && not b#", "plain# text"]
_REFS_EXPECTED = ["c#.value,model#.qty", "param#,$user.name", "a#", "", "c#.value", "${model#.a},b#", "plain#"]
_CODES_EXPECTED = ["", "", "EXPR_UNSUPPORTED_FUNCTION", "EXPR_PARSE_ERROR", "EXPR_PARSE_ERROR", "", "EXPR_TRAILING"]


@query("e01_parse", f"SELECT o_orderkey, {_cases(_REFS_EXPECTED, 'o_orderkey')} AS refs, {_cases(_CODES_EXPECTED, 'o_orderkey')} AS codes FROM orders")
def parse(t):
    rows = ex.parse(t.orders.select("o_orderkey", _pick(_EXPRESSIONS, "o_orderkey").alias("raw_expr")))
    return rows.select("o_orderkey", F.array_join(F.transform("refs", lambda r: r["token"]), ",").alias("refs"), F.array_join("codes", ",").alias("codes"))


@query("e08_condition_refs", p.sql("SELECT id, 0 AS occurrence, 'component_value' AS kind, regexp_extract(raw_expr, '=(c[0-9]+)', 1) AS ref, 'value' AS member FROM conditions"))
def condition_refs(t):
    return ex.references(ex.parse(p.conditions(t).select(F.col("id").alias("cond"), "raw_expr")), ["cond"]).select(F.col("cond").alias("id"), "occurrence", "kind", F.col("id").alias("ref"), "member")


@query("g32_row_count_gates", "SELECT DISTINCT o_orderkey AS id, concat('model', o_orderkey % 3) AS model FROM orders UNION SELECT o_orderkey, concat('m_', o_custkey % 2) FROM orders")
def row_count_gates(t):
    return cond.row_count_gates(t.orders.selectExpr("o_orderkey AS id", "concat('=model', o_orderkey % 3, '.totalRowCount__ > 0 and m_', o_custkey % 2, '.totalRowCount__ = model', o_orderkey % 3, '.totalRowCount__') AS raw_expr"))


# a component adds to the value of the one that it refers to, subtracts a parameter from it, or multiplies a field by it
_TRACES = """form AS (SELECT page, component, ref, CAST(substr(component, 2) AS BIGINT) % 3 AS k FROM refs),
exprs AS (SELECT page, component, ref, CASE k WHEN 0 THEN concat(ref, '.value + 1') WHEN 1 THEN concat('(', ref, ') - param1') ELSE concat('model1.A * ', ref, '.value') END AS clean, CASE k WHEN 0 THEN '(' WHEN 1 THEN '((' ELSE '(model1.A) * (' END AS pre, CASE k WHEN 0 THEN ') + 1' WHEN 1 THEN ')) - (param1)' ELSE ')' END AS suf FROM form),
walk AS (SELECT page, component AS start, ref AS here, pre, suf, [component] AS seen FROM exprs UNION ALL SELECT w.page, w.start, e.ref, concat(w.pre, e.pre), concat(e.suf, w.suf), list_append(w.seen, w.here) FROM walk w JOIN exprs e ON e.page = w.page AND e.component = w.here WHERE len(w.seen) < 10 AND NOT list_contains(w.seen, w.here))"""


@query("g08_value_traces", p.sql("""SELECT w.page, w.start AS component_id, concat('=', w.pre, e.clean, w.suf) AS expanded, CASE WHEN len(w.seen) = 10 THEN 'TRACE_DEPTH_LIMIT' ELSE 'TRACE_CYCLE' END AS code, w.here AS stopped_at, concat('=', e.clean) AS token, len(list_distinct(list_append(w.seen[2:], w.here))) AS n_chain FROM walk w JOIN exprs e ON e.page = w.page AND e.component = w.here WHERE len(w.seen) = 10 OR list_contains(w.seen, w.here)""", _TRACES))
def value_traces(t):
    refs = p.component_refs(t)
    k = F.substring("component", 2, 20).cast("long") % 3
    raw = F.when(k == 0, F.concat("ref", F.lit(".value + 1"))).when(k == 1, F.concat(F.lit("("), "ref", F.lit(") - param1"))).otherwise(F.concat(F.lit("model1.A * "), "ref", F.lit(".value")))
    exprs = refs.select("page", F.col("component").alias("component_id"), F.lit("value").alias("field"), F.concat(F.lit("="), raw).alias("raw_expr"))
    page = exprs.select("page").distinct()
    out = values.value_traces(exprs, exprs.select("page", F.col("component_id").alias("id")), page.withColumn("id", F.lit("model1")), page.withColumn("id", F.lit("param1")))
    return out.select("page", "component_id", "expanded", F.col("issues")[0]["code"].alias("code"), F.col("issues")[0]["component_id"].alias("stopped_at"), F.col("issues")[0]["token"].alias("token"), F.size("chain").cast("long").alias("n_chain"))
