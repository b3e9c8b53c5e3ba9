"""Where a value comes from: expressions with the values of the components that they name put in, hop by hop."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Parser, ref_kind, source_type, tokens
from .traversal import dropped, settled

# Names by which an unknown component, or an unknown model, is still told.
COMPONENT_HEADS, MODEL_HEADS = ("input", "text", "select"), ("model", "tbl", "fact_")
MAX_DEPTH = 10


def occurrences(text: str) -> list[tuple[str, str, int, int]]:
    """(token as written, its name, begin, end) of each reference of an expression: names that are no functions, with their members."""
    found, out, at = tokens(text)[0], [], 0
    while at < len(found):
        kind, name, begin, end = found[at]
        at += 1
        if kind != "name":
            continue
        while at + 1 < len(found) and found[at][0] == "." and found[at + 1][0] == "name":
            name, end = f"{name}.{found[at + 1][1]}", found[at + 1][3]
            at += 2
        if (at < len(found) and found[at][0] == "(") or name.lower() in ("true", "false", "null"):
            continue
        out.append((text[begin:end], name, begin, end))
    return out


def composite(text: str) -> bool:
    """Whether an expression that can be read is an operation, in any number of parentheses."""
    p = Parser(text)
    try:
        p.level(0)
    except (ValueError, IndexError):
        return False
    depth, begin, found = 0, 0, p.all[: p.at]
    while len(found) >= 2 and found[0][0] == "(" and found[-1][0] == ")":
        depth = 0
        for k, x in enumerate(found):
            depth += (x[0] == "(") - (x[0] == ")")
            if depth == 0:
                break
        if k < len(found) - 1:
            break
        found = found[1:-1]
    for x in found[begin:]:
        if depth == 0 and x[0] in ("op", "not"):
            return True
        depth += (x[0] == "(") - (x[0] == ")")
    return False


_OCCURRENCE = pa.struct([("i", pa.int32()), ("token", pa.string()), ("name", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (raw_expr) with the text behind the equals sign, whether it has diagnostics, and its references."""
    for batch in batches:
        raw = batch.column(0).to_pylist()
        clean = [x.removeprefix("=") for x in raw]
        bad = [bool(Parser(x).run().codes) for x in clean]
        refs = [[{"i": i, "token": t, "name": n, "begin": a, "end": b} for i, (t, n, a, b) in enumerate(occurrences(x))] for x in clean]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(bad, pa.bool_()), pa.array(refs, pa.list_(_OCCURRENCE))], ["raw_expr", "clean", "bad", "refs"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a fragment, with whether it is an operation."""
    for batch in batches:
        flags = [composite(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], [*batch.schema.names, "composite"])


def _meant(name: Column, comp: Column, source: Column, param: Column) -> Column:
    """(kind, id, member) of a reference, by its form and by what the page has of its first part (true or null)."""
    k = ref_kind(name)
    head, rest = F.substring_index(name, ".", 1), F.substring(name, F.instr(name, ".") + 1, F.length(name))
    made = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("id"), b.alias("member"))
    none, dotted, last = F.lit(None).cast("string"), F.instr(name, ".") > 0, F.substring_index(name, ".", -1)
    starts = lambda heads: F.substring_index(name, ".", 1).rlike("^(" + "|".join(heads) + ")")
    other = (
        F.when(comp & dotted & (rest == ""), made("component_value", head, F.lit("bare")))
        .when(comp & dotted, made("component_property", head, rest))
        .when(source & dotted, made("model_field", head, rest))
        .when(param & dotted, made("param", name, none))
        .when(dotted & (last == "value") & starts(COMPONENT_HEADS), made("component_value", head, F.lit("value")))
        .when(dotted & starts(MODEL_HEADS), made("model_field", head, rest))
        .when(comp, made("component_value", head, F.lit("bare")))
        .when(param, made("param", name, none))
        .otherwise(k)
    )
    return (
        F.when(k["kind"] == "other", other)
        .when((k["kind"] == "model_field") & comp, F.when(k["member"] == "", made("component_value", k["id"], F.lit("bare"))).otherwise(made("component_property", k["id"], k["member"])))
        .when((k["kind"] == "model_field") & (k["member"] == "") & param, made("param", k["id"], none))
        .otherwise(k)
    )


def _read_on_page(expressions: DataFrame, known: dict[str, DataFrame], values: DataFrame) -> DataFrame:
    """(page, raw_expr, clean, bad, refs) for each text of a page; refs say what is put in (put), or which component's value (target, value), or the issue."""
    texts = expressions.select("raw_expr").distinct().mapInArrow(_read, "raw_expr string, clean string, bad boolean, refs array<struct<i:int,token:string,name:string,begin:int,end:int>>")
    rows = settled(expressions.select("page", "raw_expr").distinct().join(texts, "raw_expr"))
    each = rows.select("page", "raw_expr", F.explode("refs").alias("r")).select("page", "raw_expr", "r.*")
    inner = F.regexp_replace(F.regexp_replace("name", "^\\$\\{", ""), "\\}$", "")
    each = each.withColumn("head", F.substring_index(F.when(F.startswith("name", F.lit("${")), inner).otherwise(F.col("name")), ".", 1))
    for name, df in known.items():
        each = each.join(df.select(F.col("page").alias("p"), F.col("id").alias("h"), F.lit(True).alias(name)).distinct(), (F.col("page") == F.col("p")) & (F.col("head") == F.col("h")), "left").drop("p", "h")
    no = lambda c: F.coalesce(c, F.lit(False))
    each = each.withColumn("m", _meant(F.col("name"), no(F.col("comp")), no(F.col("source")), no(F.col("param"))))
    value = ((F.col("m.kind") == "component_value") & F.col("m.member").isin("value", "bare")) | ((F.col("m.kind") == "component_property") & (F.col("m.member") == "value"))
    put = F.when(F.col("m.kind") == "model_field", F.concat(F.lit("("), "m.id", F.lit("."), "m.member", F.lit(")"))).when(F.col("m.kind") == "param", F.concat(F.lit("("), "m.id", F.lit(")")))
    issue = F.when(value, None).when(F.col("m.kind") == "other", "TRACE_UNRESOLVED_REFERENCE").when(F.col("m.kind").isin("component_property", "component_value"), "TRACE_PROPERTY_NOT_EXPANDED")
    each = each.withColumns({"target": F.when(value, F.col("m.id")), "put": put, "issue": issue}).join(values, ["page", "target"], "left")
    made = each.select("page", "raw_expr", F.struct("i", "token", "begin", "end", "target", "put", "issue", "value").alias("r"))
    refs = made.groupBy("page", "raw_expr").agg(F.array_sort(F.collect_list("r")).alias("refs"))
    return rows.drop("refs").join(refs, ["page", "raw_expr"], "left")


def value_traces(expressions: DataFrame, components: DataFrame, sources: DataFrame, params: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(page, component_id, field, expanded, issues, chain, source_type, external) for each expression (page, component_id, field, raw_expr).

    expanded has, for each reference to a component's value, that component's value expression expanded in the same way,
    in parentheses if it is an operation and not alone; model fields and parameters stand in parentheses. What is not
    expanded stays as written and is an issue (code, component_id, token), in reading order, each once: at the depth's
    end, where a component's value needs itself, unreadable text, a component without a value, a property, an unknown
    name. chain lists the component values put in, what they need first. components, sources and params (page, id) are
    what the page has. A component with several values has the first one by text; texts grow with what they name.
    """
    known = {"comp": components, "source": sources, "param": params}
    # a reference has its component's value with it, so that no level looks it up again
    values = expressions.where("field = 'value'").groupBy("page", F.col("component_id").alias("target")).agg(F.min("raw_expr").alias("value"))
    read = settled(_read_on_page(expressions, known, values))
    root = F.struct("component_id", "field").alias("root")
    at = settled(expressions.select("page", root, F.expr("cast(array() as array<int>)").alias("path"), "component_id", "raw_expr", F.array(F.concat_ws("\n", "component_id", "field")).alias("stack"), F.lit("ok").alias("state")).distinct())
    levels = []
    while not at.isEmpty():
        left = depth - len(levels)
        here = at.withColumn("state", F.when(F.lit(left == 0), "TRACE_DEPTH_LIMIT").otherwise(F.col("state")))
        here = settled(here.join(read, ["page", "raw_expr"]))
        levels.append(here)
        step = here.where("state = 'ok'").select("page", "root", "path", "stack", F.explode("refs").alias("r")).where("r.value IS NOT NULL").select("page", "root", "path", "stack", "r.i", "r.target", "r.value")
        key = F.concat_ws("\n", "target", F.lit("value"))
        at = settled(step.select("page", "root", F.concat("path", F.array("i")).alias("path"), F.col("target").alias("component_id"), F.col("value").alias("raw_expr"), F.concat("stack", F.array(key)).alias("stack"), F.when(F.array_contains("stack", key), "TRACE_CYCLE").otherwise("ok").alias("state")))
    below = None
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k]
        if below is None:
            here = here.withColumn("put", F.expr("cast(map() as map<int, struct<text:string,composite:boolean>>)"))
        else:
            parts = below.select("page", "root", F.slice("path", 1, k).alias("path"), F.struct(F.element_at("path", -1).alias("i"), F.struct("text", "composite").alias("x")).alias("e"))
            maps = parts.groupBy("page", "root", "path").agg(F.map_from_entries(F.collect_list("e")).alias("put"))
            here = here.join(maps, ["page", "root", "path"], "left").withColumn("put", F.coalesce("put", F.expr("cast(map() as map<int, struct<text:string,composite:boolean>>)")))
        alone = lambda r: (r["begin"] == 0) & (r["end"] == F.length("clean"))
        own = lambda r: F.try_element_at("put", r["i"])
        inside = lambda r: F.when(own(r)["composite"] & ~alone(r), F.concat(F.lit("("), own(r)["text"], F.lit(")"))).otherwise(own(r)["text"])
        piece = lambda r: F.coalesce(inside(r), r["put"], r["token"])
        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("upto"))
        joined = F.aggregate(F.coalesce("refs", F.expr("cast(array() as array<struct<i:int,token:string,begin:int,end:int,target:string,put:string,issue:string,value:string>>)")), start, lambda a, r: F.struct(F.concat(a["text"], F.substring("clean", a["upto"] + 1, r["begin"] - a["upto"]), piece(r)).alias("text"), r["end"].alias("upto")), lambda a: F.concat(a["text"], F.substring("clean", a["upto"] + 1, F.length("clean"))))
        text = F.when(F.col("state") == "ok", joined).otherwise(F.col("clean"))
        done = here.select("page", "root", "path", text.alias("text"))
        schema = ", ".join(f"`{n}` {t}" for n, t in done.dtypes) + ", composite boolean"
        below = settled(done.mapInArrow(_marked, schema))
    if below is None:
        below = at.select("page", "root", "path", F.col("raw_expr").alias("text"), F.lit(False).alias("composite"))
    told, chain = None, None
    for k, here in enumerate(levels):
        entry = F.array_compact(F.array(F.when(F.col("state") != "ok", F.struct(F.concat("path", F.array(F.lit(-1))).alias("at"), F.col("state").alias("code"), "component_id", F.col("raw_expr").alias("token"))), F.when((F.col("state") == "ok") & F.col("bad"), F.struct(F.concat("path", F.array(F.lit(-1))).alias("at"), F.lit("TRACE_UNSUPPORTED_EXPRESSION").alias("code"), "component_id", F.col("raw_expr").alias("token")))))
        one = here.select("page", "root", F.explode(entry).alias("x")).select("page", "root", "x.*")
        refs = here.where("state = 'ok'").select("page", "root", "path", "component_id", F.explode("refs").alias("r"))
        code = F.coalesce(F.col("r.issue"), F.when(F.col("r.target").isNotNull() & F.col("r.value").isNull(), "TRACE_MISSING_VALUE"))
        two = refs.select("page", "root", F.concat("path", F.array("r.i")).alias("at"), code.alias("code"), "component_id", F.col("r.token").alias("token")).where("code IS NOT NULL")
        both = one.unionByName(two)
        told = both if told is None else told.unionByName(both)
        if k:
            last = F.concat("path", F.array(F.lit(1 << 30)))
            used = here.select("page", "root", last.alias("at"), "component_id", F.col("raw_expr").alias("expr"))
            chain = used if chain is None else chain.unionByName(used)
    out = below.join(expressions.select("page", F.struct("component_id", "field").alias("root"), "raw_expr").distinct(), ["page", "root"])
    if told is not None:
        first = told.groupBy("page", "root", "code", "component_id", "token").agg(F.min("at").alias("at"))
        issues = first.groupBy("page", "root").agg(F.array_sort(F.collect_list(F.struct("at", "code", "component_id", "token"))).alias("x"))
        out = out.join(issues.select("page", "root", F.transform("x", lambda i: F.struct(i["code"].alias("code"), i["component_id"].alias("component_id"), i["token"].alias("token"))).alias("issues")), ["page", "root"], "left")
    else:
        out = out.withColumn("issues", F.lit(None).cast("array<struct<code:string,component_id:string,token:string>>"))
    if chain is not None:
        first = chain.groupBy("page", "root", "component_id", "expr").agg(F.min("at").alias("at"))
        used = first.groupBy("page", "root").agg(F.array_sort(F.collect_list(F.struct("at", "component_id", "expr", source_type(F.col("expr")).alias("source_type")))).alias("x"))
        out = out.join(used.select("page", "root", F.transform("x", lambda i: F.struct(i["component_id"].alias("component_id"), i["expr"].alias("expr"), i["source_type"].alias("source_type"))).alias("chain")), ["page", "root"], "left")
    else:
        out = out.withColumn("chain", F.lit(None).cast("array<struct<component_id:string,expr:string,source_type:string>>"))
    stops = levels[0].select("page", "root", F.col("state").alias("s")) if levels else None
    if stops is not None:
        out = out.join(stops, ["page", "root"])
        expanded = F.when(F.col("s") == "ok", F.concat(F.lit("="), "text")).otherwise(F.col("raw_expr"))
    else:
        expanded = F.col("raw_expr")
    kind = source_type(F.col("raw_expr"))
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.select("page", "root.component_id", "root.field", expanded.alias("expanded"), empty("issues").alias("issues"), empty("chain").alias("chain"), kind.alias("source_type"), kind.isin("param", "user_input", "system").alias("external"))
