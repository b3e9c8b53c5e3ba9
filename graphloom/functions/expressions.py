"""The expression language of page properties: tokens, grammar, references. Expressions are analysed, never evaluated."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ALWAYS_EXPRESSION, MAYBE_EXPRESSION

# Function names that are known, and those that only raise no diagnostic.
FUNCTIONS = ("if", "isnull", "concat", "trim", "upper", "lower", "len", "sum", "avg", "max", "min", "count", "sumif", "countif", "round", "today", "uuid", "user_ingroup")
QUIET = ("abs", "mod", "power", "sqrt")
# Binary operators from the loosest to the tightest level.
LEVELS = (("OR", "||"), ("AND", "&&"), ("=", "==", "!=", "<>", "<", "<=", ">", ">=", "IS", "IN", "BETWEEN"), ("+", "-", "&", "|"), ("*", "/", "%"))
# Words that are operators, whatever their case.
WORDS = {"and": "AND", "or": "OR", "is": "IS", "in": "IN", "between": "BETWEEN"}


def is_expression(field: Column, value: Column) -> Column:
    """Whether a property's text is an expression: some always are, others if they begin with ``=`` or hold ``${``."""
    marked = value.startswith("=") | value.contains("${")
    return field.isin(*ALWAYS_EXPRESSION) | (field.isin(*MAYBE_EXPRESSION) & marked)


def ref_kind(token: Column) -> Column:
    """What a token refers to, as (kind, id, member); a bare unknown name is a component."""
    inner = F.substring(token, F.lit(3), F.length(token) - 3)
    braced = token.startswith("${") & token.endswith("}")
    # a braced token that begins with $ is read like the same token without braces
    t = F.when(braced & inner.startswith("$"), inner).otherwise(token)
    braced = braced & ~inner.startswith("$")
    first, rest = F.substring_index(t, ".", 1), F.substring(t, F.instr(t, ".") + 1, F.length(t))
    dotted = F.instr(t, ".") > 0
    in_first, in_rest = F.substring_index(inner, ".", 1), F.substring(inner, F.instr(inner, ".") + 1, F.length(inner))
    none = F.lit(None).cast("string")
    made = lambda kind, a, b=none: F.struct(F.lit(kind).alias("kind"), a.alias("id"), b.alias("member"))
    return (
        F.when(braced & ~inner.rlike("^[\\p{L}\\p{N}_.$@]*$"), made("other", t))
        .when(braced & (F.instr(inner, ".") > 0), made("model_field", in_first, in_rest))
        .when(braced & inner.startswith("param"), made("param", inner))
        .when(braced, made("model_field", inner, F.lit("")))
        .when(t.startswith("$") & dotted, made("user_property", F.substring(t, F.lit(2), F.length(t))))
        .when(t.startswith("$"), made("system_var", t))
        .when(dotted & first.startswith("model"), made("model_field", first, rest))
        .when(dotted & (rest == "value"), made("component_value", first, F.lit("value")))
        .when(dotted & rest.rlike("(^|\\.)(value|step)$"), made("component_property", first, rest))
        .when(dotted, made("other", t))
        .when(t.startswith("param"), made("param", t))
        .when(F.lower(t).isin("null", "true", "false") | (t == "") | t.rlike("^[0-9]"), made("other", t))
        .otherwise(made("component_value", t, F.lit("bare")))
    )


def ref_confidence(kind: Column, known: Column, id_: Column) -> Column:
    """high, medium, low or unresolved; known says whether the page holds the id."""
    naming = id_.rlike("^(model|tbl|fact_)")
    return (
        F.when(kind.isin("user_property", "system_var"), "high").when(kind == "other", "unresolved").when(known, "high")
        .when((kind == "model_field") & ~naming, "low").otherwise("medium")
    )


def source_type(expr: Column) -> Column:
    """system, param, model, constant, computed or unknown, by the first rule that fits."""
    return (
        F.when(expr.contains("$user") | expr.contains("$project"), "system")
        .when(expr.startswith("=param") | (expr.contains("param") & ~expr.contains("=")), "param")
        .when(expr.contains("model"), "model_auto")
        .when(~expr.startswith("=") & ~expr.startswith("${"), "constant")
        .when(expr.contains(".value") | expr.contains(".checked"), "computed")
        .otherwise("unknown")
    )


def priority(has_default: Column, has_exp: Column, has_calc: Column) -> Column:
    """Which of a component's default value and expression decides."""
    return (
        F.when(has_default & has_exp & has_calc, "ExpWithCalcConditionDefaultValueFallback")
        .when(has_default & has_exp, "ExpDominatesNoCalcCondition")
        .when(has_exp, "OnlyExp")
        .otherwise("OnlyDefaultValue")
    )


def bare_symbol(expr: Column) -> Column:
    """X of an expression that is ``${X}`` alone, X being ASCII letters, digits and underscores; else null."""
    found = F.regexp_extract(expr, "^\\s*\\$\\{\\s*([A-Za-z0-9_]+)\\s*\\}\\s*$", 1)
    return F.when(found != "", found)


def tokens(text: str) -> tuple[list[tuple[str, str, int, int]], bool]:
    """(kind, value, begin, end) of an expression's tokens, and whether every quote and brace is closed."""
    out, at, n, closed = [], 0, len(text), True
    while at < n:
        ch, begin = text[at], at
        if ch.isspace():
            at += 1
            continue
        if ch in "'\"":
            at += 1
            value, ended = "", False
            while at < n and not ended:
                if text[at] == "\\":
                    value += text[at + 1 : at + 2]
                    at += 2
                elif text[at] == ch:
                    ended = True
                    at += 1
                else:
                    value += text[at]
                    at += 1
            closed &= ended
            out.append(("string", value, begin, min(at, n)))
        elif ch.isdigit() and ch.isascii():
            while at < n and (text[at] in "0123456789."):
                at += 1
            out.append(("number", text[begin:at], begin, at))
        elif text.startswith("${", at):
            end = text.find("}", at)
            closed &= end >= 0
            at = end + 1 if end >= 0 else n
            out.append(("name", text[begin:at], begin, at))
        elif ch.isalpha() or ch in "_$@":
            at += 1
            while at < n and (text[at].isalnum() or text[at] in "_$"):
                at += 1
            word = text[begin:at]
            low = word.lower()
            kind = "op" if low in WORDS else "not" if low == "not" else low if low in ("if", "then", "else") else "name"
            out.append((kind, WORDS.get(low, word.upper() if low in ("null", "true", "false") else word), begin, at))
        else:
            two = text[at : at + 2]
            size = 2 if two in ("==", "!=", "<=", "<>", ">=", "&&", "||") else 1
            at += size
            value = text[begin:at]
            kind = "not" if value == "!" else "op" if value in {x for y in LEVELS for x in y} else value if value in "(),." else "name"
            out.append((kind, value, begin, at))
    return out, closed


class Parser:
    """A recursive-descent reader of one expression: it keeps references (token, begin, end) and diagnostics, no tree.

    Lenient on purpose: what follows the first complete expression is reported, and a sign before an operand, commas in
    plain parentheses and a leading IF are no part of the grammar.
    """

    def __init__(self, text: str):
        self.text = text[1:] if text.startswith("=") else text
        self.shift = len(text) - len(self.text)
        self.all, closed = tokens(self.text)
        self.at, self.refs, self.codes = 0, [], [] if closed else ["EXPR_UNTERMINATED"]

    def peek(self) -> str:
        return self.all[self.at][0] if self.at < len(self.all) else "end"

    def run(self) -> Parser:
        if not self.all:
            self.codes.append("EXPR_EMPTY")
            return self
        try:
            self.level(0)
            if self.peek() != "end":
                self.codes.append("EXPR_TRAILING")
        except ValueError:
            self.codes.append("EXPR_PARSE_ERROR")
        return self

    def level(self, k: int) -> None:
        if k == len(LEVELS):
            return self.unary()
        self.level(k + 1)
        while self.peek() == "op" and self.all[self.at][1] in LEVELS[k]:
            self.at += 1
            self.level(k + 1)

    def unary(self) -> None:
        while self.peek() == "not":
            self.at += 1
        self.primary()

    def primary(self) -> None:
        kind = self.peek()
        if kind in ("string", "number"):
            self.at += 1
        elif kind == "(":
            self.at += 1
            self.level(0)
            self.expect(")")
        elif kind in ("name", "if"):
            self.name()
        else:
            raise ValueError(kind)

    def expect(self, kind: str) -> None:
        if self.peek() != kind:
            raise ValueError(kind)
        self.at += 1

    def name(self) -> None:
        _, value, begin, end = self.all[self.at]
        self.at += 1
        if self.peek() == "(":
            self.at += 1
            if value.lower() not in FUNCTIONS:
                self.codes.append("EXPR_UNSUPPORTED_FUNCTION")
            while self.peek() not in (")", "end"):
                self.level(0)
                if self.peek() == ",":
                    self.at += 1
                elif self.peek() != ")":
                    raise ValueError(self.peek())
            self.expect(")")
            return
        while self.peek() == "." and self.at + 1 < len(self.all) and self.all[self.at + 1][0] in ("name", "if", "then", "else"):
            _, part, _, end = self.all[self.at + 1]
            value += "." + part
            self.at += 2
        self.refs.append((value, begin + self.shift, end + self.shift))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("token", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [Parser(x or "").run() for x in batch.column(batch.num_columns - 1).to_pylist()]
        refs = [[{"token": t, "begin": a, "end": b} for t, a, b in p.refs] for p in found]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(refs, kind), pa.array([sorted(set(p.codes)) for p in found], pa.list_(pa.string()))], [*batch.schema.names, "refs", "codes"])


def parse(expressions: DataFrame, column: str = "raw_expr") -> DataFrame:
    """expressions with refs (token, begin, end) and diagnostic codes. The grammar is recursive, so it runs in Arrow batches, without a shuffle."""
    rows = expressions.select(*[c for c in expressions.columns if c != column], column)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", refs array<struct<token:string,begin:int,end:int>>, codes array<string>"
    return rows.mapInArrow(_parsed, schema)


def references(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row (keys, occurrence, kind, id, member) for each reference."""
    rows = parsed.select(*keys, F.posexplode("refs").alias("occurrence", "r"))
    return rows.withColumn("k", ref_kind(F.col("r.token"))).select(*keys, "occurrence", "k.kind", "k.id", "k.member")
