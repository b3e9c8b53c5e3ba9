"""Read-only graph patterns compiled to joins.

``MATCH (p:Page)-[:Contains]->(c:Component)-[:Reads|Writes]->(m) WHERE m.name CONTAINS 'x' RETURN p.id, count(*) ORDER BY p.id LIMIT 5``
A chain of nodes and edges becomes equi-joins over the node and edge tables; Catalyst orders and prunes them. A WHERE
behind OPTIONAL MATCH belongs to the optional part: rows without a match stay, with nulls. ``UNWIND [1, 2] AS x`` and
``FOR x IN [1, 2]`` give a row for each value, before a MATCH or alone; RETURN alone gives one row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODE = r"\(\s*(\w*)\s*(?::\s*(\w+))?\s*\)"
_EDGE = r"(<?)-\[\s*(\w*)\s*(?::\s*([\w|]+))?\s*\]-(>?)"
_SHAPE = re.compile(
    r"^\s*(?:UNWIND\s+\[(?P<list>.*?)\]\s+AS\s+(?P<var>\w+)\s+|FOR\s+(?P<forvar>\w+)\s+IN\s+\[(?P<forlist>.*?)\]\s+)?"
    r"(?:MATCH\s+(?P<match>.+?)(?:\s+WHERE\s+(?P<first>.+?))?)?(?:\s+OPTIONAL\s+MATCH\s+(?P<optional>.+?)(?:\s+WHERE\s+(?P<where>.+?))?)?"
    r"\s*\bRETURN\s+(?P<distinct>DISTINCT\s+)?(?P<items>.+?)(?:\s+ORDER\s+BY\s+(?P<order>.+?))?(?:\s+LIMIT\s+(?P<limit>\d+))?\s*$",
    re.I | re.S,
)
_QUOTED = re.compile(r"'((?:[^'\\]|\\.)*)'", re.S)
LONGEST = 16 * 1024


def check(query: str) -> None:
    """Refuses what is long, does not begin with a reading keyword, or loads data."""
    if len(query.encode()) > LONGEST:
        raise ValueError("the query is longer than 16 KiB")
    if not re.match(r"\s*(MATCH|OPTIONAL|UNWIND|FOR|RETURN)\b", query, re.I):
        raise ValueError("only reading queries are allowed")
    if re.search(r"\bLOAD\b", query, re.I):
        raise ValueError("LOAD is not allowed")


def _chain(text: str) -> list:
    """Nodes (name, type) and edges (name, types, reversed) in turn."""
    out, at = [], 0
    while at < len(text):
        m = re.compile(r"\s*" + (_NODE if len(out) % 2 == 0 else _EDGE)).match(text, at)
        if not m:
            if text[at:].strip():
                raise ValueError(f"can't read the pattern at: {text[at:]!r}")
            break
        if len(out) % 2 == 0:
            out.append((m[1] or f"_n{len(out)}", m[2]))
        else:
            if bool(m[1]) == bool(m[4]):
                raise ValueError("an edge needs one direction")
            out.append((m[2] or f"_e{len(out)}", m[3].split("|") if m[3] else None, bool(m[1])))
        at = m.end()
    if len(out) % 2 == 0:
        raise ValueError("a pattern ends with a node")
    return out


def _joined(nodes: DataFrame, edges: DataFrame, chain: list) -> DataFrame:
    def node(name: str, kind: str | None) -> DataFrame:
        rows = nodes.where(F.col("node_type") == kind) if kind else nodes
        return rows.select(*[F.col(c).alias(f"{name}.{c}") for c in nodes.columns])

    q = lambda name: F.col(f"`{name}`")
    out = node(*chain[0])
    for k in range(1, len(chain), 2):
        name, kinds, back = chain[k]
        rows = edges.where(F.col("edge_type").isin(*kinds)) if kinds else edges
        rows = rows.select(*[F.col(c).alias(f"{name}.{c}") for c in edges.columns])
        here, there = ("dst", "src") if back else ("src", "dst")
        out = out.join(rows, q(f"{chain[k - 1][0]}.id") == q(f"{name}.{here}")).join(node(*chain[k + 1]), q(f"{name}.{there}") == q(f"{chain[k + 1][0]}.id"))
    return out


def _value(text: str, quoted: list[str]) -> Column:
    """A column or a literal; quoted holds the texts of the query's quotes, which stand as numbers in it."""
    text = text.strip()
    if m := re.fullmatch(r"'(\d+)'", text):
        return F.lit(quoted[int(m[1])])
    if re.fullmatch(r"-?\d+", text):
        return F.lit(int(text))
    if text.lower() in ("true", "false"):
        return F.lit(text.lower() == "true")
    if re.fullmatch(r"\w+(\.\w+)?", text):
        return F.col(f"`{text}`")
    raise ValueError(f"not a value: {text!r}")


def _condition(text: str, quoted: list[str]) -> Column:
    for word, join in ((r"\s+OR\s+", lambda a, b: a | b), (r"\s+AND\s+", lambda a, b: a & b)):
        parts = re.split(word, text, flags=re.I)
        if len(parts) > 1:
            out = _condition(parts[0], quoted)
            for x in parts[1:]:
                out = join(out, _condition(x, quoted))
            return out
    if m := re.fullmatch(r"\s*NOT\s+(.+)", text, re.I | re.S):
        return ~_condition(m[1], quoted)
    m = re.fullmatch(r"\s*(.+?)\s*(STARTS\s+WITH|ENDS\s+WITH|CONTAINS|<>|<=|>=|=|<|>)\s*(.+?)\s*", text, re.I | re.S)
    if not m:
        raise ValueError(f"can't read the condition: {text!r}")
    a, b, op = _value(m[1], quoted), _value(m[3], quoted), re.sub(r"\s+", " ", m[2].upper())
    return {"STARTS WITH": a.startswith(b), "ENDS WITH": a.endswith(b), "CONTAINS": a.contains(b), "=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def _unwound(nodes: DataFrame, text: str, var: str, quoted: list[str]) -> DataFrame:
    """A row for each value of a list; a query of 16 KiB bounds their number."""
    values = [_value(x, quoted) for x in text.split(",")] if text.strip() else []
    spark = nodes.sparkSession
    return spark.range(1).select(F.explode(F.array(*values)).alias(var)) if values else spark.createDataFrame([], f"{var} string")


def run(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """The query's rows; columns are named after what RETURN lists, dots as underscores."""
    check(query)
    quoted: list[str] = []

    def masked(m: re.Match) -> str:
        quoted.append(re.sub(r"\\(.)", r"\1", m[1]))
        return f"'{len(quoted) - 1}'"

    m = _SHAPE.match(_QUOTED.sub(masked, query))
    if not m:
        raise ValueError("can't read the query")
    var = m["var"] or m["forvar"]
    values = _unwound(nodes, m["list"] if m["var"] else m["forlist"], var, quoted) if var else None
    first = _condition(m["first"], quoted) if m["first"] else None
    if m["match"]:
        chain = _chain(m["match"])
        rows = _joined(nodes, edges, chain)
        if values is not None:
            if first is None:
                raise ValueError("a MATCH behind UNWIND needs a WHERE that names the value")
            rows = rows.join(F.broadcast(values), first)  # values of one query of 16 KiB
        elif first is not None:
            rows = rows.where(first)
    else:
        chain, rows = [], values if values is not None else nodes.sparkSession.range(1).select(F.lit(1).alias("_one"))
        if m["optional"]:
            raise ValueError("OPTIONAL MATCH needs a MATCH before it")
    if m["optional"]:
        more = _chain(m["optional"])
        known = {x[0] for x in chain[::2]}
        if more[0][0] not in known:
            raise ValueError("OPTIONAL MATCH must begin at a known node")
        extra = _joined(nodes, edges, more)
        keep = [c for c in extra.columns if not c.startswith(f"{more[0][0]}.")]
        extra = extra.select(F.col(f"`{more[0][0]}.id`").alias("__key"), *[F.col(f"`{c}`") for c in keep])
        on = F.col(f"`{more[0][0]}.id`") == F.col("__key")
        rows = rows.join(extra, on & _condition(m["where"], quoted) if m["where"] else on, "left").drop("__key")
    plain, sums, order = [], [], []
    for item in re.split(r"\s*,\s*(?![^(]*\))", m["items"]):
        body, name = (*re.split(r"\s+AS\s+", item, flags=re.I), "")[:2]
        if c := re.fullmatch(r"\s*count\(\s*(DISTINCT\s+)?(\*|\w+\.\w+|\w+)\s*\)\s*", body, re.I):
            of = c[2] if "." in c[2] or c[2] == "*" else f"{c[2]}.id"
            column = F.count("*") if of == "*" else F.count_distinct(F.col(f"`{of}`")) if c[1] else F.count(F.col(f"`{of}`"))
            sums.append(column.alias(name.strip() or "count"))
            order.append(name.strip() or "count")
        elif re.fullmatch(r"'\d+'|-?\d+", body.strip()):
            order.append(name.strip() or f"column{len(order) + 1}")
            plain.append(_value(body, quoted).alias(order[-1]))
        else:
            of = body.strip() if "." in body or body.strip() == var else f"{body.strip()}.id"
            order.append(name.strip() or of.replace(".", "_"))
            plain.append(F.col(f"`{of}`").alias(order[-1]))
    rows = rows.groupBy(*plain).agg(*sums) if sums else rows.select(*plain)
    rows = rows.select(*order)
    if m["distinct"]:
        rows = rows.distinct()
    if m["order"]:
        keys = []
        for item in m["order"].split(","):
            name, *way = item.split()
            keys.append(F.desc(name.replace(".", "_")) if way and way[0].upper() == "DESC" else F.asc(name.replace(".", "_")))
        rows = rows.orderBy(*keys)
    return rows.limit(int(m["limit"])) if m["limit"] else rows


def answer(nodes: DataFrame, edges: DataFrame, query: str, most: int = 1000) -> dict:
    """columns, the first rows, total_rows and whether rows were cut; only as many rows as asked for reach the driver."""
    found = run(nodes, edges, query)
    rows = [list(r) for r in found.limit(most + 1).collect()]
    total = len(rows) if len(rows) <= most else found.count()
    return {"columns": found.columns, "rows": rows[:most], "total_rows": total, "truncated": total > most}
