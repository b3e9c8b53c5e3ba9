"""Conditions: what decides about showing, filtering and running, and how it is inherited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CONDITION_TYPE, EFFECT_TYPE
from . import traversal


def _lookup(values: dict[str, str], key: Column, default: str | None = None) -> Column:
    found = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]
    return F.coalesce(found, F.lit(default)) if default is not None else found


def condition_type(prop: Column) -> Column:
    return _lookup(CONDITION_TYPE, prop, "FieldExp")


def effect_type(kind: Column) -> Column:
    return _lookup(EFFECT_TYPE, kind)


# Condition types that keep something from showing or running.
BLOCKING = ("VisibleCondition", "DisableCondition", "EnableCondition", "ActionCondition", "ActionConditionExp")


def condition_class(kind: Column, expr: Column) -> Column:
    """blocking, data_empty (filters, and whatever asks for a number of rows) or supporting."""
    return F.when(kind.isin(*BLOCKING), "blocking").when(kind.contains("Filter") | F.coalesce(expr.contains("totalRowCount__"), F.lit(False)), "data_empty").otherwise("supporting")


def deduplicated(conditions: DataFrame) -> DataFrame:
    """(key columns, condition_id, n, ids, owners): conditions that say the same of one file; the smallest id stays, with the others' ids and owners."""
    refs = F.array_join(F.array_sort(F.array_distinct("referenced_symbols")), ",")
    rows = conditions.withColumn("refs", refs)
    out = rows.groupBy("page", "condition_type", "effect_type", F.col("raw_expr").alias("expr"), "refs").agg(F.min("id").alias("condition_id"), F.count("*").alias("n"), F.array_sort(F.collect_set("id")).alias("ids"), F.count_distinct("owner_id").alias("n_owners"))
    return out.withColumn("ids", F.array_join("ids", ","))


def inherited(conditions: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, condition, distance): display conditions of a component and of the components it lies in, nearest first."""
    shown = conditions.where("effect_type = 'Show'").select(F.col("id").alias("condition"), "owner_id")
    own = shown.select(F.col("owner_id").alias("id"), "condition", F.lit(0).alias("distance"))
    up = traversal.ancestors(edges)
    above = up.join(shown, F.col("ancestor") == F.col("owner_id")).select("id", "condition", "distance")
    return own.unionByName(above)


def row_count_gates(expressions: DataFrame) -> DataFrame:
    """(id, model) from (id, raw_expr): models whose number of rows a condition asks for."""
    names = F.regexp_extract_all("raw_expr", F.lit("([A-Za-z_][A-Za-z0-9_]*)\\.totalRowCount__"), 1)
    return expressions.select("id", F.explode(F.array_distinct(names)).alias("model"))


def availability(conditions: DataFrame, edges: DataFrame) -> DataFrame:
    """(model, n_blocking, n_data_empty, n_components): what can keep a model's readers from showing rows."""
    kind = condition_class(F.col("condition_type"), F.col("raw_expr"))
    rows = edges.where("edge_type = 'Reads' AND dst LIKE 'model:%'").select(F.col("src").alias("owner_id"), F.col("dst").alias("model")).join(conditions.select("owner_id", "id", kind.alias("class")), "owner_id")
    return rows.groupBy("model").agg(F.count_distinct(F.when(F.col("class") == "blocking", F.col("id"))).alias("n_blocking"), F.count_distinct(F.when(F.col("class") == "data_empty", F.col("id"))).alias("n_data_empty"), F.count_distinct("owner_id").alias("n_components"))


def index(conditions: DataFrame) -> DataFrame:
    """(owner_id, n, conditions): each owner's conditions as one sorted list."""
    return conditions.groupBy("owner_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("conditions"))


def impact(conditions: DataFrame) -> DataFrame:
    """(id, score): a point for each model and each component that a condition refers to, and 3 where it lets something run, else 2 at a component, else 1."""
    refs = lambda start: F.size(F.filter("referenced_symbols", lambda x: x.startswith(start)))
    runs = F.col("owner_id").startswith("action:") | (F.lower("effect_type") == "execute")
    part = F.when(runs, 3).when(F.col("owner_id").startswith("comp:"), 2).otherwise(1)
    return conditions.select("id", (refs("model:") + refs("comp:") + part).alias("score"))
