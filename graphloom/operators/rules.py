"""The write contract, merging of repeated writes, and per-file provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import ENDPOINTS, NEVER_EMITTED, NODE_PREFIX, SYMBOL_PREFIXES


def node_violations(nodes: DataFrame) -> DataFrame:
    """(id, violation): unknown types, ids whose prefix or form does not fit, missing names."""
    prefix = F.create_map(*[F.lit(x) for pair in NODE_PREFIX.items() for x in pair])[F.col("node_type")]
    symbol = F.lit(False)
    for s in SYMBOL_PREFIXES:
        symbol = symbol | ((F.col("node_type") == "Field") & F.col("id").startswith(s))
    form = F.when(F.col("node_type") == "Component", F.col("id").rlike("^comp:[^|]+\\|[^|]+$")).when(F.col("node_type") == "Action", F.col("id").rlike("^action:[^|]+\\|[^|]+\\|[^|]+$")).when((F.col("node_type") == "Field") & ~symbol, F.col("id").rlike("^field:.+\\.[^.]+$")).otherwise(True)
    found = F.filter(
        F.array(
            F.when(prefix.isNull(), "unknown_type"),
            F.when(prefix.isNotNull() & ~F.col("id").startswith(prefix) & ~symbol, "wrong_prefix"),
            F.when(prefix.isNotNull() & F.col("id").startswith(prefix) & ~form, "bad_id"),
            F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "missing_name"),
        ),
        lambda x: x.isNotNull(),
    )
    return nodes.select("id", F.explode(found).alias("violation"))


def edge_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type, violation): never-emitted or unknown types, missing ends, endpoint pairs outside the contract, field edges without a path."""
    kinds = nodes.select("id", "node_type")
    rows = edges.join(kinds.toDF("src", "src_type"), "src", "left").join(kinds.toDF("dst", "dst_type"), "dst", "left")
    allowed = [f"{k}|{a}|{b}" for k, pairs in ENDPOINTS.items() for a, b in pairs]
    found = F.filter(
        F.array(
            F.when(F.col("edge_type").isin(*NEVER_EMITTED), "never_emitted").when(~F.col("edge_type").isin(*ENDPOINTS), "unknown_type"),
            F.when(F.col("src_type").isNull() | F.col("dst_type").isNull(), "missing_end"),
            F.when(F.col("edge_type").isin(*ENDPOINTS) & F.col("src_type").isNotNull() & F.col("dst_type").isNotNull() & ~F.concat_ws("|", "edge_type", "src_type", "dst_type").isin(*allowed), "bad_endpoints"),
            F.when(F.col("edge_type").isin("FieldWrite", "FieldAlias") & F.col("field_path").isNull(), "missing_field_path"),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select("src", "dst", "edge_type", F.explode(found).alias("violation"))


def guard(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises on the first violation, before anything is written; a dry run of a batch."""
    bad = node_violations(nodes).limit(1).collect() or edge_violations(nodes, edges).limit(1).collect()
    if bad:
        raise ValueError(f"the batch breaks the contract: {bad[0].asDict()}")


def merged_nodes(writes: DataFrame) -> DataFrame:
    """One row for each id from writes (id, model_type, meta, seq): the last write wins, a missing meta keeps the older one,
    and a PhysicalTable never replaces a DataFlow or App."""
    order = F.struct((F.col("model_type") != "PhysicalTable").alias("real"), F.col("meta").isNotNull().alias("has"), "seq")
    return writes.groupBy("id").agg(F.max_by("model_type", F.struct((F.col("model_type") != "PhysicalTable").alias("r"), "seq")).alias("model_type"), F.max_by("meta", order).alias("meta"), F.max("seq").alias("seq"))


def conflicts(contributions: DataFrame) -> DataFrame:
    """(entity_id, origins): entities that several files define."""
    rows = contributions.where("kind = 'Definition'").groupBy("entity_id").agg(F.sort_array(F.collect_set("origin_file")).alias("o")).where(F.size("o") > 1)
    return rows.select("entity_id", F.array_join("o", ",").alias("origins"))


def rebuilt(contributions: DataFrame) -> DataFrame:
    """(entity_id, kind, origin_file, payload): one row for each entity; definitions go before references, then the smaller file, then the smaller payload."""
    rank = F.struct((F.col("kind") != "Definition").alias("reference"), "origin_file", "payload")
    rows = contributions.groupBy("entity_id").agg(F.min(rank).alias("r"))
    return rows.select("entity_id", F.when(F.col("r.reference"), "Placeholder").otherwise("Definition").alias("kind"), "r.origin_file", "r.payload")


def hash_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): files of (path, hash) that are added, changed or deleted."""
    both = before.toDF("path", "old").join(now.toDF("path", "new"), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def applied(state: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Rows of state by origin_file without those of removed files, and with the new rows of changed ones."""
    return state.join(removed.select("origin_file").distinct(), "origin_file", "left_anti").unionByName(added)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that a and b hold in different numbers: empty if an incremental result equals the rebuilt one.

    One grouping tells both sides: a row of a counts one, a row of b less one. What is left is repeated in blocks, so
    that no list grows with the number of copies.
    """
    counted = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1))).groupBy(*a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    left = F.abs("_n")
    rows = counted.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), left - 1, F.lit(10_000).cast("long"))))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(left - F.col("_at"), F.lit(10_000)))))
    return rows.select(*a.columns, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"))


def stale(diagnostics: DataFrame, files: DataFrame) -> DataFrame:
    """Diagnostics whose file is gone or has other content by now; both have (path, hash)."""
    return diagnostics.join(files, ["path", "hash"], "left_anti")


def diagnostic_merge(rows: DataFrame) -> DataFrame:
    """(code, n, files, sample) from (path, code, n, sample): sums, and the first sample in order of paths."""
    return rows.groupBy("code").agg(F.sum("n").alias("n"), F.count_distinct("path").alias("files"), F.min_by("sample", F.when(F.col("sample") != "", F.col("path"))).alias("sample"))


def top_by(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
