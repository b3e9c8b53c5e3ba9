"""Operator 1: near-duplicate documents by MinHash bands and odd sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, spare, table
from .near import NearConfig, near_groups


def near_dedup(docs: DataFrame, config: NearConfig | None = None) -> DataFrame:
    """(row, version, doc_id, n_shingles, component_id, kept) for each row of docs (doc_id long, text string).

    Nulls and texts without words have empty sets: they link with nothing, are their own component and are kept.
    Repeated rows are linked like any equal texts; one row of each component is kept, the first of those with the
    smallest doc_id (a null doc_id counts as the largest). A very long text is one step, so memory follows the longest.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "near")
    found = near_groups(scratch, docs.select("doc_id", "text"), config or NearConfig())
    return found.select(
        "row",
        "version",
        F.col("uid").alias("doc_id"),
        F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("uid")).otherwise(F.col("first.uid")).alias("component_id"),
        (F.col("component").isNull() | (F.col("row") == F.col("first.row"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, config: NearConfig | None = None) -> DataFrame:
    """docs with one row of each near-duplicate group, columns as they were, whatever their names; rows equal in doc_id and text count as one."""
    scratch = Scratch(docs.sparkSession, "one")
    verdict = scratch.keep(near_dedup(docs, config).select("row", "doc_id", "version", "kept"), "verdict")
    version, id_, v = spare(docs.columns, "version", "kept_id", "kept_version")
    kept = verdict.where("kept").select(F.col("doc_id").alias(id_), F.col("version").alias(v)).distinct()
    out = docs.withColumn(version, F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(version) == F.col(v)), "left_semi")
    if not verdict.groupBy("doc_id", "version").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", version])
    return out.select(*[F.col(f"`{x}`") for x in docs.columns])


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_dedup(docs, NearConfig(width=4)).drop("row", "version")
