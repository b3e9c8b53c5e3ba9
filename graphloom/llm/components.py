"""Connected components of a link table, without ever holding the links in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars: each node with the smallest node that these links reach."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
            parent.setdefault(a, min(a, b))
            parent.setdefault(b, min(a, b))
    nodes = [x for x in parent if find(x) != x]
    for at in range(0, len(nodes), 1 << 16):
        some = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], ["node", "component"])


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step (the alternating algorithm of Kiveris and others, 2014)."""
    both = links.union(links.select("component", "node")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    return small.where("v <> m").select(F.col("v").alias("node"), F.col("m").alias("component")).union(low.select("u", "m")).distinct()


def components(scratch: Scratch, links: DataFrame, of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """(node, component) for each node of links (two long columns) but the smallest of each component.

    Partitions contract their own links first; alternating stars then join what lies in several partitions, until no
    node has two parents and no parent is a child. Each step is a written table; of names the written tables behind links.
    """
    stars = scratch.keep(links.toDF("a", "b").where("a <> b").distinct().mapInArrow(_contract, "node long, component long"), "stars", of=of)
    while True:
        twice = stars.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("node")
        chained = stars.select(F.col("component").alias("node")).distinct().join(stars.select("node"), "node", "left_semi")
        if twice.unionAll(chained).isEmpty():
            return stars
        after = scratch.keep(_stars(stars), "stars", of=(stars, stars))
        scratch.drop(stars)
        stars = after
