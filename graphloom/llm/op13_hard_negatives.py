"""Operator 13: hard negatives by blocked dense products.

1. Anchors are cut into blocks of a bounded size. A block is broadcast, and every task multiplies it with its candidates,
   tile by tile, in float64, which is exact below 2 ** 53 (a tile that could pass that is multiplied in whole numbers).
2. Each task keeps the best few candidates of the anchor's own label; the tasks' lists merge into one.
3. The positives' scores make windows. A second pass over the candidates keeps, in the same way, the best few of other
   labels inside each window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table
from .vectors import floored, lists, matrix


@dataclass(frozen=True)
class MiningConfig:
    scale: int = 256  #: a component x counts as floor(scale * x)
    positives: int = 5  #: of an anchor
    negatives: int = 5  #: of an anchor and positive
    low_percent: int = 80  #: a negative's score is at least so much of the positive's
    high_percent: int = 100  #: and at most so much
    block_bytes: int = 32 << 20  #: anchors' components that are broadcast at once
    tile: int = 1024  #: anchors, and candidates, of one product
    part_bytes: int = 256 << 20  #: of the written candidates that one task multiplies, if that leaves no core idle


_NONE = np.iinfo(np.int64).min


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers in float64, exactly; the shorter rows end in zeros."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * width
    if most < 1 << 53:
        return a @ b.T
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    if max((abs(x) for x in whole.ravel().tolist()), default=0) >= 1 << 63:
        raise ValueError("an inner product does not fit 64 bits")
    return whole.astype(np.int64)


def _first(scores: np.ndarray, hits: np.ndarray, k: int) -> np.ndarray:
    """Of each row's hits the k with the highest scores; of equal ones those further left."""
    if scores.shape[1] <= k:
        return hits
    low = -np.inf if scores.dtype.kind == "f" else _NONE
    some = np.where(hits, scores, low)
    last = np.partition(some, -k, axis=1)[:, -k, None]
    ties = (some == last) & hits
    return (some > last) | (ties & (np.cumsum(ties, axis=1) <= k))


class Best:
    """The k best (score, id) of each of n rows: higher scores first, of equal ones the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, hits: np.ndarray) -> None:
        """A tile's hits: its rows are rows at of the lists, its columns have ascending ids."""
        hits &= scores >= self.score[at, -1, None]
        if np.count_nonzero(hits) > 2 * self.k * len(at):
            hits = _first(scores, hits, self.k)
        row, column = np.nonzero(hits)
        if not len(row):
            return
        changed = at[np.unique(row)]
        old = self.score[changed] != _NONE
        rows = np.concatenate([at[row], np.repeat(changed, old.sum(1))])
        score = np.concatenate([scores[row, column].astype(np.int64), self.score[changed][old]])
        id = np.concatenate([ids[column], self.id[changed][old]])
        order = np.lexsort((id, -score, rows))
        rows, score, id = rows[order], score[order], id[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        self.score[changed], self.id[changed] = _NONE, np.iinfo(np.int64).max
        self.score[rows[keep], place[keep]], self.id[rows[keep], place[keep]] = score[keep], id[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(self.score != _NONE)
        return row, self.score[row, place], self.id[row, place]


def _whole(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, label, vec) with vectors of whole numbers; those without a whole vector go."""
        for batch in batches:
            good, flat, size = floored(batch.column(2), scale)
            if not np.isfinite(flat).all():
                raise ValueError("a component is too large for its scale")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), lists(flat, size)], ["id", "label", "vec"])

    return run


def _numbered(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with the task and the block of it that they are in."""
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            block = (n + np.arange(batch.num_rows)) // block_rows
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, task, np.int32)), pa.array(block.astype(np.int32))], [*batch.schema.names, "task", "block"])

    return run


def _tiles(batch: pa.RecordBatch, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids (ascending), labels and vectors of a batch of candidates, some at once."""
    ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for at in range(0, batch.num_rows, tile):
        x = matrix(batch.column(2).slice(at, tile))
        order = np.argsort(ids[at : at + tile], kind="stable")
        yield ids[at : at + tile][order], labels[at : at + tile][order], x[order]


def _positives(block, c: MiningConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates (id, label, vec) as each anchor's best ones of its own label (anchor, id, score)."""
        anchors, own, vectors = block.value
        best = Best(len(anchors), c.positives)
        for batch in batches:
            for ids, labels, x in _tiles(batch, c.tile):
                for at in range(0, len(anchors), c.tile):
                    some = np.arange(at, min(at + c.tile, len(anchors)))
                    best.add(some, products(vectors[some], x), ids, (own[some, None] == labels) & (anchors[some, None] != ids))
        row, score, id = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(id), pa.array(score)], ["anchor", "id", "score"])

    return run


def _negatives(block, found, number: int, c: MiningConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates as the best ones of other labels in each positive's window; pair numbers a block's positives."""
        anchors, own, vectors = block.value
        of, positive, score = found.value  # by anchor
        low = np.array([-((-c.low_percent * s) // 100) for s in score.tolist()], np.int64)
        high = np.array([(c.high_percent * s) // 100 for s in score.tolist()], np.int64)
        begin, most = np.searchsorted(of, np.arange(len(anchors) + 1)), np.bincount(of, minlength=len(anchors)).max(initial=0)
        best = Best(len(of), c.negatives)
        for batch in batches:
            for ids, labels, x in _tiles(batch, c.tile):
                for at in range(0, len(anchors), c.tile):
                    some = np.arange(at, min(at + c.tile, len(anchors)))
                    scores = products(vectors[some], x)
                    other = own[some, None] != labels
                    for j in range(most):
                        here = np.flatnonzero(begin[some] + j < begin[some + 1])
                        pair = begin[some[here]] + j
                        mine = scores if len(here) == len(some) else scores[here]
                        best.add(pair, mine, ids, other[here] & (mine >= low[pair, None]) & (mine <= high[pair, None]))
        pair, value, id = best.rows()
        a = of[pair]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), number)), pa.array(pair), pa.array(anchors[a]), pa.array(positive[pair]), pa.array(score[pair]), pa.array(id), pa.array(value)], ["block", "pair", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _blocks(anchors: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of all anchors (id, label, vec, task, block), at most most rows at once."""
    parts = anchors.groupBy("task", "block").agg(F.count("*").alias("n")).orderBy("task", "block").collect()  # a row for each task and full block
    while parts:
        some, n = [], 0
        while parts and (not some or n + parts[0]["n"] <= most):
            n += parts[0]["n"]
            some.append(parts.pop(0))
        ends = F.struct("task", "block").between(F.struct(F.lit(some[0]["task"]), F.lit(some[0]["block"])), F.struct(F.lit(some[-1]["task"]), F.lit(some[-1]["block"])))
        rows = anchors.where(ends).select("id", "label", "vec").toArrow().combine_chunks()
        column = [rows.column(k).combine_chunks() for k in range(3)]
        yield column[0].to_numpy(), column[1].to_numpy(), matrix(column[2])


def hard_negatives(rows: DataFrame, is_anchor: Column, config: MiningConfig | None = None, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a row where the
    condition on the column id holds) and each of its best positives, the best negatives whose scores lie in the window.

    Ids and labels are whole numbers. Rows with a null id, label or vector, or a null or non-finite component, take no
    part. Scores are inner products; shorter vectors end in zeros; of equal scores the smaller id comes first. A row is no
    positive of a row with its own id; rows that repeat an id are candidates each, and anchors each, whose lists are all
    returned. An empty table gives no rows; other columns are ignored, whatever their names. An anchor without positives,
    or a positive whose window is empty (as below zero), gives no rows. Scores that 64 bits can't hold raise an error.
    """
    c = config or MiningConfig()
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    picked = rows.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("vec"))
    whole = scratch.keep(picked.where(F.col("id").isNotNull() & F.col("label").isNotNull()).mapInArrow(_whole(c.scale), "id long, label long, vec array<double>"), "whole")
    tasks = max(spark.sparkContext.defaultParallelism, -(-scratch.bytes(whole) // c.part_bytes))
    candidates = whole.coalesce(tasks)
    width = whole.agg(F.max(F.size("vec"))).first()[0] or 0
    most = max(1, c.block_bytes // (8 * max(width, 1)))
    anchors = scratch.keep(whole.where(is_anchor).coalesce(tasks).mapInArrow(_numbered(most), "id long, label long, vec array<double>, task int, block int"), "anchors")
    out, schema = scratch.path("windows"), "block long, pair long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    first = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    blocks = 0
    for block in _blocks(anchors, most):
        sent = spark.sparkContext.broadcast(block)
        best = candidates.mapInArrow(_positives(sent, c), "anchor long, id long, score long")
        # at most so many rows as the block's anchors have positives
        found = best.withColumn("n", first).where(F.col("n") <= c.positives).select("anchor", "n", "id", "score").toArrow().sort_by([("anchor", "ascending"), ("n", "ascending")])
        windows = spark.sparkContext.broadcast(tuple(found.column(x).to_numpy() for x in ("anchor", "id", "score")))
        candidates.mapInArrow(_negatives(sent, windows, blocks, c), schema).write.mode("append").parquet(out)
        windows.destroy()
        sent.destroy()
        blocks += 1
    scratch.drop(whole, anchors)
    if not blocks:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(W.partitionBy("block", "pair").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = spark.read.schema(schema).parquet(out).withColumn("rank", rank).where(F.col("rank") <= c.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the labels of some rows are wrong by rule, as in a collection labelled by hand
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 100 == 0)


_C = MiningConfig()
ORACLE = f"""
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({_C.scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {_C.positives})
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND {_C.low_percent} * positive_score <= 100 * score AND 100 * score <= {_C.high_percent} * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= {_C.negatives}
"""
