"""Operator 11: vectors as codes of a few bytes, by codebooks of whole numbers whose nearest entries a VA-file finds.

1. Components become whole numbers; vectors are cut into parts, each with a codebook of its own.
2. A codebook's coordinates are quantised to cells of a few bits. For each vector, tables of its squared distance to each
   cell, from the nearer and from the farther edge, give a lower and an upper bound for every entry.
3. Entries whose lower bound is above the least upper bound are out; only the others are met in exact whole numbers.
4. A round's sums of each entry's parts are added up in every task, and the tasks' sums in one aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .vectors import floored, lists, matrix


@dataclass(frozen=True)
class CodeConfig:
    scale: int = 4096  #: a component x counts as floor(scale * x)
    parts: int = 8
    entries: int = 16  #: of each part's codebook, 256 at most: a code has one byte a part
    rounds: int = 6
    bits: int = 3  #: of a cell number of the VA-file
    rows: int = 2048  #: vectors that are bounded at once
    salts: int = 16  #: rows of one label meet its total in so many parts


class Cells:
    """One codebook (entries x width, whole numbers) with its coordinates quantised to cells."""

    def __init__(self, entries: np.ndarray, bits: int):
        self.entries, n = entries, 1 << bits
        low = entries.min(0)
        step = (entries.max(0) - low) // n + 1
        self.begin = low + step * np.arange(n)[:, None]  # cells x width
        self.end = self.begin + step - 1
        cell = (entries - low) // step
        # a row for each cell of each coordinate, a column for each entry that lies in it: sums over it are products
        self.of = (cell.T[None] == np.arange(n)[:, None, None]).reshape(-1, len(entries))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of each row's nearest entry (the lower of equals), its squared distance, and how many distances were computed."""
        before, behind = self.begin[None] - x[:, None], x[:, None] - self.end[None]
        near = np.square(np.maximum(np.maximum(before, behind), 0)).reshape(len(x), -1)
        far = np.square(np.minimum(before, behind)).reshape(len(x), -1)
        # products of doubles are fast, and exact as long as a sum stays below 2 ** 53
        kind = np.float64 if int(far.max(initial=0)) * x.shape[1] < 1 << 53 else np.int64
        of = self.of.astype(kind)
        lower, upper = near.astype(kind) @ of, far.astype(kind) @ of
        row, entry = np.nonzero(lower <= upper.min(1)[:, None])
        found = np.full(lower.shape, np.iinfo(np.int64).max)
        found[row, entry] = np.square(x[row] - self.entries[entry]).sum(1)
        best = found.argmin(1)
        return best, found[np.arange(len(x)), best], len(row)


def _whole(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, label, vec) with vectors of whole numbers; those without a whole vector go."""
        for batch in batches:
            good, flat, size = floored(batch.column(2), scale)
            most = int(np.abs(flat).max(initial=0)) if np.isfinite(flat).all() else 1 << 64
            if 4 * most * most * int(size.max(initial=0)) >= 1 << 63:
                raise ValueError(f"components of {most} at scale {scale}: squared distances do not fit 64 bits")
            take = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), lists(flat.astype(np.int64), size)], ["id", "label", "vec"])

    return run


def _coded(batch: pa.RecordBatch, books: np.ndarray, c: CodeConfig) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts (rows x parts x width), entry numbers and squared distances (rows x parts) of a batch, some rows at once."""
    cells = [Cells(b, c.bits) for b in books]
    for at in range(0, batch.num_rows, c.rows):
        x = matrix(batch.column(2).slice(at, c.rows), books.shape[0] * books.shape[2]).reshape(-1, books.shape[0], books.shape[2])
        found = [cells[p].nearest(x[:, p]) for p in range(books.shape[0])]
        yield x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(books: np.ndarray, c: CodeConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row (part, entry, n, sums) for each entry that a task's vectors have."""
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for x, code, _ in _coded(batch, books, c):
                for p in range(books.shape[0]):
                    order = np.argsort(code[:, p], kind="stable")
                    used, first = np.unique(code[order, p], return_index=True)
                    n[p, used] += np.diff(np.append(first, len(order)))
                    sums[p, used] += np.add.reduceat(x[order, p], first)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), lists(sums[part, entry].ravel(), np.full(len(part), books.shape[2]))], ["part", "entry", "n", "sums"])

    return run


def whole_vectors(rows: DataFrame, config: CodeConfig | None = None, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, vec array<long>) of the rows that have a vector of finite components."""
    picked = rows.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vec"))
    return picked.mapInArrow(_whole((config or CodeConfig()).scale), f"id long, label {picked.schema['label'].dataType.simpleString()}, vec array<long>")


def fit_codebooks(rows: DataFrame, config: CodeConfig | None = None) -> np.ndarray:
    """Codebooks (parts x entries x width) of a written table of whole_vectors.

    A codebook starts as that part of the rows with the smallest ids (of one id: the smaller vector; null ids last), all
    of them if there are fewer than entries. Each round replaces an entry by floor(sum / count) of the parts nearest to
    it; entries that no part is nearest to stay. Shorter vectors end in zeros, and so does a width that parts do not divide.
    """
    c = config or CodeConfig()
    first = rows.select("id", "vec").orderBy(F.col("id").asc_nulls_last(), "vec").limit(c.entries).collect()
    width = -(-(rows.agg(F.max(F.size("vec"))).first()[0] or 0) // c.parts)
    books = np.zeros((c.parts, len(first), width), np.int64)
    for k, r in enumerate(first):
        books[:, k] = np.pad(np.array(r["vec"], np.int64), (0, c.parts * width - len(r["vec"]))).reshape(c.parts, width)
    for _ in range(c.rounds if books.size else 0):
        partial = rows.mapInArrow(_sums(books, c), "part int, entry int, n long, sums array<long>")
        # exact however many rows there are; parts x entries rows come back
        total = [F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]]
        for r in partial.groupBy("part", "entry").agg(*total).collect():
            books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(width)]
    return books


def encoded(rows: DataFrame, books: np.ndarray, config: CodeConfig | None = None) -> DataFrame:
    """(id, label, code, error) of whole_vectors: entry numbers in two hex digits a part, and the squared distances' sum."""
    c = config or CodeConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = [], [np.zeros(0, np.int64)]
            for _, numbers, distances in _coded(batch, books, c):
                raw = numbers.astype(np.uint8).tobytes().hex()
                code += [raw[i : i + 2 * c.parts] for i in range(0, len(raw), 2 * c.parts)]
                error.append(distances.sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(np.concatenate(error))], ["id", "label", "code", "error"])

    return rows.mapInArrow(run, f"id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def decoded(codes: DataFrame, books: np.ndarray, config: CodeConfig | None = None) -> DataFrame:
    """(id, vec array<double>): the vectors that codes (id, code) stand for, in the scale of the input."""
    c = config or CodeConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(-1, c.parts)
            x = books[np.arange(c.parts), numbers].reshape(batch.num_rows, -1) / c.scale
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x.ravel(), np.full(len(x), x.shape[1]))], ["id", "vec"])

    return codes.select("id", "code").mapInArrow(run, "id long, vec array<double>")


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


def vector_codes(rows: DataFrame, config: CodeConfig | None = None, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error, label_error) for each row with a vector of finite components, and the codebooks.

    label_error is the error of all rows of that label, null labels together. Rows with a null vector, or a null or
    non-finite component, are left out; a null id stays null; rows that repeat an id are coded each; equal distances go
    to the lower entry; an empty vector counts as zeros; an empty table gives no rows; components so large that squared
    distances do not fit 64 bits raise an error; other columns are ignored, whatever their names.
    """
    c = config or CodeConfig()
    if not 0 < c.entries <= 256:
        raise ValueError(f"entries must be from 1 to 256, not {c.entries}")
    scratch = Scratch(rows.sparkSession, "codes")
    whole = scratch.keep(whole_vectors(rows, c, id, vector, label), "whole")
    books = fit_codebooks(whole, c)
    codes = scratch.keep(encoded(whole, books, c), "codes")
    scratch.drop(whole)
    # any number of labels, any share of the rows in one: totals are copied for each salt, never broadcast
    total = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    total = total.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(c.salts - 1))))
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(c.salts)).cast("int"))
    both = salted.join(total.hint("merge"), F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")))
    return both.select("id", "label", "code", "error", "label_error"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _oracle(c: CodeConfig) -> str:
    """The same in SQL: one pair of steps a round, every entry compared with every part."""
    nearest = "SELECT vec_id, p.part, v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT vec_id, p.part, p.v, entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts p JOIN {b} b USING (part)) p GROUP BY vec_id, p.part, v"
    steps = []
    for r in range(c.rounds):
        near = nearest.format(b=f"b{r}")
        steps.append(f"a{r} AS MATERIALIZED ({near})")
        mean = f"SELECT part, entry, list(m ORDER BY i) AS v FROM (SELECT part, entry, i, floor(sum(v[i])::DECIMAL(38,0) / count(*))::BIGINT AS m FROM a{r}, (SELECT unnest(range(1, {{w}} + 1)) AS i) GROUP BY part, entry, i) GROUP BY part, entry"
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN ({mean}) m USING (part, entry))".replace("{w}", "(SELECT min(len(v)) FROM parts)"))
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({c.scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {c.parts}) + 1:(part + 1) * (len(v) // {c.parts})] AS v FROM kept, (SELECT unnest(range({c.parts})) AS part)),
b0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {c.entries}) USING (vec_id)),
{", ".join(steps)},
z AS MATERIALIZED ({nearest.format(b=f"b{c.rounds}")}),
one AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM z GROUP BY vec_id),
sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{c.rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM one JOIN kept USING (vec_id), sha
"""


ORACLE = _oracle(CodeConfig())
