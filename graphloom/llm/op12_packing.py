"""Operator 12: documents packed without padding: each is cut into pieces whose lengths are powers of two.

1. A document's tokens are cut into as many full sequences as it has, and what is left by the binary digits of its length.
2. A piece is a sequence of its own, so no sequence crosses documents and none is padded: its length is a power of two.
3. Sequences are written by length, a folder each, so that a reader's batches are of equal lengths.
4. Sequences are numbered from the longest to the shortest; a number is made of counts that every task writes, so no
   sequence is moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, steps, table, texts
from .op06_token_orc import STEP, TokenConfig, Words


@dataclass(frozen=True)
class PackConfig:
    tokenizer: str = ""  #: path of a tokenizers file; empty: the public word_bpe_49k.json
    end_id: int = 1
    tokens: int = 2048  #: of the longest sequence, a power of two
    cache_words: int = 1 << 21  #: parts of words whose ids a worker remembers
    broadcast_rows: int = 100_000  #: counts of tasks and lengths that are broadcast; more are joined by key


#: A worker process runs many tasks; what it has learnt stays with it.
_WORDS: dict[tuple[str, int], Words] = {}


def binary_lengths(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the document and length of each piece, in the documents' order, longer pieces first."""
    places = np.arange(most.bit_length() - 1)[::-1]
    times = np.column_stack([sizes // most, (sizes[:, None] >> places) & 1])
    length = np.append(most, 1 << places)
    return np.repeat(np.arange(len(sizes)), times.sum(1)), np.repeat(np.tile(length, len(sizes)), times.ravel())


_PIECE = "doc_id long, start long, length int, doc_tokens long, task int, place long, ids array<int>"


def _pieces(c: PackConfig):
    path = TokenConfig(tokenizer=c.tokenizer).path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, text) as pieces; place counts a task's pieces of one length."""
        if (path, c.cache_words) not in _WORDS:
            _WORDS[path, c.cache_words] = Words(path, c.cache_words)
        words = _WORDS[path, c.cache_words]
        task, before = TaskContext.get().partitionId(), dict.fromkeys((1 << i for i in range(c.tokens.bit_length())), 0)
        for batch in batches:
            column = texts(batch.column(1))
            for lo, hi in steps(column, STEP):
                found, count = words.encode(column, lo, hi)
                sizes = count + 1
                ids = np.full(int(sizes.sum()), c.end_id, "<i4")
                ids[np.arange(len(found)) + np.repeat(np.arange(hi - lo), count)] = found
                doc, length = binary_lengths(sizes, c.tokens)
                ends = np.cumsum(length)
                start = ends - length - (np.cumsum(sizes) - sizes)[doc]
                place = np.zeros(len(length), np.int64)
                for n in np.unique(length).tolist():
                    at = np.flatnonzero(length == n)
                    place[at] = before[n] + np.arange(len(at))
                    before[n] += len(at)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(sizes[doc]), pa.array(np.full(len(doc), task, np.int32)), pa.array(place), lists],
                    ["doc_id", "start", "length", "doc_tokens", "task", "place", "ids"],
                )

    return run


def write_packed(docs: DataFrame, path: str, config: PackConfig | None = None) -> None:
    """Writes docs (doc_id long, text string) as Parquet rows (doc_id, start, doc_tokens, task, place, ids), a folder for each length.

    A null or empty text is its end id alone, one sequence of one token; a null doc_id stays null; rows that repeat a
    doc_id are packed each; a very long text is tokenised whole and leaves in pieces; an empty table writes no rows;
    other columns are ignored, whatever their names.
    """
    c = config or PackConfig()
    if c.tokens < 1 or c.tokens & (c.tokens - 1):
        raise ValueError(f"tokens must be a power of two, not {c.tokens}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(c), _PIECE)
    rows.write.option("compression", "zstd").partitionBy("length").parquet(path)


def read_packed(spark: SparkSession, path: str, config: PackConfig | None = None) -> DataFrame:
    """(sequence_id, doc_id, start, length, doc_tokens, ids) of written sequences.

    Sequence numbers run from 0 without gaps, the longest sequences first; they follow the files, so they stay as they
    are however often the files are read. A condition on length reads that length's folder alone.
    """
    c = config or PackConfig()
    rows = spark.read.schema(_PIECE).parquet(path)
    counts = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    written = Scratch(spark, "packed").keep(counts, "counts")  # a row for each task and length
    upto = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    # one row for each length
    whole = written.groupBy("length").agg(F.sum("n").alias("all"))
    longer = whole.select("length", F.coalesce(F.sum("all").over(W.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("longer"))
    base = written.withColumn("inside", F.coalesce(upto, F.lit(0))).join(F.broadcast(longer), "length").select(F.col("length").alias("l"), F.col("task").alias("t"), (F.col("longer") + F.col("inside")).alias("base"))
    base = F.broadcast(base) if written.count() <= c.broadcast_rows else base.hint("merge")
    both = rows.join(base, (F.col("length") == F.col("l")) & (F.col("task") == F.col("t")))
    return both.select((F.col("base") + F.col("place")).alias("sequence_id"), "doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CRC-32 of each piece's ids as little-endian unsigned 32-bit integers."""
    for batch in batches:
        column = batch.column(5)
        raw = memoryview(np.ascontiguousarray(column.flatten().to_numpy().astype("<u4"))).cast("B")
        ends = (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(crc, pa.int64())], [*batch.schema.names[:5], "ids_crc32"])


def packed_digest(spark: SparkSession, path: str, config: PackConfig | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each written piece; a piece is its sequence, so it begins at 0."""
    rows = read_packed(spark, path, config).mapInArrow(_crc, "sequence_id long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long")
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "sequences").path("ids")
    write_packed(table(spark, sf_dir, "documents"), path)
    return packed_digest(spark, path)
