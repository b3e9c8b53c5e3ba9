"""Operator 9: globally repeated multi-line chunks with content-defined borders.

1. A rolling hash over the hashes of a text's lines chooses borders, so lines that are put in or taken out elsewhere
   don't move them. A text is its chunks, each a list of line hashes.
2. Chunks of two lines or more that repeat an earlier chunk go whole.
3. A repeated block need not hold a whole chunk. What is left, pairs of neighbouring lines across borders and inside
   chunks that stay, is looked up too: a pair that repeats an earlier one goes. A pair inside a chunk that goes is
   repeated with it, and its first occurrence is in a chunk that stays, so nothing is missed: the result is every block
   of two or more lines that occurred before, wherever it begins.
4. Before anything is removed, the bytes of the lines in repeated ranges and in their first places are compared: should
   two different lines share their 128-bit hash, it is replaced by another hash and the ranges are found anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, steps, table, texts

_BASE = 0x9E3779B97F4A7C15


def line_hash(line: bytes, parted: tuple[frozenset, ...]) -> int:
    """A line's 128-bit hash; one under which two different lines met in round k (parted[k]) gives way to another."""
    h = xxhash.xxh3_128_intdigest(line)
    for k, met in enumerate(parted):
        if h in met:
            h = int.from_bytes(hashlib.blake2b(line, digest_size=16, salt=k.to_bytes(2)).digest())
    return h


@dataclass(frozen=True)
class ChunkConfig:
    window: int = 2  #: lines under the rolling hash
    divisor: int = 3  #: a chunk ends where the rolling hash is a multiple: three lines on average
    min_lines: int = 2  #: chunks of fewer lines are never removed whole
    salts: int = 16  #: a hot chunk's occurrences meet its first one in so many parts
    hash: Callable[[bytes, tuple[frozenset, ...]], int] = line_hash


def chunk_ends(hashes: np.ndarray, c: ChunkConfig) -> np.ndarray:
    """Where chunks of lines with these hashes end; the last one ends with the text."""
    n = len(hashes)
    ends = np.zeros(n, bool)
    if n >= c.window:
        rolling = np.zeros(n - c.window + 1, np.uint64)
        for j in range(c.window):
            rolling = rolling * np.uint64(_BASE) + hashes[j : n - c.window + 1 + j]
        ends[c.window - 1 :] = (rolling >> np.uint64(33)) % np.uint64(c.divisor) == 0
    ends[-1:] = True
    return np.flatnonzero(ends) + 1


def _halves(hashes: list[int]) -> np.ndarray:
    """128-bit hashes as rows of two signed 64-bit numbers."""
    return np.frombuffer(b"".join(h.to_bytes(16, "little") for h in hashes), "<i8").reshape(-1, 2)


_LINE = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def _chunks(parted: tuple[frozenset, ...], c: ChunkConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, version, text) as chunks (doc_id, version, at, hashes, next): first line, lines' hashes, hash of the line behind."""
        for batch in batches:
            column = texts(batch.column(2))
            for lo, hi in steps(column):
                row, at, size, flat, after = [], [], [], [], []
                for i in range(lo, hi):
                    hashes = _halves([c.hash(x, parted) for x in column[i].as_buffer().to_pybytes().split(b"\n")])
                    ends = chunk_ends(hashes[:, 0].view(np.uint64), c)
                    begins = np.append(0, ends[:-1])
                    row.append(np.full(len(ends), i))
                    at.append(begins)
                    size.append(ends - begins)
                    flat.append(hashes)
                    after += [*({"a": a, "b": b} for a, b in hashes[ends[:-1]].tolist()), None]
                take = pa.array(np.concatenate(row))
                offsets = pa.array(np.append(0, np.cumsum(np.concatenate(size))).astype(np.int32))
                both = np.concatenate(flat)
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], fields=list(_LINE)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(at).astype(np.int64)), lists, pa.array(after, _LINE)], ["doc_id", "version", "at", "hashes", "next"])

    return run


def _repeated(rows: DataFrame, scratch: Scratch, c: ChunkConfig) -> DataFrame:
    """(doc_id, version, at, lines, gone) of rows (doc_id, version, at, lines, x, y), where 128 bits x and y are a range's
    content: ranges that an earlier place (smaller doc_id, version, then line) has are gone, the earliest places are not.

    Hot contents meet their first place in salted parts.
    """
    pos = F.struct("doc_id", "version", "at")
    first = rows.groupBy("x", "y").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.min("lines").alias("lines")).where("first <> last").select("x", "y", "lines", "first")
    first = scratch.keep(first, "firsts")
    spread = first.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(c.salts - 1))).alias("salt"), "first")
    salt = F.pmod(F.xxhash64("doc_id", "version", "at"), F.lit(c.salts)).cast("int")
    later = rows.withColumn("salt", salt).join(spread, ["x", "y", "salt"]).where(pos > F.col("first")).select("doc_id", "version", "at", "lines", F.lit(True).alias("gone"))
    return later.unionByName(first.select("first.doc_id", "first.version", "first.at", "lines", F.lit(False).alias("gone"))).distinct()


def _key(*hashes: Column) -> list[Column]:
    """128 bits of the content that line hashes stand for."""
    return [F.xxhash64(*hashes).alias("x"), F.xxhash64(F.lit(1), *hashes).alias("y")]


def _ranges(versioned: DataFrame, parted: tuple[frozenset, ...], scratch: Scratch, c: ChunkConfig) -> DataFrame:
    """Repeated ranges of lines by their hashes: chunks, and pairs of neighbouring lines where no chunk goes."""
    line = "struct<a:long,b:long>"
    chunks = scratch.keep(versioned.mapInArrow(_chunks(parted, c), f"doc_id long, version long, at long, hashes array<{line}>, next {line}"), "chunks")
    lines = F.size("hashes").cast("long").alias("lines")
    whole = scratch.keep(_repeated(chunks.where(F.size("hashes") >= c.min_lines).select("doc_id", "version", "at", lines, *_key(F.col("hashes"))), scratch, c), "whole")
    gone = whole.where("gone").select(F.col("doc_id").alias("d"), F.col("version").alias("v"), F.col("at").alias("a"), F.lit(True).alias("gone")).distinct()
    marked = chunks.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")) & (F.col("at") == F.col("a")), "left")
    own = F.when(F.col("gone"), F.slice("hashes", -1, 1)).otherwise(F.col("hashes"))
    skipped = F.col("at") + F.when(F.col("gone"), F.size("hashes") - 1).otherwise(0)
    run = F.when(F.col("next").isNull(), own).otherwise(F.concat(own, F.array("next")))
    # neighbours are zipped before they are exploded: a row of a long run must not carry the run
    zipped = marked.select("doc_id", "version", skipped.alias("base"), let(run, lambda h: F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda p, q: F.struct(*_key(p, q)))).alias("z"))
    pairs = zipped.select("doc_id", "version", "base", F.posexplode("z").alias("i", "p")).select("doc_id", "version", (F.col("base") + F.col("i")).alias("at"), F.lit(2).cast("long").alias("lines"), "p.x", "p.y")
    pairs = scratch.keep(pairs, "pairs")
    scratch.drop(chunks)
    return whole.unionByName(_repeated(pairs, scratch, c))


def _versioned(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text")


def _with_ranges(docs: DataFrame, parted: tuple[frozenset, ...], scratch: Scratch, c: ChunkConfig) -> DataFrame:
    """Rows (doc_id, text, ranges) of docs, written."""
    ranges = _ranges(_versioned(docs), parted, scratch, c).groupBy("doc_id", "version").agg(F.collect_set(F.struct("at", "lines", "gone")).alias("ranges"))
    ranges = scratch.keep(ranges, "ranges").withColumnsRenamed({"doc_id": "d", "version": "v"})
    # ranges grow with the input: the same plan at every size, never a broadcast
    both = _versioned(docs).join(ranges.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    return scratch.keep(both.select("doc_id", "text", "ranges"), "both")


def _covered(parted: tuple[frozenset, ...], c: ChunkConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (text, ranges) as distinct (a, b, line) of the lines in ranges; two lines of one hash are two rows."""
        seen: set[bytes] = set()
        held = 0
        for batch in batches:
            for text, ranges in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                lines = text.as_buffer().to_pybytes().split(b"\n")
                for x in ranges:
                    seen.update(lines[x["at"] : x["at"] + x["lines"]])
                held += len(ranges)
                if held > 1 << 16:
                    yield _batch(seen)
                    seen, held = set(), 0
        yield _batch(seen)

    def _batch(seen: set[bytes]) -> pa.RecordBatch:
        lines = list(seen)
        halves = _halves([c.hash(x, parted) for x in lines])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array(lines, pa.binary())], ["a", "b", "line"])

    return run


def collisions(ranged: DataFrame, parted: tuple[frozenset, ...], c: ChunkConfig) -> frozenset:
    """Hashes under which lines of repeated ranges (text, ranges) differ: their bytes are compared. Practically none."""
    lines = ranged.where(F.col("ranges").isNotNull()).select("text", "ranges").mapInArrow(_covered(parted, c), "a long, b long, line binary")
    met = lines.groupBy("a", "b").agg(F.min("line").alias("x"), F.max("line").alias("y")).where("x <> y").select("a", "b").collect()
    return frozenset(int.from_bytes(np.array([r["a"], r["b"]], "<i8").tobytes(), "little") for r in met)


def _compared(docs: DataFrame, scratch: Scratch, c: ChunkConfig) -> DataFrame:
    """Rows (doc_id, text, ranges) whose ranges are repeated byte by byte: hashes that two lines share are replaced, until none is."""
    parted: tuple[frozenset, ...] = ()
    while True:
        ranged = _with_ranges(docs, parted, scratch, c)
        met = collisions(ranged, parted, c)
        if not met:
            return ranged
        scratch.drop(ranged)
        parted = (*parted, met)


def repeated_blocks(docs: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """(doc_id, at, lines): line ranges of docs that repeat lines of an earlier place (smaller doc_id, or earlier line) byte for byte.

    docs: doc_id long, text string. Ranges are chunks and pairs of lines; together they cover every repeated block of
    two or more lines; pairs of blank lines are among them. Rows with one doc_id and one text count as one document and
    have their ranges each, others with that doc_id as different ones. Null and empty texts have one empty line; a null
    doc_id comes first; a very long text is one step, so memory follows the longest; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    ranged = _compared(docs, Scratch(docs.sparkSession, "chunks"), config or ChunkConfig())
    return ranged.select("doc_id", F.explode("ranges").alias("r")).where("r.gone").select("doc_id", "r.at", "r.lines")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, ranges of repeated lines) without the runs of such lines that have a word, and what was counted."""
    for batch in batches:
        column = batch.column(1)
        for lo, hi in steps(texts(column)):
            kept, n, removed, spans = [], [], [], []
            for text, ranges in zip(column[lo:hi].to_pylist(), batch.column(2)[lo:hi].to_pylist(), strict=True):
                lines = (text or "").split("\n")
                gone = np.zeros(len(lines) + 2, bool)
                for x in ranges or []:
                    if x["gone"]:
                        gone[x["at"] + 1 : x["at"] + 1 + x["lines"]] = True
                edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist() + [len(lines)] * bool(gone[-1])
                runs = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if "".join(lines[a:b]).encode().strip()]
                begin, rest = 0, []
                for a, b in runs:
                    rest += lines[begin:a]
                    begin = b
                kept.append("\n".join(rest + lines[begin:]) if text is not None else None)
                n.append(len(lines) if text is not None else 0)
                removed.append(sum(b - a for a, b in runs))
                spans.append(len(runs))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], ["doc_id", "text", "n_lines", "n_removed_lines", "n_removed_blocks"])


def without_repeated_blocks(docs: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_removed_lines, n_removed_blocks): each row's text without its repeated_blocks; a null text stays null.

    Runs of repeated lines without a word stay. Rows that repeat a doc_id and a text are one document, so each of them
    keeps what is new in it; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    ranged = _compared(docs, Scratch(docs.sparkSession, "chunks"), config or ChunkConfig())
    return ranged.mapInArrow(_cut, "doc_id long, text string, n_lines long, n_removed_lines long, n_removed_blocks long")


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_blocks(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_blocks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
