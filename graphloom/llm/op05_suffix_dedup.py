"""Operator 5: repeated byte strings by a distributed merge sort of suffixes.

A string of ``length`` bytes is repeated where it also starts earlier. Sorting all suffixes would move a hundred times
the text, so suffixes are sampled by content: of the k-grams in each window of ``length`` bytes the one with the
smallest hash (the leftmost on a tie) is the window's anchor. Equal windows have equal anchors at equal places, so it
is enough to sort the suffixes that begin at anchors, with the few bytes before them.

1. Anchors whose k-gram hash occurs once in the corpus are dropped: their windows occur once.
2. Each task cuts out the other anchors' suffixes (up to the end of their last window), drops those that repeat an
   earlier one of its run with all the bytes before, sorts the rest, and writes them as front-coded runs, dealt out by
   the k-gram. So a passage that a third of the corpus holds leaves each task as one suffix.
3. A reducer merges its runs by a loser tree that carries common prefixes. Which windows are equal is read off the
   merged order: a window that begins o bytes before its anchor equals another one if all common prefixes between
   them have length - o bytes, and, in the order of the reversed bytes before the anchors, o bytes. No hash decides.

An anchor that very many places share is split: its windows fall into ``pieces`` ranges of o, each with an anchor of its
own near the range, so that strings of 91 bytes and not of 32 are dealt out together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, input_bytes, joined, mix, random_words, steps, table, texts
from .suffixes import Run, front_code, merge

_PLACE_BITS = 28
_PIECE = 1 << 24  #: windows that anchors are found for at once; places in them fit into _PLACE_BITS
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_VALUE = random_words(51, 256)
_ODD = random_words(52, 64) | np.uint64(1)
_NONE = -(1 << 63)


@dataclass(frozen=True)
class SuffixConfig:
    length: int = 100  #: bytes of a repeated string
    gram: int = 32  #: bytes of an anchor
    run_bytes: int = 24 << 20  #: suffixes that a task sorts at once
    block: int = 1 << 16  #: merged suffixes whose windows are compared at once
    hot: int = 1 << 16  #: an anchor with more places is split
    pieces: int = 8  #: parts of a split anchor
    part_bytes: int = 64 << 20  #: input bytes of one reducer, by the source's own statistics

    def cuts(self, hot: bool) -> list[tuple[int, int]]:
        """Ranges of o, how far a window begins before its anchor, from lo to hi."""
        n, top = self.pieces if hot else 1, self.length - self.gram + 1
        edges = [top * k // n for k in range(n + 1)]
        return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False) if b > a]

    @property
    def fixed(self) -> list[int]:
        """Bytes that equal windows of a cut share from the cut's anchor on, for the whole anchor and then for its parts."""
        return [self.length - b + a for a, b in [*self.cuts(False), *self.cuts(True)]]


def gram_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all strings of size bytes, from those of doubling lengths."""
    parts, have, k = [], _VALUE[buf], 1
    left, at = size, 0
    while True:
        if left & k:
            parts.append((k, have))
            left -= k
        if not left:
            break
        have = have[:-k] * _ODD[at] + have[k:] if len(have) > k else have[:0]
        k *= 2
        at += 1
    n = max(0, len(buf) - size + 1)
    out, begin = np.zeros(n, np.uint64), 0
    for i, (k, h) in enumerate(reversed(parts)):
        out = out * _ODD[32 + i] + h[begin : begin + n]
        begin += k
    return mix(out)


def anchors(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, c: SuffixConfig) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, last window, anchor, its document's number, the anchors' hashes.

    A very long text is taken piece by piece; a run that a piece's end cuts is two runs of one anchor.
    """
    out = []
    for at in range(0, max(1, len(buf) - c.length + 1), _PIECE):
        part = buf[at : at + _PIECE + c.length - 1]
        lo, hi, x, doc, h = _anchors(part, np.clip(begin - at, 0, len(part)), np.clip(end - at, 0, len(part)), c)
        out.append((lo + at, hi + at, x + at, doc, h[x]))
    return out[0] if len(out) == 1 else tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _anchors(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, c: SuffixConfig) -> tuple[np.ndarray, ...]:
    h = gram_hashes(buf, c.gram)
    n = len(buf) - c.length + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none, h
    width = c.length - c.gram + 1
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    k = 1
    while 2 * k <= width:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    low = np.minimum(low[: len(low) - (width - k)], low[width - k :])[:n] if width > k else low[:n]
    at = (low & _PLACE).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    some = end - begin >= c.length
    np.add.at(valid, begin[some], 1)
    np.add.at(valid, end[some] - c.length + 1, -1)
    good = np.cumsum(valid)[:n] > 0
    new = good & np.append(True, (at[1:] != at[:-1]) | ~good[:-1])
    last = good & np.append((at[1:] != at[:-1]) | ~good[1:], True)
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    # a text before this piece and one that begins at it share a begin of zero: the last one holds the window
    return lo, hi, at[lo], np.searchsorted(begin, lo, "right") - 1, h


def _anchor_rows(c: SuffixConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, version, text) as (hash, doc_id, version, at)."""
        for batch in batches:
            column = texts(batch.column(2))
            for lo, hi in steps(column):
                buf, begin, end = joined(column, lo, hi)
                _, _, at, doc, h = anchors(buf, begin, end, c)
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
                at, doc, h = at[first], doc[first], h[first]
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(at - begin[doc])], ["hash", "doc_id", "version", "at"])

    return run


_RUNS = "part int, cut int, run long, shared binary, sizes binary, rest binary, lefts array<binary>, docs array<long>, versions array<long>, starts array<long>, doc_id long, version long, begin long, stop long"


def _sorted_runs(c: SuffixConfig, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, version, text, repeated anchors, hot anchors), ascending, as front-coded runs and as spans known to be repeated."""
        # (cut, string from the anchor on, bytes before it) -> where the anchor is
        held: dict[tuple[int, bytes, bytes], tuple[int, int, int]] = {}
        spans: list[tuple[int, int, int, int]] = []
        size = number = 0
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        cuts = {False: c.cuts(False), True: c.cuts(True)}
        fixed = c.fixed

        def flush() -> pa.RecordBatch:
            nonlocal size, number
            dealt: dict[tuple[int, int], list] = {}
            for (cut, suffix, left), where in held.items():
                key = int.from_bytes(hashlib.blake2b(suffix[: fixed[cut]], digest_size=4).digest(), "big") % parts
                dealt.setdefault((key, cut), []).append((suffix, left, where))
            rows = []
            for (part, cut), found in dealt.items():
                found.sort()
                shared, rest = front_code([x[0] for x in found])
                rows.append((part, cut, (task << 32) + number, np.array(shared, "<u2").tobytes(), np.array([len(x[0]) for x in found], "<u2").tobytes(), rest, [x[1] for x in found], [x[2][0] for x in found], [x[2][1] for x in found], [x[2][2] for x in found], None, None, None, None))
            rows += [(None,) * 10 + x for x in spans]
            held.clear()
            spans.clear()
            size, number = 0, number + 1
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 3, *[pa.int64()] * 4]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _RUNS.split(", ")])

        for batch in batches:
            column = texts(batch.column(2))
            ids, versions, wanted, hot = pc.fill_null(batch.column(0), _NONE).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4)
            for lo, hi in steps(column):
                buf, begin, end = joined(column, lo, hi)
                first, last, at, doc, _ = anchors(buf, begin, end, c)
                marked = np.zeros(len(buf) + 1, np.int8)
                for k in range(lo, hi):
                    marked[begin[k - lo] + wanted[k].values.to_numpy()] = 1
                    marked[begin[k - lo] + hot[k].values.to_numpy()] = 2
                raw = buf.tobytes()
                keep = marked[at] > 0
                for a, b, x, d in zip(first[keep].tolist(), last[keep].tolist(), at[keep].tolist(), doc[keep].tolist(), strict=True):
                    split = marked[x] == 2
                    for cut, (near, far) in enumerate(cuts[split], len(cuts[False]) if split else 0):
                        # windows that begin far to near bytes before x; the cut's own anchor is at the near end
                        y, v, w = x - near, max(a, x - far), min(b, x - near)
                        if v > w:
                            continue
                        where = ids[lo + d], versions[lo + d], y - int(begin[d])
                        seen = held.setdefault((cut, raw[y : w + c.length], raw[v:y]), where)
                        if seen is where:
                            size += 160 + w + c.length - v
                        elif seen != where:
                            spans.append((where[0], where[1], v - int(begin[d]), w - int(begin[d]) + c.length))
                if size >= c.run_bytes or len(spans) > 1 << 18:
                    yield flush()
        yield flush()

    return run


def _repeated(c: SuffixConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs, sorted by part and cut, as spans (doc_id, version, begin, stop) of windows that also start earlier."""
        at, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                key = row["part"].as_py(), row["cut"].as_py()
                if key != at:
                    yield from _merged(held, c.fixed[at[1]] if at else 0, c)
                    at, held = key, []
                # compact until the run is read: ids stay in Arrow's own arrays
                held.append((row["shared"].as_py(), row["sizes"].as_py(), row["rest"].as_py(), row["lefts"].values, row["docs"].values.to_numpy(), row["versions"].values.to_numpy(), row["starts"].values.to_numpy()))
        yield from _merged(held, c.fixed[at[1]] if at else 0, c)

    return run


def _merged(held: list[tuple], fixed: int, c: SuffixConfig) -> Iterator[pa.RecordBatch]:
    """Merges the runs of one part and cut; whole groups of strings that share what the cut's windows share are compared together."""
    runs = [Run(np.frombuffer(x[0], "<u2").tolist(), np.frombuffer(x[1], "<u2").tolist(), x[2], range(n << 32, (n << 32) + (len(x[0]) // 2))) for n, x in enumerate(held)]
    block: list[tuple[int, int, int]] = []  # length of the string, what it shares with the one before, its run and place
    some: list[tuple[int, int, int]] = []
    for suffix, shared, tag in merge(runs):
        if shared < fixed:
            if len(some) > 1:
                block += some
            some = []
            if len(block) > c.block:
                yield _compared(block, held, c)
                block = []
        some.append((len(suffix), shared, tag))
    if len(some) > 1:
        block += some
    if block:
        yield _compared(block, held, c)


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many first bytes each row shares with the one before; rows end after sizes bytes."""
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.append(0, np.minimum(same, np.minimum(sizes[1:], sizes[:-1])))


def _compared(block: list[tuple[int, int, int]], held: list[tuple], c: SuffixConfig) -> pa.RecordBatch:
    """Spans of a block of whole groups in merged order.

    Strings of one class for o: neighbours share length - o bytes from the anchor on, all of them, and in the order of
    the reversed bytes before the anchors neighbours share o bytes.
    """
    size, shared, tag = (np.array(x, np.int64) for x in zip(*block, strict=True))
    run, at = tag >> 32, tag & 0xFFFFFFFF
    n = len(size)
    doc, version, place = (np.empty(n, np.int64) for _ in range(3))
    lefts: list = [b""] * n
    for r in np.unique(run).tolist():
        k = np.flatnonzero(run == r)
        doc[k], version[k], place[k] = (held[r][i][at[k]] for i in (4, 5, 6))
        for i, x in zip(k.tolist(), held[r][3].take(pa.array(at[k])).to_pylist(), strict=True):
            lefts[i] = x
    before = np.fromiter(map(len, lefts), np.int64, n)
    width = -(-max(1, int(before.max())) // 8) * 8
    back = np.frombuffer(b"".join(x[::-1].ljust(width, b"\0") for x in lefts), np.uint8).reshape(n, width)
    # shorter ones come first where padding makes rows equal, so that no row parts two longer ones
    order = np.lexsort((before, *back.view(">u8").T[::-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    left = _common(back[order], before[order])
    in_order = np.lexsort((place, version, doc))  # document order, the same for every o
    top = int(before.max())
    again = np.zeros((n, top + 3), bool)  # column o + 1
    for o in range(top + 1):
        some = in_order[(before[in_order] >= o) & (size[in_order] >= c.length - o)]
        if len(some) < 2:
            continue
        after = np.cumsum(shared < c.length - o)
        ahead = np.cumsum(left < o)[rank]
        _, first, of = np.unique(after[some] * n + ahead[some], return_index=True, return_inverse=True)
        one = some[first[of]]
        again[some, o + 1] = (doc[some] != doc[one]) | (version[some] != version[one]) | (place[some] != place[one])
    # windows follow each other as o falls: a span begins at the greatest o of a run of columns
    row, far = np.nonzero(again[:, 1:-1] & ~again[:, 2:])
    row_, near = np.nonzero(again[:, 1:-1] & ~again[:, :-2])
    return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(version[row]), pa.array(place[row] - far), pa.array(place[row_] - near + c.length)], ["doc_id", "version", "begin", "stop"])


def repeated_spans(docs: DataFrame, config: SuffixConfig | None = None) -> DataFrame:
    """(doc_id, version, begin, stop): byte ranges of docs (doc_id long, text string) covered by strings that also start earlier.

    version is the text's xxhash64. Rows with one doc_id and one text are one document; with one doc_id and different
    texts they are several, smaller version first. A null text has no bytes; a null doc_id comes first and is written
    as the smallest long; ranges may touch or overlap; a very long text is cut into pieces of 16 MB for its anchors; an
    empty table gives none; other columns are ignored, whatever their names.
    """
    c = config or SuffixConfig()
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // c.part_bytes))
    versioned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    found = scratch.keep(versioned.mapInArrow(_anchor_rows(c), "hash long, doc_id long, version long, at long"), "anchors")
    # written apart from the join, so that Spark can split a hot anchor's rows there
    twice = scratch.keep(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    hot = F.collect_list(F.when(F.col("n") > c.hot, F.col("at"))).alias("hot")
    again = scratch.keep(found.join(twice, "hash").groupBy("doc_id", "version").agg(F.collect_list("at").alias("at"), hot), "again")
    scratch.drop(found, twice)
    again = again.withColumnsRenamed({"doc_id": "d", "version": "v"})
    rows = versioned.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))).select("doc_id", "version", "text", "at", "hot")
    runs = scratch.keep(rows.sortWithinPartitions("doc_id", "version").mapInArrow(_sorted_runs(c, parts), _RUNS), "runs")
    known = runs.where("part is null").select("doc_id", "version", "begin", "stop")
    dealt = runs.where("part is not null").select("part", "cut", "run", "shared", "sizes", "rest", "lefts", "docs", "versions", "starts").repartition(parts, "part").sortWithinPartitions("part", "cut", "run")
    return known.unionByName(dealt.mapInArrow(_repeated(c), "doc_id long, version long, begin long, stop long"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, spans) with the bytes that are left, some texts at a time."""
    for batch in batches:
        column = texts(batch.column(1))
        for lo, hi in steps(column):
            sizes, removed, runs, kept = [], [], [], []
            for text, cuts in zip(column[lo:hi], batch.column(2)[lo:hi].to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                at, parts, n = 0, [], 0
                stop = -1
                for begin, end in sorted((x["begin"], x["stop"]) for x in cuts or []):
                    if begin > stop:
                        n += 1
                        parts.append(raw[at:begin])
                    stop = max(stop, end)
                    at = stop
                parts.append(raw[at:])
                left = b"".join(parts)
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                runs.append(n)
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, config: SuffixConfig | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for each row of docs; n_spans counts maximal removed runs."""
    scratch = Scratch(docs.sparkSession, "repeats")
    spans = repeated_spans(docs, config).groupBy("doc_id", "version").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    spans = scratch.keep(spans, "spans").withColumnsRenamed({"doc_id": "d", "version": "v"})
    versioned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    both = versioned.join(spans, (F.coalesce("doc_id", F.lit(_NONE)) == F.col("d")) & (F.col("version") == F.col("v")), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
