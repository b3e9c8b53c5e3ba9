"""Operator 3: benchmark passages with edits, by the pigeonhole principle and Myers' bit-parallel distance."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, joined, steps, table, texts


@dataclass(frozen=True)
class LeakConfig:
    edits_percent: int = 8  #: error budget of an item, in hundredths of its normalised length
    block_bytes: int = 2 << 20  #: benchmark text that one pass over the documents looks for; more items take more passes
    blocks: int = 4  #: passes of one plan; of a larger benchmark the hits of so many blocks at a time are written
    broadcast_bytes: int = 32 << 20  #: written hits that are broadcast; more meet their texts in salted parts
    salts: int = 16


_KEEP = np.full(256, 32, np.uint8)
for _lo, _hi, _to in ((48, 58, 48), (97, 123, 97), (65, 91, 97), (0x80, 0x100, 0x80)):
    _KEEP[_lo:_hi] = np.arange(_to, _to + _hi - _lo)


def normalised(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; a run of ASCII characters that are no letters or digits as one space. Line feeds (width 2) between texts stay cut marks."""
    x = _KEEP[buf]
    gap = x == 32
    return x[~(gap & np.append(False, gap[:-1]))]


def normalise(text: str | None) -> bytes:
    return normalised(np.frombuffer((text or "").encode(), np.uint8)).tobytes().strip(b" ")


def budget(item: bytes, percent: int) -> int:
    """Edits that an item of normalised bytes may have; at 8 % items of up to 12 bytes have none."""
    return len(item) * percent // 100


def pieces(item: bytes, k: int) -> list[tuple[int, bytes]]:
    """Error budget plus one pieces of nearly equal length, with their places: so many edits leave one of them whole."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern_bits: list[int], m: int, text: bytes, limit: int) -> int:
    """Least edit distance of the pattern to any part of text, or limit + 1 (Myers, 1999, on long integers)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for ch in text:
        eq = pattern_bits[ch]
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        plus = ((mh << 1) & full) | (full & ~(xv | ph))
        minus = ph & xv
    return min(best, limit + 1)


class Items:
    """Benchmark items (id, normalised text) as one automaton of all their pieces.

    Items and texts have a space at both ends, so that an item is found between spaces only and never inside a word.
    """

    def __init__(self, items: list[tuple[int, bytes]], percent: int):
        import ahocorasick

        self.ids = [i for i, _ in items]
        self.budgets = [budget(x, percent) for _, x in items]
        self.texts = [b" " + x + b" " for _, x in items]
        where: dict[bytes, list[tuple[int, int]]] = {}
        for n, (item, k) in enumerate(zip(self.texts, self.budgets, strict=True)):
            for at, piece in pieces(item, k):
                where.setdefault(piece, []).append((n, at))
        self.machine = ahocorasick.Automaton()
        for piece, at in where.items():
            self.machine.add_word(piece.decode("latin-1"), (len(piece), at))
        self.machine.make_automaton()
        self.bits = []
        for item in self.texts:
            row = [0] * 256
            for i, ch in enumerate(item):
                row[ch] |= 1 << i
            self.bits.append(row)

    def inside(self, text: bytes) -> dict[int, int]:
        """Item ids in a normalised text with their least distances within the budgets."""
        text = b" " + text.strip(b" ") + b" "
        tried: set[tuple[int, int]] = set()
        found: dict[int, int] = {}
        for last, (size, places) in self.machine.iter(text.decode("latin-1")):
            for n, at in places:
                item, k = self.texts[n], self.budgets[n]
                begin = last + 1 - size - at
                if found.get(n) == 0 or (n, begin) in tried:
                    continue
                tried.add((n, begin))
                if begin >= 0 and text.startswith(item, begin):
                    found[n] = 0
                elif k:
                    d = myers(self.bits[n], len(item), text[max(0, begin - k) : begin + len(item) + k], k)
                    if d <= k:
                        found[n] = min(d, found.get(n, d))
        least: dict[int, int] = {}
        for n, d in found.items():
            least[self.ids[n]] = min(d, least.get(self.ids[n], d))
        return least


def leaks(text: bytes, items: list[tuple[int, bytes]], percent: int) -> dict[int, int]:
    return Items(items, percent).inside(text)


#: The last block's automaton: a worker's tasks of one pass share it.
_BUILT: dict[str, Items] = {}


def _look(items: list[tuple[int, bytes]], percent: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds what a block of items finds to the last two columns (item ids, distances); text is column 0."""
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Items(items, percent)
        built = _BUILT[name]
        for batch in batches:
            column, n = texts(batch.column(0)), batch.num_columns
            had = [dict(zip(a, b, strict=True)) for a, b in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist(), strict=True)]
            for lo, hi in steps(column):
                for k in range(lo, hi):
                    buf, _, _ = joined(column, k, k + 1, sep=32)
                    for item, d in built.inside(normalised(buf).tobytes()).items():
                        had[k][item] = min(d, had[k].get(item, d))
            ids = [sorted(x) for x in had]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(ids, pa.list_(pa.int64())), pa.array([[x[i] for i in y] for x, y in zip(had, ids, strict=True)], pa.list_(pa.int32()))], batch.schema.names)

    return run


def _blocks(benchmark: DataFrame, most: int, scratch: Scratch) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of so many bytes. They are written first: rows that are read one by one must not wait on a shuffle,
    whose files may go before the last row is read."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    held, size = [], 0
    for r in scratch.keep(rows, "items").toLocalIterator():
        if item := normalise(r["text"]):
            held.append((r["item_id"], item))
            size += len(item)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _key(text: str = "text") -> list:
    """128 bits of a text: what a text holds depends on it alone."""
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")]


def contaminated(docs: DataFrame, benchmark: DataFrame, config: LeakConfig | None = None) -> DataFrame:
    """docs with item_ids (sorted long array) and distances (int array): the benchmark items that each text holds within their budgets.

    docs has text, benchmark has item_id and text. Every column of docs comes through; columns of docs that are called
    item_ids or distances are replaced. Null and empty texts hold nothing; null, empty or wordless items are left
    out; rows that repeat are judged each; a very long text is one step, so memory follows the longest; an empty
    benchmark gives empty arrays, an empty table no rows. An item is found between spaces of the normalised text only;
    items of up to 12 bytes have no error budget. Each block of items, bounded in bytes, is one narrow pass over all
    documents; a benchmark of more blocks than one plan takes has its hits written by text and joined to the documents.
    """
    c = config or LeakConfig()
    names = [x for x in docs.columns if x not in ("item_ids", "distances")]
    none = [F.expr("cast(array() as array<bigint>)").alias("item_ids"), F.expr("cast(array() as array<int>)").alias("distances")]
    scratch = Scratch(docs.sparkSession, "leaks")
    blocks = _blocks(benchmark, c.block_bytes, scratch)
    first = list(islice(blocks, c.blocks))

    def looked(rows: DataFrame, some: list) -> DataFrame:
        for items in some:
            rows = rows.mapInArrow(_look(items, c.edits_percent), rows.schema)
        return rows

    more = list(islice(blocks, c.blocks))
    if not more:
        order = ["text", *(x for x in names if x != "text")]
        return looked(docs.select(*order, *none), first).select(*names, "item_ids", "distances")
    hits, some = None, first
    while some:  # a larger benchmark: only the texts that hold something are written, never the corpus
        found = looked(docs.select("text", *none), some).where(F.size("item_ids") > 0)
        found = scratch.keep(found.select(*_key(), F.explode(F.arrays_zip("item_ids", "distances")).alias("x")).select("a", "b", "x.item_ids", "x.distances").distinct(), "hits")
        hits = found if hits is None else hits.unionByName(found)
        some, more = more, list(islice(blocks, c.blocks))
    least = hits.groupBy("a", "b", "item_ids").agg(F.min("distances").alias("d"))
    held = least.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("item_ids", "d"))).alias("x"))
    held = scratch.keep(held.select(F.col("a").alias("a_"), F.col("b").alias("b_"), F.transform("x", lambda x: x["item_ids"]).alias("item_ids"), F.transform("x", lambda x: x["d"]).alias("distances")), "held")
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in names]).alias("rest"), *_key())  # other columns are inside rest
    same = (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_"))
    if scratch.bytes(held) <= c.broadcast_bytes:
        both = rows.join(F.broadcast(held), same, "left")
    else:
        spread = held.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(c.salts - 1))))
        both = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(c.salts)).cast("int")).join(spread.hint("merge"), same & (F.col("salt") == F.col("salt_")), "left")
    return both.select("rest.*", *[F.coalesce(n, x).alias(n) for n, x in zip(("item_ids", "distances"), none, strict=True)])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "distances")
