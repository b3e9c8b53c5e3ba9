"""MinHash near-duplicate groups with odd-sketch verification.

Each text's k MinHash samples serve twice: bands of them find candidates, and all of them are folded into an odd
sketch, a bitmap that keeps the parity of the samples that hash to each bit (Mitzenmacher, Pagh and Pham, 2014). The
population count of two sketches' XOR tells how many samples differ, which is precise where similarity is high, so that
few candidates need their full shingle sets compared. Links are confirmed on full sets only.

Groups of any size are handled without listing their pairs:

1. Texts with equal shingle sets are one class, counted before anything is shuffled.
2. Buckets (texts that share a band) are dealt out in blocks. Of each block only a spanning forest of likely pairs is
   confirmed, and confirmed links are joined to components.
3. Only pairs of different components are still open. Buckets that hold one component alone are done; in the others
   the largest component's blocks meet the rest's blocks, never each other. All open pairs whose sketches do not
   rule them out are confirmed.

A pair that shares several bands belongs to the first of them, so that it is looked at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, random_words, shingle_sets, texts
from .components import components


@dataclass(frozen=True)
class NearConfig:
    width: int = 5  #: words of a shingle
    percent: int = 80  #: link where 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 5  #: 32 bands of 5 rows miss a pair of similarity 0.8 with probability 3e-6
    samples: int = 640  #: MinHash samples in the odd sketch
    bits: int = 2048
    sigmas: float = 4.5  #: a sketch rules a pair out when its estimate is so many deviations below the limit
    block: int = 512  #: texts of a bucket that are compared in one step
    salts: int = 16  #: rows of a class of equal texts meet it in so many parts

    @property
    def most_bits(self) -> int:
        """Largest XOR population count of two sketches that may still belong to a link."""
        s = 2 * self.samples * (1 - self.percent / 100)
        n = self.bits
        spread = n / 4 * (1 - math.exp(-4 * s / n)) - s * math.exp(-4 * s / n)
        slope = math.exp(-2 * s / n)
        j = self.percent / 100
        deviation = math.sqrt(4 * self.samples * j * (1 - j) + max(spread, 0) / slope**2)
        return int(n / 2 * (1 - math.exp(-2 * (s + self.sigmas * deviation) / n))) + 1


def _minhash(sets: list[np.ndarray], c: NearConfig) -> np.ndarray:
    words = random_words(101, 2 * c.samples)
    flip, times = (words[: c.samples] >> np.uint64(32)).astype(np.uint32)[:, None], (words[c.samples :] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
    out = np.full((len(sets), c.samples), 0xFFFFFFFF, np.uint32)
    for k, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 1024):
            np.minimum(out[k], ((x[None, at : at + 1024] ^ flip) * times).min(1), out=out[k])
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set."""
    two = np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)), mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)], np.uint64)
    return tuple(mix(two).view(np.int64).tolist())


def _signatures(c: NearConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = random_words(202, c.rows)
        salt = random_words(303, c.bands)
        fold = (random_words(404, c.samples) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        shift = np.uint32(32 - int(math.log2(c.bits)))
        for batch in batches:
            found = list(shingle_sets(texts(batch.column(1)), c.width))
            for at in range(0, len(found), 512):
                sets = [s for _, s in found[at : at + 512]]
                m = _minhash(sets, c)
                b = m[:, : c.bands * c.rows].reshape(len(sets), c.bands, c.rows).astype(np.uint64)
                keys = mix((b * weights).sum(2, dtype=np.uint64) + salt).view(np.int64)
                place = ((m ^ np.arange(c.samples, dtype=np.uint32) * np.uint32(0x9E3779B1)) * fold) >> shift
                place = place.astype(np.int64) + np.arange(len(sets))[:, None] * c.bits
                odd = np.packbits((np.bincount(place.ravel(), minlength=len(sets) * c.bits) & 1).astype(np.uint8).reshape(len(sets), c.bits), axis=1)
                total = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sets)), batch.column(2).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(total[:, 0]), pa.array(total[:, 1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, c.bands, dtype=np.int32)), pa.array(keys.ravel())),
                        pa.array([x.tobytes() for x in odd], pa.binary()),
                    ],
                    ["uid", "version", "n_shingles", "d1", "d2", "bands", "sketch"],
                )

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups; rows come sorted by the first keys columns."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not t.num_rows:
            continue
        k = [t.column(i).to_numpy() for i in range(keys)]
        same = np.logical_and.reduce([x == x[-1] for x in k])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _pairs(c: NearConfig, forest: bool):
    """Pairs to confirm of each block or tile, from rows (key, block, side, band, node, component, bands, sketch).

    forest: of the likely pairs a minimum spanning forest by differing bits. Otherwise all pairs of different
    components, side 1 being the largest component, whose rows need not meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = c.most_bits
        for t in _groups(batches, 2):
            key, block = t.column(0).to_numpy(), t.column(1).to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            begins, ends = np.append(0, cuts), np.append(cuts, len(key))
            side, band, node, comp = (t.column(i).to_numpy() for i in (2, 3, 4, 5))
            bands = t.column(6).combine_chunks().flatten().to_numpy().reshape(-1, c.bands)
            sketch = np.frombuffer(b"".join(x.as_py() for x in t.column(7)), np.uint64).reshape(-1, c.bits // 64)
            out_a, out_b = [], []

            def own(i, j, b):
                return (bands[i] == bands[j]).argmax(-1) == b

            size = ends - begins
            two = begins[size == 2]  # most buckets hold two texts: all at once
            for at in range(0, len(two), 4096):
                i = two[at : at + 4096]
                j = i + 1
                good = (np.bitwise_count(sketch[i] ^ sketch[j]).sum(-1) <= limit) & own(i, j, band[i]) & (comp[i] != comp[j])
                out_a.append(node[i[good]])
                out_b.append(node[j[good]])
            for lo, hi in zip(begins[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                n = hi - lo
                for a in range(0, n, c.block if not forest else n):
                    a2 = min(n, a + c.block) if not forest else n
                    differ = np.empty((a2 - a, n), np.int32)
                    for x in range(a, a2, 32):
                        differ[x - a : x - a + 32] = np.bitwise_count(sketch[lo + x : min(lo + a2, lo + x + 32), None] ^ sketch[None, lo:hi]).sum(-1, dtype=np.int32)
                    open_ = (differ <= limit) & (comp[lo + a : lo + a2, None] != comp[None, lo:hi]) & (np.arange(a, a2)[:, None] != np.arange(n))
                    if not forest:
                        open_ &= (np.arange(a, a2)[:, None] < np.arange(n)) & ((side[lo + a : lo + a2, None] & side[None, lo:hi]) == 0)
                    i, j = np.nonzero(open_)
                    for s in range(0, len(i), 1 << 15):  # memory: 32 keys of each pair at once
                        k = slice(s, s + (1 << 15))
                        open_[i[k], j[k]] = own(lo + a + i[k], lo + j[k], band[lo])
                    if forest:
                        i, j = _forest(differ, open_)
                    else:
                        i, j = np.nonzero(open_)
                    out_a.append(node[lo + a + i])
                    out_b.append(node[lo + j])
            if out_a:
                x, y = np.concatenate(out_a), np.concatenate(out_b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return run


def _forest(differ: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest of the open pairs (Prim's way on a dense matrix)."""
    far = np.int32(1 << 30)
    cost = np.where(open_, differ, far)
    left = open_.any(1)
    best, source = np.full(len(cost), far), np.zeros(len(cost), np.int64)
    a, b = [], []
    while left.any():
        waiting = np.where(left, best, far)
        at = int(waiting.argmin())
        if waiting[at] == far:
            at = int(left.argmax())
        else:
            a.append(int(source[at]))
            b.append(at)
        left[at] = False
        closer = cost[at] < best
        best = np.where(closer, cost[at], best)
        source[closer] = at
    return np.array(a, np.int64), np.array(b, np.int64)


def _sets(c: NearConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full sets from rows (node, text, d1, d2); of rows that repeat an id only those with the class's digest."""
        for batch in batches:
            found = [s for _, s in shingle_sets(texts(batch.column(1)), c.width)]
            same = pa.array([_digest(s) == (a, b) for s, a, b in zip(found, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(same), pa.array([s.tobytes() for s in found], pa.binary()).filter(same)], ["node", "shingles"])

    return run


def _confirm(c: NearConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < c.percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                z = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                good.append(100 * both >= c.percent * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def near_groups(scratch: Scratch, docs: DataFrame, c: NearConfig) -> DataFrame:
    """(row, uid, version, n_shingles, component, first) for each row of docs (uid long, text string).

    row numbers the rows; version is the text's xxhash64; component is the smallest row of a class that links reach,
    first the first row of all of these (none, uid, row), none telling that it has no uid. Both are null where the text
    has no words. A null text counts as empty; rows may repeat a uid. Sets are sets of 64-bit shingle hashes.
    """
    docs = docs.toDF("uid", "text")
    sig = scratch.keep(docs.withColumn("version", F.xxhash64("text")).mapInArrow(_signatures(c), "uid long, version long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary").withColumn("row", F.monotonically_increasing_id()), "signatures")
    some = sig.where("n_shingles > 0")
    first = F.min(F.struct(F.col("uid").isNull().alias("none"), "uid", "row")).alias("first")
    classes = scratch.keep(some.groupBy("d1", "d2", "n_shingles").agg(F.min("row").alias("node"), F.count("*").alias("n"), first), "classes")
    nodes = classes.select(F.col("node").alias("row"))
    reps = sig.join(nodes, "row", "left_semi")

    buckets = reps.select("row", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch.keep(buckets.join(shared, "key").select("key", "n", "band", F.col("row").alias("node")), "members")
    sketches = scratch.keep(sig.select(F.col("row").alias("node"), "bands", "sketch").join(members.select("node").distinct(), "node", "left_semi"), "sketches", "none")
    wanted = sig.withColumnRenamed("row", "node").join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("uid").alias("u"), "d1", "d2")
    sets = scratch.keep(docs.join(wanted, F.col("uid").eqNullSafe(F.col("u"))).select("node", "text", "d1", "d2").mapInArrow(_sets(c), "node long, shingles binary"), "sets", "none")

    used = [members, sketches, sets]

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
        pairs = scratch.keep(pairs.distinct(), f"pairs-{name}")
        used.append(pairs)
        return scratch.keep(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(c), "a long, b long"), f"links-{name}")

    def compared(tiles: DataFrame, forest: bool) -> DataFrame:
        rows = tiles.join(sketches, "node").select("key", "block", "side", "band", "node", "component", "bands", "sketch")
        return rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_pairs(c, forest), "a long, b long")

    nblocks = F.ceil(F.col("n") / F.lit(c.block)).cast("long")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), nblocks))
    likely = confirmed(compared(dealt.withColumn("side", F.lit(0)).withColumn("component", F.col("node")), True), "likely")
    first_ = components(scratch, likely)

    # what is open: pairs of different components in one bucket
    known = members.join(first_, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = known.groupBy("key", "component").agg(F.count("*").alias("m"))
    mixed = counts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("top")).where("parts > 1")
    mixed = mixed.select("key", F.col("top.component").alias("largest"), F.ceil(F.col("top.m") / F.lit(c.block)).cast("long").alias("big"), F.ceil((F.col("all") - F.col("top.m")) / F.lit(c.block)).cast("long").alias("small"))
    at = known.join(mixed, "key").withColumn("side", F.when(F.col("component") == F.col("largest"), 1).otherwise(0))
    at = at.withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("side") == 1, F.col("big")).otherwise(F.col("small"))))
    # tiles of two blocks: 0..small*small-1 the rest with itself, then the rest with the largest component
    rest = F.col("small")
    inner = F.transform(F.sequence(F.lit(0).cast("long"), rest - 1), lambda k: F.least(F.col("own"), k) * rest + F.greatest(F.col("own"), k))
    outer = F.transform(F.sequence(F.lit(0).cast("long"), F.col("big") - 1), lambda k: rest * rest + k * rest + F.col("own"))
    larger = F.transform(F.sequence(F.lit(0).cast("long"), rest - 1), lambda k: rest * rest + F.col("own") * rest + k)
    tiles = at.withColumn("block", F.explode(F.when(F.col("side") == 1, larger).otherwise(F.concat(inner, outer))))
    found = confirmed(compared(tiles, False), "open")
    joint = found.join(first_.toDF("a", "ca"), "a", "left").join(first_.toDF("b", "cb"), "b", "left")
    second = components(scratch, joint.select(F.coalesce("ca", "a"), F.coalesce("cb", "b")))
    named = classes.join(first_.toDF("node", "c1"), "node", "left").withColumn("c1", F.coalesce("c1", "node")).join(second.toDF("c1", "c2"), "c1", "left").withColumn("component", F.coalesce("c2", "c1"))
    heads = scratch.keep(named.groupBy("component").agg(F.min("first").alias("first")), "heads")
    named = scratch.keep(named.drop("first").join(heads, "component").select("d1", "d2", "n_shingles", "node", "n", "component", "first"), "named")
    rows = sig.select("row", "uid", "version", "n_shingles", "d1", "d2")
    # the row that names its class needs no other column; of the others each meets its class in one of its parts
    own = rows.join(named.select(F.col("node").alias("row"), "component", "first"), "row", "left")
    own = scratch.keep(own, "own")
    spread = named.where("n > 1").select("d1", "d2", "n_shingles", "component", "first", F.explode(F.sequence(F.lit(0), F.lit(c.salts - 1))).alias("salt"))
    rest = own.where("component is null and n_shingles > 0").drop("component", "first").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(c.salts)).cast("int"))
    rest = rest.join(spread, ["d1", "d2", "n_shingles", "salt"])
    scratch.drop(*used)
    out = ("row", "uid", "version", "n_shingles", "component", "first")
    return own.where("component is not null or n_shingles = 0 or n_shingles is null").select(*out).unionByName(rest.select(*out))
