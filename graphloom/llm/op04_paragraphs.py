"""Operator 4: near-duplicate paragraphs by MinHash bands, exact Jaccard and components.

Paragraphs are the lines of a text that hold a word. They are compared by MinHash bands, which find 99.7 % of the pairs
at a similarity of 0.8 and more of those above (8 bands of 3 rows), and confirmed on full sets of 64-bit shingle hashes.
No paragraph is too short: one with fewer words than a shingle is one shingle. Two unequal sets of less than four
shingles can't reach 0.8, so only paragraphs with ``least`` shingles or more get bands, in the one pass that parses the
texts. Buckets of two give pairs; larger ones are compared in blocks.

Passages inside paragraphs, which a copy may have put into another paragraph, are compared for equality: each sentence,
which ends at ``.``, ``!`` or ``?`` before white space, with as many of the next ones of its line as make
``passage_words`` words. Equal paragraphs and passages are one class, by 128 bits of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, joined, mix, random_words, steps, table, texts, word_hashes
from .components import components
from .near import _confirm, _groups
from .op05_suffix_dedup import _NONE, _cut


@dataclass(frozen=True)
class ParagraphConfig:
    passage_words: int = 8  #: sentences of a line are joined until they have so many words
    width: int = 5  #: words of a shingle
    percent: int = 80  #: link where 100 * intersection >= percent * union
    bands: int = 8
    rows: int = 3
    block: int = 512  #: units of a bucket that are compared at once
    salts: int = 16  #: a hot unit's occurrences meet its first one in so many parts
    seen: int = 1 << 18  #: paragraphs that a task remembers to give their bands once

    @property
    def least(self) -> int:
        """Shingles of the smaller one of two unequal sets that may link."""
        n = 1
        while 100 * n < self.percent * (n + 1):
            n += 1
        return n


_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_FACTORS: dict[int, np.ndarray] = {}


def _factors(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2**64."""
    if len(_FACTORS.get(base, ())) < n:
        _FACTORS[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base, np.uint64)]))
    return _FACTORS[base][:n]


def digests(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """128 bits of each range of words, as two arrays: polynomial hashes from running sums, so ranges may overlap."""
    out = []
    for k, base in enumerate(_BASES):
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(words + np.uint64(k)) * _factors(base, len(words))))
        back = _factors(pow(base, -1, 1 << 64), len(words) + 1)
        out.append(mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64)).view(np.int64))
    return out


def units(buf: np.ndarray, begin: np.ndarray, c: ParagraphConfig) -> tuple:
    """Word hashes; for each unit its text's number, first and last word, and byte range; number of paragraphs, which come before the passages."""
    starts, ends, words = word_hashes(buf)
    if not len(words):
        none = np.zeros(0, np.int64)
        return words, none, none, none, none, none, 0
    line = np.cumsum(buf == 10)[starts]
    new_line = np.append(True, line[1:] != line[:-1])
    stop = np.isin(buf[ends - 1], np.frombuffer(b".!?", np.uint8))
    lines = np.flatnonzero(new_line)
    lines_end = np.append(lines[1:], len(words))
    opens = np.flatnonzero(new_line | np.append(True, stop[:-1]))
    closes = np.append(opens[1:], len(words))
    at = np.minimum(np.searchsorted(closes, opens + c.passage_words), len(closes) - 1)
    to, own = closes[at], np.searchsorted(lines, opens, "right") - 1
    good = (to - opens >= c.passage_words) & (to <= lines_end[own]) & ~((opens == lines[own]) & (to == lines_end[own]))
    first, last = np.concatenate([lines, opens[good]]), np.concatenate([lines_end, to[good]])
    return words, np.searchsorted(begin, starts[first], "right") - 1, first, last, starts[first], ends[last - 1], len(lines)


def _shingles(words: np.ndarray, c: ParagraphConfig) -> np.ndarray:
    """The shingle that begins at each word, where there is room for one."""
    k, n = random_words(61, c.width), max(0, len(words) - c.width + 1)
    return mix(sum((words[t : n + t] * k[t] for t in range(c.width)), np.zeros(n, np.uint64)))


def band_keys(words: np.ndarray, first: np.ndarray, last: np.ndarray, c: ParagraphConfig) -> np.ndarray:
    """A row of band keys for each paragraph of words first to last; all hold a shingle, and none overlap."""
    seeds, weight, salt = random_words(62, c.bands * c.rows), random_words(63, c.rows), random_words(64, c.bands)
    full = _shingles(words, c)
    order = np.lexsort((last, first))
    ranges = np.stack([first[order], last[order] - c.width + 1], 1).ravel()
    out = np.empty((len(first), c.bands), np.uint64)
    for b in range(c.bands):
        key = np.full(len(first), salt[b], np.uint64)
        for r in range(c.rows):
            h = np.append(mix(full ^ seeds[b * c.rows + r]), np.uint64(0))
            key += np.minimum.reduceat(h, ranges)[::2] * weight[r]
        out[order, b] = mix(key)
    return out


def _unit_rows(c: ParagraphConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, version, text) as (d1, d2, doc_id, version, begin, stop, bands); bands of passages, and of a paragraph seen before, are null."""
        seen: set[int] = set()
        for batch in batches:
            column = texts(batch.column(2))
            for lo, hi in steps(column):
                buf, begin, _ = joined(column, lo, hi)
                words, doc, first, last, a, b, n = units(buf, begin, c)
                if not len(words):
                    continue
                d1, d2 = digests(words, first, last)
                new = np.zeros(len(d1), bool)
                distinct, where = np.unique(d1[:n], return_index=True)
                long = last[where] - first[where] - c.width + 1 >= c.least
                fresh = [i for i, x in zip(where[long].tolist(), distinct[long].tolist(), strict=True) if x not in seen]
                new[fresh] = True
                if len(seen) + len(fresh) > c.seen:
                    seen.clear()
                seen.update(d1[fresh].tolist())
                keys = band_keys(words, first[new], last[new], c).view(np.int64).ravel()
                offsets = np.append(0, np.cumsum(np.where(new, c.bands, 0))).astype(np.int32)
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(d1), pa.array(d2), batch.column(0).take(take), batch.column(1).take(take), pa.array(a - begin[doc]), pa.array(b - begin[doc]),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys), mask=pa.array(~new)),
                    ],
                    ["d1", "d2", "doc_id", "version", "begin", "stop", "bands"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, unit), sorted, as the distinct rows of the keys that two units or more have."""
    key = unit = None  # the last row, and whether it was given out
    given = False
    for batch in batches:
        k, u = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        same_key = np.append(key is not None and k[0] == key, k[1:] == k[:-1])
        new = ~(same_key & np.append(unit is not None and u[0] == unit, u[1:] == u[:-1]))
        second = same_key & new  # another unit of the key before: it and the one before are wanted
        out = second.copy()
        at = np.flatnonzero(second)
        before = np.flatnonzero(new)
        prior = np.searchsorted(before, at) - 1
        out[before[prior[prior >= 0]]] = True
        ks, us = k[out], u[out]
        if (prior < 0).any() and not given:  # the one before ended the batch before
            ks, us = np.append(ks, key), np.append(us, unit)
        if len(before):
            given = bool(out[before[-1]])
        key, unit = k[-1], u[-1]
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(us, pa.int64())], ["key", "unit"])


def _sets(c: ParagraphConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (text, wanted paragraphs) as (node, sorted distinct shingles)."""
        for batch in batches:
            column, wanted = texts(batch.column(0)), batch.column(1)
            for lo, hi in steps(column):
                buf, begin, _ = joined(column, lo, hi)
                starts, _, words = word_hashes(buf)
                full, nodes, out = _shingles(words, c), [], []
                for k in range(lo, hi):
                    for x in wanted[k].as_py():
                        a, b = np.searchsorted(starts, [begin[k - lo] + x["begin"], begin[k - lo] + x["stop"]])
                        nodes.append(x["node"])
                        out.append(np.unique(full[a : b - c.width + 1]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], ["node", "shingles"])

    return run


def _links(c: ParagraphConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, block, side, node, component, shingles), sorted, as links between different components of each block, enough to join what its links join.

        Rows of side 1 are not compared with each other.
        """
        for t in _groups(batches, 2):
            key, block = t.column(0).to_numpy(), t.column(1).to_numpy()
            cuts = np.append(np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1, len(key)).tolist()
            side, node, comp = (t.column(i).to_numpy() for i in (2, 3, 4))
            column, out, lo = t.column(5).combine_chunks(), [], 0
            for hi in cuts:
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in column[lo:hi]]
                linked = _few if hi - lo <= 32 else _many
                out += [(int(node[lo + i]), int(node[lo + j])) for i, j in linked(sets, comp[lo:hi].tolist(), side[lo:hi].tolist(), c.percent)]
                lo = hi
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _joined(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _few(sets: list[np.ndarray], comp: list, side: list, percent: int) -> Iterator[tuple[int, int]]:
    """Links of a small block, one pair at a time; pairs that are joined already are not compared."""
    parent = {x: x for x in comp}
    for i in range(1, len(sets)):
        for j in range(i):
            m, n = len(sets[i]), len(sets[j])
            if (side[i] and side[j]) or 100 * min(m, n) < percent * max(m, n) or (a := _joined(parent, comp[i])) == (b := _joined(parent, comp[j])):
                continue
            z = np.sort(np.concatenate([sets[i], sets[j]]), kind="stable")
            both = int((z[1:] == z[:-1]).sum())
            if 100 * both >= percent * (m + n - both):
                parent[a] = b
                yield i, j


def _many(sets: list[np.ndarray], comp: list, side: list, percent: int) -> Iterator[tuple[int, int]]:
    """Links of a larger block: all intersection sizes by matrix products over slices of the shingles."""
    n, size = len(sets), np.array([len(x) for x in sets])
    row = np.repeat(np.arange(n), size)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    place = (np.cumsum(often) - 1)[at]
    row, place = row[often[at]], place[often[at]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    both = np.zeros((n, n), np.int64)
    total = int(often.sum())
    for lo in range(0, total, 4096):
        a, b = np.searchsorted(place, lo), np.searchsorted(place, lo + 4096)
        x = np.zeros((n, min(4096, total - lo)), np.float32)
        x[row[a:b], place[a:b] - lo] = 1
        both += (x @ x.T).astype(np.int64)
    near = 100 * both >= percent * (size[:, None] + size[None] - both)
    sides = np.array(side, bool)
    near &= ~(sides[:, None] & sides[None])
    parent = {x: x for x in comp}
    for i in range(1, n):
        for j in np.flatnonzero(near[i, :i]).tolist():
            if (a := _joined(parent, comp[i])) != (b := _joined(parent, comp[j])):
                parent[a] = b
                yield i, j


def near_units(scratch: Scratch, docs: DataFrame, rows: DataFrame, c: ParagraphConfig) -> DataFrame:
    """(d1, d2, c1, c2): digests of units that are near-duplicates of others, each with its component's digest, but the component's own."""
    keys = rows.where("bands is not null").select(F.explode("bands").alias("key"), F.col("d1").alias("unit"))
    n = keys.sparkSession.conf.get("spark.sql.shuffle.partitions")
    members = scratch.keep(keys.repartition(int(n), "key").sortWithinPartitions("key", "unit").mapInArrow(_shared, "key long, unit long"), "members", of=(rows,))
    some = rows.where("bands is not null").join(members.select(F.col("unit").alias("d1")).distinct(), "d1", "left_semi")
    some = scratch.keep(some.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "doc_id", "version", "begin", "stop"), "candidates", of=(rows,))
    classes = scratch.keep(some.groupBy("d1", "d2").agg(F.min("node").alias("node")), "classes", of=(some,))
    wanted = some.join(classes.select("node"), "node", "left_semi").groupBy("doc_id", "version").agg(F.collect_list(F.struct("node", "begin", "stop")).alias("wanted"))
    texts_ = docs.join(wanted.withColumnsRenamed({"doc_id": "d", "version": "v"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")))
    # rows that repeat a document give a set again, which only joins a node with itself
    sets = scratch.keep(texts_.select("text", "wanted").mapInArrow(_sets(c), "node long, shingles binary"), "sets", "none")
    members_ = scratch.keep(members.join(classes.select(F.col("d1").alias("unit"), "node"), "unit").select("key", "node"), "nodes", of=(members, classes))
    scratch.drop(members, some)

    # buckets of the same units, which near copies share, are looked at once
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    buckets = members_.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), *marks)
    buckets = scratch.keep(buckets.where("n > 1").groupBy("n", "a", "b", "m1", "m2").agg(F.min("key").alias("key")), "buckets", of=(members_,))
    pairs = buckets.where("n = 2").select("a", "b")
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    twos = scratch.keep(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(c), "a long, b long"), "twos", of=(sets, sets, buckets))
    large = scratch.keep(members_.join(buckets.where("n > 2").select("key", "n"), "key"), "large", of=(members_,))

    def compared(tiles: DataFrame) -> DataFrame:
        full = tiles.join(sets, "node").select("key", "block", "side", "node", "component", "shingles")
        return full.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_links(c), "a long, b long")

    dealt = large.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("n") / c.block)).cast("long"))
    likely = scratch.keep(compared(dealt.withColumn("side", F.lit(0)).withColumn("component", F.col("node"))), "likely", of=(sets, sets, large))
    first = components(scratch, twos.unionByName(likely), of=(twos, likely))
    # buckets of several blocks: the rest's blocks meet each other and those of the largest component
    open_ = large.where(F.col("n") > c.block).join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = open_.groupBy("key", "component").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("top")).where("parts > 1")
    mixed = mixed.select("key", F.col("top.component").alias("largest"), F.ceil(F.col("top.m") / c.block).cast("long").alias("big"), F.ceil((F.col("all") - F.col("top.m")) / c.block).cast("long").alias("rest"))
    at = open_.join(mixed, "key").withColumn("side", F.when(F.col("component") == F.col("largest"), 1).otherwise(0))
    at = at.withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("side") == 1, F.col("big")).otherwise(F.col("rest"))))
    rest, zero = F.col("rest"), F.lit(0).cast("long")
    inner = F.transform(F.sequence(zero, rest - 1), lambda k: F.least(F.col("own"), k) * rest + F.greatest(F.col("own"), k))
    outer = F.transform(F.sequence(zero, F.col("big") - 1), lambda k: rest * rest + k * rest + F.col("own"))
    larger = F.transform(F.sequence(zero, rest - 1), lambda k: rest * rest + F.col("own") * rest + k)
    tiles = at.withColumn("block", F.explode(F.when(F.col("side") == 1, larger).otherwise(F.concat(inner, outer))))
    more = scratch.keep(compared(tiles), "more", of=(sets, sets, large))
    scratch.drop(sets, members_, buckets, large, likely, twos)
    linked = more.join(first.toDF("a", "ca"), "a", "left").join(first.toDF("b", "cb"), "b", "left")
    second = components(scratch, linked.select(F.coalesce("ca", "a"), F.coalesce("cb", "b")), of=(more, first)).toDF("c1", "c2")
    nodes = first.select("node").union(second.select("c1")).distinct().join(first, "node", "left").withColumn("c1", F.coalesce("component", "node")).drop("component")
    found = nodes.join(second, "c1", "left").select("node", F.coalesce("c2", "c1").alias("component")).where("node <> component")
    heads = classes.select(F.col("node").alias("component"), F.col("d1").alias("c1"), F.col("d2").alias("c2"))
    return scratch.keep(found.join(classes, "node").join(heads, "component").select("d1", "d2", "c1", "c2"), "near", of=(classes,))


def repeated_paragraphs(docs: DataFrame, config: ParagraphConfig | None = None) -> DataFrame:
    """docs' rows as (doc_id, text, spans): byte ranges of paragraphs and passages that are near-duplicates of an earlier one.

    A unit repeats one of its component that lies in an earlier document (smaller doc_id) or ends before it begins, so
    the first one stays. Nulls and
    texts without a word have no spans; rows with one doc_id and one text are one document, with different texts
    several, in the order of their hashes; a null doc_id comes first; a very long text is parsed in one step, so memory
    follows the longest one; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    c = config or ParagraphConfig()
    scratch = Scratch(docs.sparkSession, "paragraphs")
    versioned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    made = versioned.mapInArrow(_unit_rows(c), "d1 long, d2 long, doc_id long, version long, begin long, stop long, bands array<long>")
    rows = scratch.keep(made.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NONE))), "units")
    known = versioned.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NONE)))
    near = near_units(scratch, known, rows, c)
    counts = rows.groupBy("d1", "d2").agg(F.count("*").alias("n"))
    named = counts.join(near, ["d1", "d2"], "left").select("d1", "d2", "n", F.coalesce("c1", "d1").alias("c1"), F.coalesce("c2", "d2").alias("c2"))
    # a unit that occurs once and is nobody's near-duplicate is done; a component's own digest is in near's c1 and c2
    heads = near.select(F.col("c1").alias("d1"), F.col("c2").alias("d2")).distinct().withColumn("head", F.lit(True))
    named = named.join(heads, ["d1", "d2"], "left").where((F.col("n") > 1) | (F.col("d1") != F.col("c1")) | (F.col("d2") != F.col("c2")) | F.col("head"))
    named = scratch.keep(named.select("d1", "d2", "c1", "c2"), "repeated", of=(rows,))
    salts = F.explode(F.sequence(F.lit(0), F.lit(c.salts - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("doc_id", "version", "begin"), F.lit(c.salts)).cast("int")
    place = rows.select("d1", "d2", "doc_id", "version", "begin", "stop", salt.alias("salt"))
    again = scratch.keep(place.join(named.select("*", salts), ["d1", "d2", "salt"]).drop("d1", "d2"), "occurrences", of=(rows, named))
    scratch.drop(rows, near, named)
    first = F.min(F.struct("doc_id", "version", "stop")).alias("first")
    firsts = scratch.keep(again.groupBy("c1", "c2").agg(first), "firsts", of=(again,)).select("*", salts)
    # a paragraph and a passage of its own may be alike: neither repeats the other
    apart = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("version") != F.col("first.version")) | (F.col("begin") >= F.col("first.stop"))
    spans = again.join(firsts, ["c1", "c2", "salt"]).where(apart).groupBy("doc_id", "version").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))
    found = scratch.keep(spans, "spans", of=(again,)).withColumnsRenamed({"doc_id": "d", "version": "v"})
    scratch.drop(again)
    both = versioned.join(found, (F.coalesce("doc_id", F.lit(_NONE)) == F.col("d")) & (F.col("version") == F.col("v")), "left")
    return both.select("doc_id", "text", "spans")


def without_repeated_paragraphs(docs: DataFrame, config: ParagraphConfig | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, n_bytes, n_removed, n_spans, kept binary) of each row: paragraphs are lines with a word, spans maximal removed runs of bytes."""
    return repeated_paragraphs(docs, config).mapInArrow(_kept, "doc_id long, n_paragraphs long, n_bytes long, n_removed long, n_spans long, kept binary")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut, (lo, hi) in zip(_cut(iter([batch])), steps(texts(batch.column(1))), strict=True):
            buf, begin, _ = joined(texts(batch.column(1)), lo, hi)
            starts, _, _ = word_hashes(buf)
            line = np.cumsum(buf == 10)[starts]
            first = starts[np.append(True, line[1:] != line[:-1])] if len(starts) else starts
            n = np.bincount(np.searchsorted(begin, first, "right") - 1, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(n, pa.int64()), *cut.columns[1:]], ["doc_id", "n_paragraphs", "n_bytes", "n_removed", "n_spans", "kept"])


def op4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_paragraphs(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_paragraphs", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
