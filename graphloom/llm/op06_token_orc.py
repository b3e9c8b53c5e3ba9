"""Operator 6: token ids in ORC files, and their reader."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _BYTE, _LOWER, _SPACE, Scratch, input_bytes, joined, mix, powers, steps, table, texts


@dataclass(frozen=True)
class TokenConfig:
    tokenizer: str = ""  #: path of a tokenizers file; empty: the public word_bpe_49k.json
    end_id: int = 2
    stride: int = 1000  #: rows of an index entry, the unit that a Bloom filter or a minimum and maximum can skip
    stripe_bytes: int = 16 << 20  #: stripes are read in parallel
    file_bytes: int = 256 << 20  #: input bytes of one output file, by the source's own statistics
    cache_words: int = 1 << 21  #: parts of words whose ids a worker remembers

    @property
    def path(self) -> str:
        if self.tokenizer:
            return self.tokenizer
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")


# What a tokenizer file says if it parts text at white space, letters, single digits and other characters,
# and changes nothing but composition and case.
PARTING_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PARTING_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Bytes of text that are encoded at once; in larger steps words repeat more.
STEP = 1 << 20
#: Parts of words in one call of the library.
CALL = 1024

# Classes of bytes: white space, ASCII letter, digit, other printable ASCII character, lead byte C3, anything else.
_GAP, _LETTER, _DIGIT, _MARK, _LEAD, _ODD = range(6)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[_SPACE] = _GAP
_KIND[0xC3] = _LEAD
_KIND[0x27] = _ODD  # an apostrophe may begin a part of its own


class _Tokenizer:
    """A tokenizers file, and whether words of its texts can be encoded apart, which the file's own rules decide."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        rules = json.loads(self.library.to_str())
        model, split = rules["model"], rules.get("pre_tokenizer") or {}
        first = (split.get("pretokenizers") or [{}])[0]
        self.apart = (
            rules.get("normalizer") == PARTING_NORMALIZER
            and split.get("type") == "Sequence"
            and [x.get("type") for x in split["pretokenizers"]] == ["Split", "ByteLevel"]
            and first.get("pattern") == {"Regex": PARTING_PATTERN}
            and (first.get("behavior"), first.get("invert")) == ("Removed", True)
            and (split["pretokenizers"][1].get("add_prefix_space"), split["pretokenizers"][1].get("use_regex")) == (False, False)
            and rules.get("post_processor") is None
            and model["type"] == "BPE"
            and not model.get("dropout")
            and bool(model.get("end_of_word_suffix"))
        )
        self.special = [x["content"].encode() for x in rules.get("added_tokens", [])]
        self.apart &= not any(x.get("normalized") or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in rules.get("added_tokens", []))
        if self.apart:
            suffix = model["end_of_word_suffix"]
            ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            ends[[i for x, i in model["vocab"].items() if x.endswith(suffix)]] = True
            self.ends = ends

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<i4")


_LOADED: dict[str, _Tokenizer] = {}


def _parts(buf: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, hash of each part of words, and whether it is a plain one, of bytes that end in white space.

    A word ``[^\\x20\\x09-\\x0D]+`` of ASCII letters, digits and marks and of the letters U+00C0 to U+00FF falls into runs
    of letters, single digits and runs of marks, which the tokenizer's pattern parts in the same way: these are plain.
    Any other word (an apostrophe, a control character, any other character, a special token) is one part.
    """
    kind = _KIND[buf]
    lead = np.flatnonzero(kind == _LEAD)
    if len(lead):
        after = buf[lead + 1]
        good = lead[(after != 0x97) & (after != 0xB7)]  # not the signs of multiplication and division
        kind[good] = kind[good + 1] = _LETTER
        kind[lead[(after == 0x97) | (after == 0xB7)]] = _ODD
    raw = buf.tobytes()
    for x in special:
        at = raw.find(x)
        while at >= 0:
            kind[at] = _ODD
            at = raw.find(x, at + 1)
    gap = kind == _GAP
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        edges = np.flatnonzero(gap)
        k = np.unique(np.searchsorted(edges, odd))
        a, b = np.where(k > 0, edges[k - 1] + 1, 0), edges[k]
        size = b - a
        kind[np.repeat(a - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] = _ODD
    new = np.append(True, kind[1:] != kind[:-1]) | (kind == _DIGIT)
    begins = np.flatnonzero(new)
    some = kind[begins] != _GAP
    ends = np.append(begins[1:], len(buf))[some]
    begins = begins[some]
    if not len(begins):
        return begins, ends, np.zeros(0, np.uint64), np.zeros(0, bool)
    size = ends - begins
    place = np.arange(len(buf), dtype=np.int32)
    place[begins[0] :] -= np.repeat(begins.astype(np.int32), np.diff(np.append(begins, len(buf))))
    place[gap] = 0
    place[: begins[0]] = 0
    value = _BYTE[np.where(kind == _LETTER, _LOWER[buf], buf)] * powers(int(size.max()) + 1)[place]
    plain = kind[begins] != _ODD
    return begins, ends, mix(np.add.reduceat(value, begins) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + plain.astype(np.uint64)), plain


class Words:
    """Ids of texts, part by part: the library encodes each distinct part of a word once, a memory of bounded size keeps it.

    The memory is flat arrays ordered by the parts' 64-bit hashes, about 40 bytes a part: a large table, and a small one
    that is merged into it whenever it has grown to a quarter.
    """

    def __init__(self, path: str, most: int):
        if path not in _LOADED:
            _LOADED[path] = _Tokenizer(path)
        self.rules, self.most = _LOADED[path], most
        self.tokenizer, self.apart = self.rules.library, self.rules.apart
        self.forget()

    def forget(self) -> None:
        nothing = lambda: [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.large, self.small = nothing(), nothing()
        self.flat, self.used = np.zeros(1 << 16, "<i4"), 0

    @staticmethod
    def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return [keys[order], *(np.concatenate([x, y])[order] for x, y in zip(a[1:], b[1:], strict=True))]

    def _known(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of ids of each part; -1 where it is not known."""
        start, size = np.full(len(distinct), -1), np.zeros(len(distinct), np.int64)
        for keys, starts, sizes in (self.large, self.small):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                hit = keys[at] == distinct
                start[hit], size[hit] = starts[at[hit]], sizes[at[hit]]
        return start, size

    def encode(self, column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts lo to hi one after another, and how many each has."""
        if not self.apart:
            found = [np.asarray(x.ids, "<i4") for x in self.tokenizer.encode_batch(column[lo:hi].to_pylist(), add_special_tokens=False)]
            return np.concatenate(found), np.fromiter(map(len, found), np.int64, hi - lo)
        buf, begin, end = joined(column, lo, hi)
        begins, ends, hashes, plain = _parts(buf, self.rules.special)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        start, size = self._known(distinct)
        new = np.flatnonzero(start < 0)
        if len(self.large[0]) + len(self.small[0]) + len(new) > self.most:
            self.forget()
            start, size = self._known(distinct)
            new = np.flatnonzero(start < 0)
        if len(new):
            raw, at = buf.tobytes(), first[new]
            ids, sizes = self._ids([raw[a:b].decode() for a, b in zip(begins[at].tolist(), ends[at].tolist(), strict=True)], plain[at])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            start[new], size[new] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used += len(ids)
            self.small = self._merged(self.small, [distinct[new], start[new], size[new]])
            if 4 * len(self.small[0]) > len(self.large[0]):
                self.large = self._merged(self.large, self.small)
                self.small = [x[:0] for x in self.small]
        count = size[back]
        place = np.cumsum(count) - count
        out = self.flat[np.repeat(start[back] - place, count) + np.arange(int(count.sum()))]
        upto = np.append(place, len(out))
        return out, upto[np.searchsorted(begins, end)] - upto[np.searchsorted(begins, begin)]

    def _ids(self, parts: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts one after another, and how many each has.

        A plain part is one token of the pattern. In ASCII it is its own byte-level form, which the model takes without
        the steps before; with other letters, many go to the library at once, with spaces between, and each one's last id
        alone ends a word. Any other part goes alone.
        """
        pieces: list = [None] * len(parts)
        model, other = self.tokenizer.model, []
        for k in np.flatnonzero(plain).tolist():
            if parts[k].isascii():
                pieces[k] = [x.id for x in model.tokenize(parts[k].lower())]
            else:
                other.append(k)
        for at in range(0, len(other), CALL):
            some = other[at : at + CALL]
            ids = self.rules.ids(" ".join([parts[k] for k in some]))
            stops = np.flatnonzero(self.rules.ends[ids]) + 1
            if len(stops) == len(some):
                begin = 0
                for k, stop in zip(some, stops.tolist(), strict=True):
                    pieces[k] = ids[begin:stop].tolist()
                    begin = stop
            else:  # a vocabulary in which some part has no word end
                for k in some:
                    pieces[k] = self.rules.ids(parts[k]).tolist()
        rest = np.flatnonzero(~plain).tolist()
        for k, found in zip(rest, self.tokenizer.encode_batch([parts[k] for k in rest], add_special_tokens=False), strict=True):
            pieces[k] = found.ids
        return np.fromiter(chain.from_iterable(pieces), "<i4"), np.fromiter(map(len, pieces), np.int64, len(pieces))


#: A worker process runs many tasks; what it has learnt stays with it.
_WORDS: dict[tuple[str, int], Words] = {}


def _encode(c: TokenConfig):
    path = c.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, text) as (doc_id, place in the file, n_tokens, ids)."""
        if (path, c.cache_words) not in _WORDS:
            _WORDS[path, c.cache_words] = Words(path, c.cache_words)
        words = _WORDS[path, c.cache_words]
        place = 0
        for batch in batches:
            column = texts(batch.column(1))
            for lo, hi in steps(column, STEP):
                found, count = words.encode(column, lo, hi)
                sizes = count + 1
                offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                ids = np.full(int(offsets[-1]), c.end_id, "<i4")
                ids[np.arange(len(found)) + np.repeat(np.arange(hi - lo), count)] = found
                n = hi - lo
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(np.arange(place, place + n)), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "place", "n_tokens", "ids"])
                place += n

    return run


def write_tokens(docs: DataFrame, path: str, config: TokenConfig | None = None) -> None:
    """Writes docs (doc_id long, text string) as ORC rows (doc_id, place, n_tokens, ids), ascending by doc_id over the files.

    ORC's integer run-length encoding packs ids; each stripe has row indexes, and Bloom filters of doc_id, so that a
    reader of some documents skips files, stripes and row groups by metadata alone. Null texts are empty and get the
    end id alone; null doc_ids come first; rows that repeat a doc_id are kept, by text; an empty table writes no rows.
    """
    c = config or TokenConfig()
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // c.file_bytes))
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = ranged.mapInArrow(_encode(c), "doc_id long, place long, n_tokens long, ids array<int>")
    options = {"compression": "zstd", "orc.row.index.stride": str(c.stride), "orc.stripe.size": str(c.stripe_bytes), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    rows.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """Rows of the files; a condition on doc_id (wanted) reaches the reader, which prunes by row index and Bloom filter."""
    rows = spark.read.schema("doc_id long, place long, n_tokens long, ids array<int>").orc(path)
    return rows if wanted is None else rows.where(wanted)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CRC-32 of each document's ids as little-endian unsigned 32-bit integers."""
    for batch in batches:
        column = batch.column(3)
        flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
        raw = memoryview(np.ascontiguousarray(flat.astype("<u4"))).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64()), batch.column(4)], ["doc_id", "place", "n_tokens", "ids_crc32", "file"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; start is the number of ids of all rows before."""
    scratch = Scratch(spark, "tokens")
    files = read_tokens(spark, path).select("*", F.col("_metadata.file_path").alias("file"))
    rows = scratch.keep(files.mapInArrow(_crc, "doc_id long, place long, n_tokens long, ids_crc32 long, file string"), "digests")
    # a row for each file, whose number is that of the writer's partitions
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("first")).collect()
    before, at = [], 0
    for r in sorted(totals, key=lambda r: (r["first"] is not None, r["first"])):
        before.append((r["file"], at))
        at += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "file string, before long"))
    inside = F.sum("n_tokens").over(W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    out = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, "file")
    return out.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "orc").path("ids")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digest(spark, path)
