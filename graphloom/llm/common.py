"""Shared storage, batching and hashing for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a single longer document is one step.
STEP_BYTES = 1 << 19
#: Bytes of written tables behind one partition of a table that is made of them.
PART_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees. Only a local session without one (a test, a laptop) gets a local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Written tables that cut lineage: a lost executor rereads them instead of recomputing everything above.

    The session is told to drop a query's shuffle files once the query has ended.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def bytes(self, *tables: DataFrame) -> int:
        """Size of written tables on disk."""
        jvm, conf, total = self.spark._jvm, self.spark._jsc.hadoopConfiguration(), 0
        for t in tables:
            at = jvm.org.apache.hadoop.fs.Path(t._scratch_at)
            total += at.getFileSystem(conf).getContentSummary(at).getLength()
        return total

    def keep(self, df: DataFrame, name: str, codec: str = "zstd", of: tuple[DataFrame, ...] = ()) -> DataFrame:
        """df, written and reread; the shuffle files behind it go as soon as it is written.

        of: written tables that df is made of; where they are small, df is written in fewer, larger files.
        """
        at = self.path(name)
        if of:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-self.bytes(*of) // PART_BYTES)))
        df.write.option("compression", codec).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_at = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            at = jvm.org.apache.hadoop.fs.Path(t._scratch_at)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a DataFrame, by their metadata; sources that do not tell count nothing."""
    leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for k in range(leaves.size()):
        size = int(leaves.apply(k).stats().sizeInBytes())
        total += size if size < 1 << 60 else 0
    return total


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, computed once for each row: a lambda variable is not computed again where it is used."""
    return F.transform(F.array(value), body)[0]


def spare(taken: list[str], *names: str) -> list[str]:
    """The names, lengthened where a table has such a column."""
    known, out = {x.lower() for x in taken}, []
    for x in names:
        while x.lower() in known:
            x += "_"
        known.add(x.lower())
        out.append(x)
    return out


def packed(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(doc_id, text, rest), where rest holds all other columns, so that none can clash, and the way back to docs' columns."""
    names = [x for x in docs.columns if x not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{x}`") for x in names]) if names else F.lit(None).cast("int")

    def unpacked(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(x) if x in ("doc_id", "text") else F.col("rest").getField(x).alias(x) for x in docs.columns])

    return docs.select("doc_id", "text", rest.alias("rest")), unpacked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> pa.Array:
    """The column without nulls: a null text is an empty one."""
    return pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column with about limit bytes each, so that memory follows the longest text and not the batch."""
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, min(to, len(column))
        at = min(to, len(column))


def joined(column: pa.Array, lo: int, hi: int, sep: int = 10, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of rows lo to hi with width separators after each; where each row begins and ends in them."""
    raw = [x.as_buffer() for x in column[lo:hi]]
    pad = bytes([sep]) * width
    buf = np.frombuffer(b"".join(y for x in raw for y in (x if x is not None else b"", pad)), np.uint8)
    sizes = np.fromiter((x.size if x is not None else 0 for x in raw), np.int64, len(raw))
    ends = np.cumsum(sizes + width) - width
    return buf, ends - sizes, ends


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = random_words(11, 256)
_BYTE[_SPACE] = 0
_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """The first n powers of a fixed odd base modulo 2**64."""
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 2 * len(_POWERS[0])) - 1, 0x9E3779B97F4A7C15, np.uint64)]))
    return _POWERS[0][:n]


def word_hashes(buf: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of bytes that end in a separator."""
    space = _SPACE[buf]
    turns = np.flatnonzero(np.diff(np.concatenate([np.ones(1, np.int8), space.view(np.int8)])))
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    size = ends - starts
    place = np.arange(len(buf), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(buf)))) if starts[0] == 0 else np.arange(len(buf), dtype=np.int32) - np.concatenate([np.zeros(starts[0], np.int32), np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(buf))))])
    place[space] = 0
    value = _BYTE[_LOWER[buf] if lower else buf] * powers(int(size.max()) + 1)[place]
    return starts, ends, mix(np.add.reduceat(value, starts) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> list[np.ndarray]:
    """For each document (words first to last) its sorted distinct width-word shingles; fewer words make one, none make none."""
    c = random_words(23, width)
    n = len(words)
    full = mix(sum((words[t : n - width + 1 + t] * c[t] for t in range(width)), np.zeros(max(0, n - width + 1), np.uint64))) if n >= width else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.add.reduce(words[a:b] * c[: b - a], keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and shingle set of each text of a column."""
    for lo, hi in steps(column):
        buf, begin, end = joined(column, lo, hi)
        starts, _, words = word_hashes(buf)
        first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
        yield from zip(range(lo, hi), shingles(words, first, last, width), strict=True)
