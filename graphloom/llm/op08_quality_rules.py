"""Operator 8: quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class LineConfig:
    max_docs: int = 30  #: a normalised line in more documents of a host, and in more than
    max_per_mille: int = 1  #: so many thousandths of them, is boilerplate
    min_left_percent: int = 50  #: a document that keeps a smaller part of its words is depleted
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    salts: int = 16  #: a hot line's rows meet its count in so many parts


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _GAP), lambda w: w != "")


def _repeat_words(words: Column, c: LineConfig) -> Column:
    """Words inside a window that the text has twice or more: sorted window hashes put equal ones side by side."""
    k = c.window

    def covered(at: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0).cast("long"), lambda sum_, j: sum_ + F.least(F.lit(k), F.coalesce(F.get(at, j + 1) - F.get(at, j), F.lit(k))))

    def repeated(s: Column) -> Column:
        at = F.filter(F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"])), lambda x: x.isNotNull())
        return let(F.array_sort(at), covered)

    def counted(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, repeated))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))

    return F.when(F.size(words) < k, F.lit(0).cast("long")).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), hashes), counted))


def _judged(docs: DataFrame, config: LineConfig | None, host: str) -> tuple[DataFrame, DataFrame]:
    """Verdicts with version and place, which tell rows of one doc_id apart, and gone_at, the numbers of the boilerplate lines; and those lines."""
    c = config or LineConfig()
    scratch = Scratch(docs.sparkSession, "quality")
    text = F.coalesce("text", F.lit(""))
    place = F.coalesce(F.col(host).cast("string"), F.lit("\0"))

    def normal(line: Column) -> Column:
        return F.translate(F.array_join(_words(line), " "), _UPPER, _LOWER)

    def measured(lines: Column) -> Column:
        return F.struct((F.size(lines) - F.size(F.array_distinct(F.transform(lines, lambda x: x["x"])))).cast("long").alias("dup"), F.transform(lines, lambda x: F.struct(F.xxhash64(normal(x["x"])).alias("line"), F.size(_words(x["x"])).alias("words"), x["i"].alias("i"))).alias("rows"))

    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    lines = F.filter(lines, lambda x: F.length(F.regexp_replace(x["x"], _GAP, "")) > 0)
    counts = lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w, c).alias("repeat"))
    base = docs.select("doc_id", text.alias("text"), place.alias("place")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.xxhash64("text").alias("version"),
        "place",
        let(_words(F.col("text")), counts).alias("w"),
        F.length(F.regexp_replace("text", _GAP, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, measured).alias("l"),
    )
    base = scratch.keep(base, "base")
    hosted = base.withColumn("host", F.xxhash64("place"))
    sizes = hosted.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("of"))
    rows = hosted.select("row", "doc_id", "host", F.explode("l.rows").alias("x")).select("row", "doc_id", "host", "x.line", "x.words", "x.i")
    often = rows.select("host", "line", "doc_id").distinct().groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > c.max_docs)
    often = scratch.keep(often.join(sizes, "host").where(1000 * F.col("documents") > c.max_per_mille * F.col("of")).drop("of"), "often")
    spread = often.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(c.salts - 1))).alias("salt"))
    gone = rows.withColumn("salt", F.pmod("row", F.lit(c.salts)).cast("int")).join(spread, ["host", "line", "salt"]).groupBy("row").agg(F.sum("words").alias("gone"), F.collect_list("i").alias("gone_at"))
    n, repeat, lost = F.col("w.n"), F.col("w.repeat"), F.coalesce("gone", F.lit(0)).cast("long")
    failed = (n < c.min_words) | (100 * repeat > c.max_repeat_percent * n)
    verdicts = base.join(gone, "row", "left").select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), repeat.alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & (100 * (n - lost) >= c.min_left_percent * n)).alias("kept"), lost.alias("n_removed_words"),
        "version", "place", "gone_at",
    )
    return verdicts, often


def quality_lines(docs: DataFrame, config: LineConfig | None = None, host: str = "source") -> tuple[DataFrame, DataFrame]:
    """Verdicts and the boilerplate lines behind them; docs has doc_id, text and a host column.

    Verdicts: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words.
    Lines: (host's hash, normalised line's hash, documents).
    A null text has no words and fails; a null host is a host of its own; rows that repeat a doc_id are judged each but
    count once for a line, as do all rows without a doc_id; a very long text is one row's arrays in memory; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    verdicts, often = _judged(docs, config, host)
    return verdicts.drop("version", "place", "gone_at"), often


def cleaned_lines(docs: DataFrame, config: LineConfig | None = None, host: str = "source") -> DataFrame:
    """quality_lines' verdicts and the row's text without its boilerplate lines, whose words n_removed_words counts.

    A null text stays null, and one whose lines all go becomes empty; rows that repeat a doc_id are cleaned each; a very
    long text is one row's arrays in memory, with work in proportion to its lines; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    verdicts, _ = _judged(docs, config, host)
    # rows that agree in doc_id, text and host have one verdict
    verdicts = verdicts.dropDuplicates(["doc_id", "version", "place"]).withColumnsRenamed({"doc_id": "d", "version": "v", "place": "p"})
    place = F.coalesce(F.col(host).cast("string"), F.lit("\0"))
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), place.alias("place"))
    both = rows.join(verdicts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")) & (F.col("place") == F.col("p")), "left")
    # the numbers of the lines that stay are one set difference, so the work grows with a text's lines and not their square
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone_at"))
    left = let(F.split("text", "\n"), lambda lines: F.array_join(let(stay(lines), lambda at: F.transform(at, lambda i: F.get(lines, i))), "\n"))
    return both.withColumn("text", F.when(F.col("gone_at").isNull(), F.col("text")).otherwise(left)).drop("version", "place", "d", "v", "p", "gone_at")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaned_lines(table(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
dup AS (SELECT doc_id, unnest(ii) AS i FROM (SELECT doc_id, g, list(i) AS ii FROM win GROUP BY doc_id, g HAVING count(*) > 1)),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, source, i, x, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS w FROM (SELECT doc_id, source, i, l[i] AS x FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM d)))),
lw AS (SELECT *, translate(array_to_string(w, ' '), '{_UPPER}', '{_LOWER}') AS norm FROM ln WHERE len(w) > 0),
dl AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM lw GROUP BY doc_id),
often AS (SELECT source, norm FROM lw JOIN (SELECT source, count(DISTINCT doc_id) AS n_of FROM documents GROUP BY source) USING (source) GROUP BY source, norm, n_of HAVING count(DISTINCT doc_id) > {LineConfig.max_docs} AND 1000 * count(DISTINCT doc_id) > {LineConfig.max_per_mille} * n_of),
hit AS (SELECT doc_id, i, len(w) AS n FROM lw JOIN often USING (source, norm)),
gone AS (SELECT doc_id, sum(n) AS n FROM hit GROUP BY doc_id),
clean AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS left_text FROM ln WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = ln.doc_id AND hit.i = ln.i) GROUP BY doc_id),
b AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words, sha256(coalesce(left_text, '')) AS kept_sha256
  FROM d LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN clean USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * (n_words - n_removed_words) >= 50 * n_words AS kept, n_removed_words, kept_sha256 FROM f
"""
