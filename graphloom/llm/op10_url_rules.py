"""Operator 10: longest-match URL rules as a sort-merge range join."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Verdict of a url that no rule fits.
DEFAULT_VERDICT = "allow"
#: Rows of the sample from which range borders are taken, for each partition. It shapes the load only, never a result.
SAMPLE_PER_PARTITION = 64
#: The rules of the registered query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_LOWER = {c: c + 32 for c in range(65, 91)}
_END = "\x01"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[stop:]
    cut = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return rest[:stop].translate(_LOWER), path[:cut]


def host_key(host: str) -> str:
    """Labels from the last to the first, each with an end mark: a host's subdomains are the keys that begin with its key."""
    return "".join(x + _END for x in reversed(host.split("."))) if host else ""


def _place(borders: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (page_id, url, salt) with their range: an equal url's rows differ in salt, so any hot url is divided."""
        for batch in batches:
            hosts, paths, keys, parts = [], [], [], []
            for url, salt in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                host, path = split_url(url)
                key = host_key(host)
                hosts.append(host)
                paths.append(path)
                keys.append(key.encode())
                parts.append(bisect_right(borders, f"{key}\x00{path}\x00{salt & 0xFFFFFFFFFFFFFFFF:016x}".encode()))
            n = len(hosts)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(keys, pa.binary()), pa.array([1] * n, pa.int32()), batch.column(0).cast(pa.int64()), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.nulls(n, pa.string())], ["part", "key", "kind", "page_id", "host", "path", "verdict"])

    return run


def _place_rules(borders: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A rule goes to each range that its interval of keys overlaps."""
        for batch in batches:
            rows = []
            for verdict, host, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if verdict is None or not host or path is None:
                    continue
                host = host.translate(_LOWER)
                key = host_key(host).encode()
                rows += [(p, key, 0, None, host, path, verdict) for p in range(bisect_right(borders, key), bisect_right(borders, key + b"\xff") + 1)]
            kinds = [pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "key", "kind", "page_id", "host", "path", "verdict"])

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rules and urls in one pass; the stack holds the hosts whose intervals are open, outermost first.

    A level is (key, host, rules by path, their path lengths, longest first).
    """
    stack: list[tuple[bytes, str, dict[str, str], list[int]]] = []
    part = None
    for batch in batches:
        out: list[tuple] = []
        for at, key, kind, page, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != part:
                part, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, host, {}, []))
                rules = stack[-1]
                # of equal rules with different verdicts, block wins
                rules[2][path] = max(rules[2].get(path, verdict), verdict)
                if len(path) not in rules[3]:
                    rules[3].append(len(path))
                    rules[3].sort(reverse=True)
                continue
            best = None
            for _, h, by_path, sizes in stack:
                if host == h or host.endswith("." + h):
                    for n in sizes:
                        if n <= len(path) and (v := by_path.get(path[:n])) is not None:
                            best = max(best, (len(h) + n, len(h), h + path[:n], v)) if best else (len(h) + n, len(h), h + path[:n], v)
                            break
            out.append((page, host, path, best[2] if best else None, best[3] if best else DEFAULT_VERDICT))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "host", "path", "rule", "verdict"])


def url_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id long, url string); rules has verdict, host, path.

    A rule fits its host and all subdomains where the url's path starts with the rule's; the longest host plus path
    wins, the longer host on a tie. No rule: null and ``allow``. Null or unparsable urls have empty host and path and
    fit no rule; repeated rows are judged each; rules with nulls or an empty host are ignored; an empty table gives no
    rows; other columns are ignored.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col("page_id").cast("long"), "url", F.xxhash64("page_id", "url").alias("salt"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = SAMPLE_PER_PARTITION * n
    every = max(1, urls.count() // most)
    picked = urls.where(F.pmod(F.xxhash64("salt"), F.lit(every)) == 0).limit(4 * most).collect()
    keys = sorted(f"{host_key(split_url(r.url)[0])}\x00{split_url(r.url)[1]}\x00{r.salt & 0xFFFFFFFFFFFFFFFF:016x}".encode() for r in picked)
    borders = sorted({keys[len(keys) * k // n] for k in range(1, n)}) if keys else []
    kind = "part int, key binary, kind int, page_id long, host string, path string, verdict string"
    both = urls.mapInArrow(_place(borders), kind).unionByName(rules.select("verdict", "host", "path").mapInArrow(_place_rules(borders), kind))
    return both.repartition(n, "part").sortWithinPartitions("part", "key", "kind").mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


_CASES = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
ORACLE = f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE {_CASES.replace('{}', '')} END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({", ".join(f"'{h}{p}'" for v, h, p in RULES if v == "block")}) THEN 'block' ELSE 'allow' END AS verdict FROM d
"""
