"""A stored graph: Parquet tables in buckets of their key, changed by versioned commits.

Data are written into new folders that nothing refers to yet; a commit is one small file that names the folders of every
table, and appears by one rename. Readers take the last commit, so they see a whole version or the one before, and a crash
between any two steps leaves the last version as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer made a commit since this one's version was read."""


@dataclass(frozen=True)
class Change:
    """Fresh rows for a table: in place of all its rows, or of those whose key is in keys (one column); a key without fresh rows is deleted."""

    rows: DataFrame
    keys: DataFrame | None = None
    key: str = "origin_file"


class Store:
    """Versions of named tables under a root folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str, step: Callable[[str], None] = lambda name: None):
        """step is told before each step of a commit; tests let it fail."""
        self.spark, self.root, self.step = spark, root.rstrip("/"), step
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        number = self.version() if version is None else version
        if not number:
            return {"version": 0, "tables": {}, "checkpoint": {}}
        file = self._fs.open(self._path(f"{self.root}/commits/{number:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def checkpoint(self, version: int | None = None) -> dict:
        """What the commit says of the feed that its tables are made of."""
        return self.manifest(version)["checkpoint"]

    def table(self, name: str, version: int | None = None, keys: list[str] | None = None) -> DataFrame:
        """A table of a version; for some keys only their buckets are read."""
        found = self.manifest(version)["tables"][name]
        schema, folders = StructType.fromJson(found["schema"]), found["buckets"]
        if keys is not None:
            wanted = self.spark.createDataFrame([(x,) for x in keys], f"`{found['key']}` string")
            touched = {str(r["bucket"]) for r in _bucketed(wanted, found["key"]).select("bucket").distinct().collect()}
            folders = {b: p for b, p in folders.items() if b in touched}
        rows = self._read(schema, list(folders.values()))
        return rows if keys is None else rows.join(F.broadcast(wanted), found["key"], "left_semi")  # keys come as a list

    def _read(self, schema: StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in folders])

    def _written(self, change: Change, before: dict | None) -> dict:
        """The table's new entry: touched buckets in a new folder, the others where they are."""
        rows, at = change.rows, f"data/{uuid.uuid4().hex}"
        kept = {}
        if change.keys is not None and before is not None:
            keys = change.keys.select(F.col(change.keys.columns[0]).alias(change.key))
            # at most BUCKETS rows
            touched = {str(r["bucket"]) for r in _bucketed(keys.unionByName(rows.select(change.key)), change.key).select("bucket").distinct().collect()}
            kept = {b: p for b, p in before["buckets"].items() if b not in touched}
            old = self._read(StructType.fromJson(before["schema"]), [p for b, p in before["buckets"].items() if b in touched])
            rows = old.join(keys.distinct(), change.key, "left_anti").select(*old.columns).unionByName(rows)
        _bucketed(rows, change.key).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{at}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/{at}"))]
        fresh = {n.removeprefix("bucket="): f"{at}/{n}" for n in found if n.startswith("bucket=")}
        return {"key": change.key, "schema": json.loads(rows.schema.json()), "buckets": kept | fresh}

    def commit(self, changes: dict[str, Change], checkpoint: dict | None = None, base: int | None = None) -> int:
        """One new version with all the changes, and the checkpoint if one is given; other tables stay as they are.

        base is the version that the changes were made from, the last one if not given; a commit after it is a Conflict.
        """
        last = self.manifest(base)
        tables = dict(last["tables"])
        for name, change in changes.items():
            self.step(f"write {name}")
            tables[name] = self._written(change, tables.get(name))
        number = last["version"] + 1
        text = json.dumps({"version": number, "tables": tables, "checkpoint": last["checkpoint"] if checkpoint is None else checkpoint})
        self.step("stage")
        staged = self._path(f"{self.root}/commits/.{uuid.uuid4().hex}")
        file = self._fs.create(staged, False)
        try:
            file.write(bytearray(text.encode()))
        finally:
            file.close()
        self.step("switch")
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._context.rename(staged, self._path(f"{self.root}/commits/{number:020d}.json"), options)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {number} was committed by another writer") from e
            raise
        self.step("done")
        return number

    def vacuum(self, keep: int = 2) -> int:
        """Deletes commits but the last ones, and data that no commit left refers to; how many folders went.

        Only when no other commit is being written: data of one are not referred to yet.
        """
        versions = self.versions()
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/commits/{v:020d}.json"), False)
        used = {p.split("/")[1] for v in versions[-keep:] for t in self.manifest(v)["tables"].values() for p in t["buckets"].values()}
        at = self._path(f"{self.root}/data")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        for n in set(names) - used:
            self._fs.delete(self._path(f"{self.root}/data/{n}"), True)
        return len(set(names) - used)


def _bucketed(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int"))


class Deferred:
    """Changes of one table by key that are committed together once enough keys or rounds have gathered.

    What is pending lies in a written folder each, so memory does not grow; later rounds of a key take the place of
    earlier ones. A crash loses what is pending and no commit: the checkpoint stays that of the last commit, from which
    the feed is read again.
    """

    def __init__(self, store: Store, name: str, key: str = "origin_file", most_keys: int = 500, most_rounds: int = 20):
        self.store, self.name, self.key, self.most_keys, self.most_rounds = store, name, key, most_keys, most_rounds
        self._forget()

    def _forget(self) -> None:
        self.rounds: list[tuple[DataFrame, DataFrame]] = []
        self.keys, self.last = 0, None

    def add(self, rows: DataFrame, keys: DataFrame, checkpoint: dict) -> int | None:
        """Takes one round's fresh rows and keys; the new version if it was committed."""
        at, written = f"{self.store.root}/pending/{uuid.uuid4().hex}", []
        for name, df in (("rows", rows), ("keys", keys.select(F.col(keys.columns[0]).alias(self.key)).distinct())):
            df.write.parquet(f"{at}/{name}")
            written.append(self.store.spark.read.schema(df.schema).parquet(f"{at}/{name}"))
        self.rounds.append((written[0], written[1]))
        self.keys, self.last = self.keys + written[1].count(), checkpoint
        return self.flush() if self.keys >= self.most_keys or len(self.rounds) >= self.most_rounds else None

    def flush(self) -> int | None:
        """Commits what is pending."""
        if not self.rounds:
            return None
        every = rows = None
        for k, (fresh, keys) in enumerate(self.rounds):
            marked = keys.withColumn("round", F.lit(k))
            every = marked if every is None else every.unionByName(marked)
            fresh = fresh.withColumn("round", F.lit(k))
            rows = fresh if rows is None else rows.unionByName(fresh)
        last = every.groupBy(self.key).agg(F.max("round").alias("round"))
        rows = rows.join(last, [self.key, "round"], "left_semi").select(*self.rounds[0][0].columns)
        number = self.store.commit({self.name: Change(rows, last.select(self.key), self.key)}, self.last)
        self.store._fs.delete(self.store._path(f"{self.store.root}/pending"), True)
        self._forget()
        return number
