"""A mirror of remote files, brought up to date by the events of a change feed in one commit with the feed's checkpoint."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.traversal import settled
from ..sources.store import Change, Store
from .cursor import backoff, retriable

MIRROR = "source_path string, file_id string, revision string, mtime long, size long, hash string, indexed_hash string, deleted boolean, text string"
#: Events: (event_id long, file_id, source_path, previous_source_path, updated_at_ms long, deleted).
#: Contents: (file_id, revision, text) of the files that events did not delete.


class FetchFailed(RuntimeError):
    """A feed or file could not be fetched; without a status the network failed."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def safe_path(path: F.Column) -> F.Column:
    """Whether a path stays inside the mirror: relative, without empty, ``.`` or ``..`` steps, drives or backslashes."""
    return ~path.rlike("^/|\\\\|^[A-Za-z]:|(^|/)\\.{0,2}(/|$)")


def outcomes(mirror: DataFrame, events: DataFrame, contents: DataFrame) -> DataFrame:
    """events in order (n) with what each does (outcome: written, renamed, unchanged, deleted), the path it ends at, and the path it leaves.

    A file is what its events before left, or what the mirror has. An event that brings the same text to a file that is
    there and stays where it is changes nothing. A path that the event names as left counts before the mirror's own.
    """
    numbered = events.dropDuplicates(["event_id"]).withColumn("n", F.struct("updated_at_ms", "event_id"))
    known = mirror.select("file_id", F.col("source_path").alias("had_path"), F.col("hash").alias("had_hash"), F.col("deleted").alias("had_deleted")).where("file_id IS NOT NULL")
    known = known.groupBy("file_id").agg(F.min_by(F.struct("had_path", "had_hash", "had_deleted"), F.struct("had_deleted", "had_path")).alias("had"))
    text = contents.select("file_id", F.sha2("text", 256).alias("now"))
    rows = numbered.join(known, "file_id", "left").join(text, "file_id", "left")
    before = W.partitionBy("file_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    active = F.when(~F.col("deleted"), F.col("source_path"))
    was_path = F.coalesce(F.last(active, True).over(before), F.col("had.had_path"), F.first("source_path").over(before))
    was_deleted = F.coalesce(F.last("deleted").over(before), F.col("had.had_deleted"))
    was_hash = F.when(F.max((~F.col("deleted")).cast("int")).over(before) == 1, F.col("now")).otherwise(F.col("had.had_hash"))
    rows = rows.withColumns({"was_path": was_path, "was_deleted": was_deleted, "was_hash": was_hash})
    left = F.coalesce("previous_source_path", "was_path")
    left = F.when(~F.col("deleted") & (left != F.col("source_path")), left)
    same = left.isNull() & F.col("was_path").isNotNull() & ~F.col("was_deleted") & (F.col("was_hash") == F.col("now"))
    outcome = F.when(F.col("deleted"), "deleted").when(F.coalesce(same, F.lit(False)), "unchanged").when(left.isNotNull(), "renamed").otherwise("written")
    ends = F.when(F.col("deleted"), F.coalesce("was_path", "source_path")).otherwise(F.col("source_path"))
    return rows.withColumns({"outcome": outcome, "ends_at": ends, "left": left}).select("n", "file_id", "updated_at_ms", "deleted", "outcome", "ends_at", "left", F.col("was_path").isNotNull().alias("known"))


def applied(mirror: DataFrame, events: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, paths, outcomes): the mirror's fresh rows for the touched paths.

    The last event that touches a path decides: it holds a file's text, or a file left it (no row), or its file was
    deleted (the row stays, marked; a file that was not there gets a mark of its own). A renamed file keeps the hash under
    which it was last taken into the graph. Paths that lead out of the mirror raise an error, and nothing is applied.
    """
    bad = events.where(~safe_path(F.col("source_path")) | ~F.coalesce(safe_path(F.col("previous_source_path")), F.lit(True))).select("source_path").first()
    if bad:
        raise ValueError(f"path leads out of the mirror: {bad.source_path}")
    lost = events.where("NOT deleted").join(contents, "file_id", "left_anti").select("source_path").first()
    if lost:
        raise FetchFailed(f"no content for {lost.source_path}", 404)
    done = settled(outcomes(mirror, events, contents))
    real = done.where("outcome <> 'unchanged'")
    touch = real.select(F.col("ends_at").alias("source_path"), F.struct("n", F.lit(1)).alias("at"), "file_id", "updated_at_ms", "outcome", "known")
    touch = touch.unionByName(real.where("left IS NOT NULL").select(F.col("left").alias("source_path"), F.struct("n", F.lit(0)).alias("at"), "file_id", "updated_at_ms", F.lit("left").alias("outcome"), "known"))
    last = touch.groupBy("source_path").agg(F.max_by(F.struct("file_id", "updated_at_ms", "outcome", "known"), "at").alias("x")).select("source_path", "x.*")
    indexed = mirror.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max("indexed_hash").alias("indexed_hash"))
    held = last.where("outcome IN ('written', 'renamed')").join(contents, "file_id").join(indexed, "file_id", "left")
    held = held.select("source_path", "file_id", "revision", F.col("updated_at_ms").alias("mtime"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"), "indexed_hash", F.lit(False).alias("deleted"), "text")
    gone = last.where("outcome = 'deleted'").join(mirror.drop("file_id", "deleted"), "source_path", "left")
    # a file that was written and deleted by the same events has only its mark
    gone = gone.select("source_path", "file_id", "revision", F.coalesce("mtime", "updated_at_ms").alias("mtime"), "size", "hash", "indexed_hash", F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("text"))
    return held.unionByName(gone), last.select("source_path"), done


def pull(store: Store, poll: Callable[[dict], tuple[DataFrame, dict]], fetch: Callable[[DataFrame], DataFrame]) -> dict:
    """One round: events since the checkpoint, their files' contents, and a commit of both with the new checkpoint; counts by outcome.

    A failure anywhere leaves the mirror and the checkpoint as they were.
    """
    base = store.version()
    events, checkpoint = poll(store.checkpoint(base))
    if events.isEmpty():
        return {}
    mirror = store.table("mirror", base) if base else store.spark.createDataFrame([], MIRROR)
    contents = settled(fetch(events.where("NOT deleted").select("file_id", "source_path").distinct()))
    rows, paths, done = applied(mirror, events, contents)
    store.commit({"mirror": Change(rows, paths, "source_path")}, checkpoint, base)
    return {r["outcome"]: r["count"] for r in done.groupBy("outcome").count().collect()}


def pull_with_retry(store: Store, poll, fetch, tries: int = 8, sleep: Callable[[float], None] = time.sleep) -> dict:
    """pull, again after 1, 2, 4 and up to 60 seconds where the network or the server failed; other failures are final."""
    for attempt in range(tries):
        try:
            return pull(store, poll, fetch)
        except FetchFailed as e:
            if attempt + 1 == tries or not retriable(e.status):
                raise
            sleep(backoff(attempt))
    return {}


def taken_in(store: Store, paths: DataFrame) -> int:
    """Marks files (source_path) whose present text was read into the graph; what lags behind is read again by the next bootstrap."""
    rows = store.table("mirror").join(paths.select("source_path").distinct(), "source_path", "left_semi").withColumn("indexed_hash", F.col("hash"))
    return store.commit({"mirror": Change(rows, paths, "source_path")})


def lagging(mirror: DataFrame) -> DataFrame:
    """(source_path) of files whose text was fetched but not read into the graph."""
    return mirror.where("NOT deleted AND NOT (hash <=> indexed_hash)").select("source_path")
