"""Change feeds with two cursors, as batches and as streams.

A cursor is the latest time of its kind of events with the ids that were seen at that very time. An event is accepted
if it is later, or as late and unseen; older ones are late and are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CURSOR = "kind string, cursor_ms long, seen array<bigint>"


def ordered(events: DataFrame) -> DataFrame:
    """Events once each, in order of time and id."""
    return events.dropDuplicates(["event_id"]).orderBy("updated_at_ms", "event_id")


def accept(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events that a cursor of their kind lets through; without a cursor all are."""
    c = cursors.select("kind", F.col("cursor_ms").alias("__ms"), F.col("seen").alias("__seen"))
    rows = events.join(F.broadcast(c), "kind", "left")  # one row for each kind of event
    new = F.col("__ms").isNull() | (F.col("updated_at_ms") > F.col("__ms")) | ((F.col("updated_at_ms") == F.col("__ms")) & ~F.array_contains("__seen", F.col("event_id")))
    return rows.where(new).select(*events.columns)


def advance(events: DataFrame, cursors: DataFrame | None = None) -> DataFrame:
    """(kind, cursor_ms, seen) after events: the latest time and its ids; a time that stays gathers more ids, no event changes nothing."""
    rows = events.select("kind", F.col("updated_at_ms").alias("ms"), F.array("event_id").alias("ids"))
    if cursors is not None:
        rows = rows.unionByName(cursors.select("kind", F.col("cursor_ms").alias("ms"), F.col("seen").alias("ids")))
    top = rows.groupBy("kind").agg(F.max("ms").alias("cursor_ms"))
    last = rows.join(F.broadcast(top), "kind").where(F.col("ms") == F.col("cursor_ms"))
    return last.groupBy("kind", "cursor_ms").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("seen"))


def bootstrap(snapshot: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_id, change): a snapshot's last word on each file against the manifest (file_id, ms); what is missing was deleted."""
    last = snapshot.groupBy("file_id").agg(F.max("updated_at_ms").alias("new"), F.max_by("deleted", F.struct("updated_at_ms", "event_id")).alias("deleted"), F.lit(True).alias("here"))
    both = last.join(manifest.select("file_id", F.col("ms").alias("old")), "file_id", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("here").isNull() | F.col("deleted"), "deleted").when(F.col("new") != F.col("old"), "changed")
    return both.select("file_id", change.alias("change")).where("change IS NOT NULL")


def manifest_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(file_id, change) between two manifests of (file_id, revision)."""
    both = before.toDF("file_id", "a").join(now.toDF("file_id", "b"), "file_id", "full_outer")
    return both.select("file_id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").alias("change")).where("change IS NOT NULL")


def scoped(events: DataFrame, prefixes: list[str] = (), files: dict[str, list] | None = None) -> DataFrame:
    """Events of some modules (beginnings of source_path) or with some values of a column."""
    keep = F.lit(False)
    for x in prefixes:
        keep = keep | F.col("source_path").startswith(x)
    for column, values in (files or {}).items():
        keep = keep | F.col(column).isin(values)
    return events.where(keep)


def _follow(key: tuple, batches: Iterator, state) -> Iterator:
    import pandas as pd

    top, seen = (state.get[0], set(state.get[1])) if state.exists else (None, set())
    rows = pd.concat(list(batches), ignore_index=True).drop_duplicates("event_id").sort_values(["updated_at_ms", "event_id"])
    fresh = rows if top is None else rows[(rows.updated_at_ms > top) | ((rows.updated_at_ms == top) & ~rows.event_id.isin(seen))]
    if len(fresh):
        latest = int(fresh.updated_at_ms.max())
        ids = set(fresh.event_id[fresh.updated_at_ms == latest].tolist())
        state.update((latest, sorted(ids | seen if latest == top else ids)))
        yield fresh[["event_id", "file_id", "kind", "updated_at_ms", "deleted"]]


def accepted_stream(events: DataFrame) -> DataFrame:
    """The accepted events of a stream; each kind's cursor is its state, which holds the ids of one instant only."""
    rows = "event_id long, file_id long, kind string, updated_at_ms long, deleted boolean"
    return events.groupBy("kind").applyInPandasWithState(_follow, rows, "cursor_ms long, seen array<bigint>", "append", "NoTimeout")


def mirror(stream: DataFrame, path: str, checkpoint: str):
    """Writes each accepted micro-batch under its number; a batch that is run again replaces what it wrote before."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def backoff(attempt: int, most: int = 60) -> int:
    """Seconds before another try: 1, 2, 4, up to most."""
    return min(most, 2**attempt)


def retriable(status: int | None) -> bool:
    """Network errors (no status) and server errors are tried again; others are not."""
    return status is None or status >= 500
