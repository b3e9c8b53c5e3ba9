"""The change feed as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import projection as p
from ..streaming import cursor
from .registry import query

_HALF = "half AS (SELECT kind, max(updated_at_ms) AS ms FROM feed WHERE event_id % 2 = 0 GROUP BY kind), mark AS (SELECT f.kind, f.updated_at_ms AS ms, list(DISTINCT f.event_id ORDER BY f.event_id) AS ids FROM feed f JOIN half h ON h.kind = f.kind AND h.ms = f.updated_at_ms WHERE event_id % 2 = 0 GROUP BY 1, 2)"


@query("t06_cursor_advance", p.sql("SELECT kind, ms AS cursor_ms, array_to_string(ids, ',') AS seen FROM mark", _HALF))
def advance(t):
    events = p.feed(t).where("event_id % 2 = 0")
    return cursor.advance(events).select("kind", "cursor_ms", F.array_join(F.transform("seen", lambda x: x.cast("string")), ",").alias("seen"))


@query("t05_cursor_accept", p.sql("SELECT event_id, f.kind, updated_at_ms FROM feed f JOIN mark m ON m.kind = f.kind WHERE event_id % 2 = 1 AND (updated_at_ms > m.ms OR (updated_at_ms = m.ms AND NOT list_contains(ids, event_id)))", _HALF))
def accept(t):
    events = p.feed(t)
    return cursor.accept(events.where("event_id % 2 = 1"), cursor.advance(events.where("event_id % 2 = 0"))).select("event_id", "kind", "updated_at_ms")


@query("k13_ordered_events", p.sql("SELECT event_id, updated_at_ms, kind FROM feed"))
def ordered(t):
    return cursor.ordered(p.feed(t)).select("event_id", "updated_at_ms", "kind")


@query("t08_bootstrap", p.sql("""SELECT coalesce(s.file_id, m.file_id) AS file_id, CASE WHEN m.file_id IS NULL THEN 'added' WHEN s.file_id IS NULL THEN 'deleted' WHEN s.deleted THEN 'deleted' WHEN s.ms <> m.ms THEN 'changed' END AS change FROM (SELECT file_id, max(updated_at_ms) AS ms, arg_max(deleted, (updated_at_ms, event_id)) AS deleted FROM feed WHERE event_id % 3 <> 0 GROUP BY 1) s
 FULL JOIN (SELECT file_id, max(updated_at_ms) AS ms FROM feed WHERE event_id % 3 = 0 GROUP BY 1) m ON m.file_id = s.file_id WHERE m.file_id IS NULL OR s.file_id IS NULL OR s.deleted OR s.ms <> m.ms"""))
def bootstrap(t):
    events = p.feed(t)
    manifest = events.where("event_id % 3 = 0").groupBy("file_id").agg(F.max("updated_at_ms").alias("ms"))
    return cursor.bootstrap(events.where("event_id % 3 <> 0"), manifest)


@query("t15_scope_filter", "SELECT event_id, user_id FROM events WHERE user_id % 10 = 3 OR user_id IN (7, 9)")
def scope(t):
    events = t.events.select("event_id", "user_id", F.concat(F.lit("m"), F.col("user_id") % 10, F.lit("/f"), "user_id").alias("source_path"))
    return cursor.scoped(events, prefixes=["m3/"], files={"user_id": [7, 9]}).select("event_id", "user_id")


@query("s20_manifest_diff", p.sql("SELECT file_id, CASE WHEN max(event_id) % 3 = 0 THEN 'removed' WHEN max(event_id) % 3 = 1 THEN 'added' ELSE 'changed' END AS change FROM feed GROUP BY file_id"))
def manifest_diff(t):
    last = p.feed(t).groupBy("file_id").agg(F.max("event_id").alias("k"))
    before = last.where("k % 3 <> 1").select("file_id", F.lit(1).alias("revision"))
    now = last.where("k % 3 <> 0").select("file_id", F.lit(2).alias("revision"))
    return cursor.manifest_diff(before, now)
