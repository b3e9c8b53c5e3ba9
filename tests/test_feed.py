"""Cursors in batches and in streams."""

from pyspark.sql import functions as F

from graphloom.streaming import cursor

SCHEMA = "event_id long, file_id long, kind string, updated_at_ms long, deleted boolean"


def test_cursor(spark):
    rows = spark.createDataFrame([(1, 1, "active", 10, False), (2, 1, "active", 20, False), (3, 2, "active", 20, False), (4, 2, "deleted", 5, True)], SCHEMA)
    first = cursor.advance(rows.where("event_id < 3"))
    assert [tuple(r) for r in first.collect()] == [("active", 20, [2])]
    assert sorted(r.event_id for r in cursor.accept(rows, first).collect()) == [3, 4]
    assert sorted(tuple(r) for r in cursor.advance(rows.where("event_id = 3"), first).collect()) == [("active", 20, [2, 3])]
    assert cursor.advance(rows.limit(0), first).collect() == first.collect()


def test_bootstrap(spark):
    snap = spark.createDataFrame([(1, 1, "a", 10, False), (2, 1, "a", 30, True), (3, 2, "a", 5, False), (4, 3, "a", 7, False)], SCHEMA)
    manifest = spark.createDataFrame([(1, 10), (2, 5), (9, 1), (3, 6)], "file_id long, ms long")
    assert {r.file_id: r.change for r in cursor.bootstrap(snap, manifest).collect()} == {1: "deleted", 9: "deleted", 3: "changed"}


def test_stream_equals_batches(spark, tmp_path):
    batches = [[(1, 1, "active", 10, False), (2, 2, "active", 20, False)], [(2, 2, "active", 20, False), (3, 3, "active", 20, False), (4, 1, "active", 15, False)], [(5, 5, "deleted", 1, True), (6, 6, "active", 21, False)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = cursor.mirror(cursor.accepted_stream(stream), out, str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None and n < 3
    got = spark.read.parquet(out)
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 5, 6]
    assert got.where(F.col("event_id") == 4).isEmpty()


def test_retry_rules():
    assert [cursor.backoff(n) for n in (0, 1, 2, 10)] == [1, 2, 4, 60]
    assert cursor.retriable(None) and cursor.retriable(503) and not cursor.retriable(401)
