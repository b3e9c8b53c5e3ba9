"""The versioned store and the mirror, with crashes between steps."""

import random

import pytest

from graphloom.operators import rules
from graphloom.sources.store import Change, Conflict, Deferred, Store
from graphloom.streaming import mirror as m

EVENT = "event_id long, file_id string, source_path string, previous_source_path string, updated_at_ms long, deleted boolean"
TEXT = "file_id string, revision string, text string"


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_commits_replace_by_key(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(f"f{i % 9}", f"a{i}") for i in range(60)], "origin_file string, src string")
    assert store.version() == 0 and store.checkpoint() == {}
    assert store.commit({"edges": Change(rows), "nodes": Change(rows.limit(0))}, {"ms": 1}) == 1
    old = store.table("edges", 1)
    keys = spark.createDataFrame([("f3",), ("f4",), ("f99",)], "k string")
    assert store.commit({"edges": Change(spark.createDataFrame([("f3", "new"), ("f77", "more")], rows.schema), keys)}) == 2
    expected = rows.where("origin_file NOT IN ('f3', 'f4')").unionByName(spark.createDataFrame([("f3", "new"), ("f77", "more")], rows.schema))
    assert rules.multiset_difference(store.table("edges"), expected).isEmpty()
    assert rows_of(old) == rows_of(rows) == rows_of(store.table("edges", 1))  # readers of a version keep it
    assert rows_of(store.table("edges", keys=["f3", "f5"])) == rows_of(expected.where("origin_file IN ('f3', 'f5')"))
    assert store.table("nodes").isEmpty() and store.checkpoint() == {"ms": 1}
    assert store.vacuum(1) > 0 and store.versions() == [2] and rows_of(store.table("edges")) == rows_of(expected) and store.vacuum(1) == 0


@pytest.mark.parametrize("at", ["write edges", "write files", "stage", "switch", "done"])
def test_a_crash_at_any_step_leaves_a_whole_version(spark, tmp_path, at):
    def step(name):
        if armed and name == at:
            raise OSError(name)

    armed = []
    store = Store(spark, f"file://{tmp_path}/s", step)
    frame = lambda x: spark.createDataFrame([(f"f{i}", x) for i in range(20)], "origin_file string, v string")
    store.commit({"edges": Change(frame("old")), "files": Change(frame("old"))}, {"at": "old"})
    armed.append(1)
    with pytest.raises(OSError):
        store.commit({"edges": Change(frame("new")), "files": Change(frame("new"))}, {"at": "new"})
    want = "new" if at == "done" else "old"  # behind the switch the commit stands
    for name in ("edges", "files"):
        assert {r.v for r in store.table(name).collect()} == {want} and store.table(name).count() == 20
    assert store.checkpoint() == {"at": want}
    armed.clear()
    store.commit({"edges": Change(frame("next")), "files": Change(frame("next"))}, {"at": "next"})
    assert {r.v for r in store.table("edges").collect()} == {"next"} and store.checkpoint() == {"at": "next"}


def test_two_writers_of_one_version_conflict(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    frame = spark.createDataFrame([("f", "x")], "origin_file string, v string")
    store.commit({"t": Change(frame)})
    store.commit({"t": Change(frame)}, base=1)
    with pytest.raises(Conflict):
        store.commit({"t": Change(frame)}, base=1)
    assert store.version() == 2


def test_deferred_rounds_commit_together(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    frame = lambda *rows: spark.createDataFrame(list(rows), "origin_file string, v string")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    store.commit({"t": Change(frame(("a", "0"), ("b", "0"), ("z", "0")))}, {"n": 0})
    later = Deferred(store, "t", most_keys=5, most_rounds=3)
    assert later.add(frame(("a", "1"), ("b", "1")), keys("a", "b"), {"n": 1}) is None
    assert later.add(frame(("b", "2")), keys("b", "c"), {"n": 2}) is None and store.checkpoint() == {"n": 0}
    assert later.add(frame(), keys("a"), {"n": 3}) == 2  # five keys; a is deleted by its last round
    assert rows_of(store.table("t")) == rows_of(frame(("b", "2"), ("z", "0"))) and store.checkpoint() == {"n": 3}
    assert later.flush() is None
    later.add(frame(("q", "1")), keys("q"), {"n": 4})
    assert later.flush() == 3 and store.table("t").count() == 3


def plain(mirror, events, contents):
    """The same events one after another on a dict of paths."""
    out, report = {k: dict(v) for k, v in mirror.items()}, {}
    for e in sorted({e[0]: e for e in events}.values(), key=lambda e: (e[4], e[0])):
        _, file, path, previous, ms, deleted = e
        own = next((p for p, r in sorted(out.items(), key=lambda x: (x[1]["deleted"], x[0])) if r["file"] == file), None)
        if deleted:
            at = own or path
            out.setdefault(at, {"file": file, "text": None, "ms": ms})["deleted"] = True
            kind = "deleted"
        else:
            text = contents[file]
            left = previous or own
            left = left if left != path else None
            if left is None and own is not None and not out[own]["deleted"] and out[own]["text"] == text:
                kind = "unchanged"
            else:
                if left:
                    out.pop(left, None)
                out[path] = {"file": file, "text": text, "ms": ms, "deleted": False}
                kind = "renamed" if left else "written"
        report[kind] = report.get(kind, 0) + 1
    return out, report


@pytest.mark.parametrize("seed", range(4))
def test_the_mirror_equals_events_one_by_one(spark, tmp_path, seed):
    rng = random.Random(seed)
    store, state, event, clock = Store(spark, f"file://{tmp_path}/s"), {}, 0, 0
    for _ in range(3):
        contents = {f"id{k}": rng.choice(["x", "y", f"t{k}"]) for k in range(6)}
        events = []
        for _ in range(10):
            event += 1
            clock += rng.randrange(2)
            k = rng.randrange(6)
            path = f"app/{k}{rng.choice(['', '', 'b'])}.spg"  # each file has paths of its own
            events.append((event, f"id{k}", path, None, clock, rng.random() < 0.25))
        events.append(events[0])  # an event that comes twice counts once
        frame = spark.createDataFrame(events, EVENT)
        fetch = lambda wanted: wanted.select("file_id").distinct().join(spark.createDataFrame([(f, "r", t) for f, t in contents.items()], TEXT), "file_id")  # noqa: E731, B023
        report = m.pull(store, lambda checkpoint: (frame, {"seen": checkpoint.get("seen", 0) + 1}), fetch)  # noqa: B023
        state, expected = plain(state, events, contents)
        assert report == expected
        got = {r.source_path: (r.file_id, r.deleted, r.text if not r.deleted else None) for r in store.table("mirror").collect()}
        assert got == {p: (r["file"], r["deleted"], r["text"] if not r["deleted"] else None) for p, r in state.items()}
    assert store.checkpoint() == {"seen": 3} and m.pull(store, lambda c: (frame.limit(0), c), fetch) == {}


def test_paths_change_hands_and_renames_keep_what_was_indexed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    texts = spark.createDataFrame([("a", "1", "AAA"), ("b", "1", "BBB")], TEXT)
    go = lambda rows: m.pull(store, lambda c: (spark.createDataFrame(rows, EVENT), c), lambda w: texts)
    assert go([(1, "a", "x.spg", None, 1, False)]) == {"written": 1}
    assert [r.source_path for r in m.lagging(store.table("mirror")).collect()] == ["x.spg"]
    m.taken_in(store, store.table("mirror").select("source_path"))
    assert m.lagging(store.table("mirror")).isEmpty()
    # a moves away and b takes its place, in one round
    assert go([(2, "a", "y.spg", "x.spg", 2, False), (3, "b", "x.spg", None, 3, False)]) == {"renamed": 1, "written": 1}
    got = {r.source_path: (r.file_id, r.text, r.indexed_hash == r.hash) for r in store.table("mirror").collect()}
    assert got == {"y.spg": ("a", "AAA", True), "x.spg": ("b", "BBB", False)}
    assert go([(4, "c", "never.spg", None, 4, True)]) == {"deleted": 1}
    assert store.table("mirror").where("source_path = 'never.spg'").first().deleted


@pytest.mark.parametrize("path", ["/etc/x", "../x", "a/../../x", "a//b", "C:/x", "a\\b", "./x", ""])
def test_paths_out_of_the_mirror_are_refused(spark, tmp_path, path):
    events = spark.createDataFrame([(1, "a", path, None, 1, True)], EVENT)
    with pytest.raises(ValueError, match="out of the mirror"):
        m.applied(spark.createDataFrame([], m.MIRROR), events, spark.createDataFrame([], TEXT))


def test_failures_leave_everything_and_are_tried_again(spark, tmp_path):
    store, waits, calls = Store(spark, f"file://{tmp_path}/s"), [], []
    texts = spark.createDataFrame([("a", "1", "AAA")], TEXT)
    events = spark.createDataFrame([(1, "a", "x.spg", None, 1, False)], EVENT)

    def flaky(*fails):
        todo = list(fails)

        def fetch(wanted):
            calls.append(1)
            if todo:
                raise m.FetchFailed("no", todo.pop(0))
            return texts

        return fetch

    poll = lambda c: (events, {"n": c.get("n", 0) + 1})
    with pytest.raises(m.FetchFailed):
        m.pull_with_retry(store, poll, flaky(401), sleep=waits.append)
    assert (store.version(), waits, len(calls)) == (0, [], 1)
    assert m.pull_with_retry(store, poll, flaky(None, 503, 500), sleep=waits.append) == {"written": 1}
    assert waits == [1, 2, 4] and store.checkpoint() == {"n": 1}
    with pytest.raises(m.FetchFailed):
        m.pull_with_retry(store, poll, flaky(*[500] * 9), tries=3, sleep=waits.append)
    assert store.checkpoint() == {"n": 1} and store.version() == 1
    with pytest.raises(m.FetchFailed):  # a file whose content is not there
        m.pull(store, poll, lambda w: texts.limit(0))
