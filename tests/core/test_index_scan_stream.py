import hashlib
import json
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from lumagrain.operators.index import Index
from lumagrain.plans.scan import Coordinator, Library
from lumagrain.policy import MAX_LONG, AnalysisPolicy, BlurPolicy
from lumagrain.schema import InvariantError
from lumagrain.streaming import changes as c
from pyspark.sql import functions as F
from rows import OPEN, analysis, descriptor, descriptors, record


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, f"file://{tmp_path}/index")


def ids(df):
    return sorted(r["asset_id"] for r in df.collect())


def test_reuse(spark, index):
    index.save(analysis(spark, [record("same", signature="v"), record("sig", signature="v"), record("ver", signature="v", version=8, bytes_=None)]))
    old, new = index.partition_changed(descriptors(spark, [descriptor("same", "v", bytes_=99), descriptor("sig", "w"), descriptor("new", "v"), descriptor("ver", "v")]), 1)
    assert [(r["asset_id"], r["byte_count"]) for r in old.collect()] == [("same", 10)] and ids(new) == ["new", "sig", "ver"]


def test_changes_of_tables(spark, index):
    index.save(analysis(spark, [record("a"), record("b", sha="old"), record("c")]))
    index.save_digests(spark.createDataFrame([("a", "new")], "asset_id string, sha256 string"))
    assert {r["asset_id"]: r["sha256"] for r in index.records().collect()} == {"a": "new", "b": "old", "c": None}
    with pytest.raises(InvariantError):
        index.save_digests(spark.createDataFrame([("zz", "x")], "asset_id string, sha256 string"))
    index.save(analysis(spark, [record("b", version=2), record("d")]))
    assert {r["asset_id"]: (r["sha256"], r["analyzer_version"]) for r in index.records().collect()}["b"] == (None, 2)
    groups = spark.createDataFrame([(g, "exact", "p", 1, False) for g in "xy"], index.groups.schema)
    members = spark.createDataFrame([("x", "a", 0, True, False), ("x", "b", 1, False, True), ("y", "c", 0, True, False), ("y", "d", 1, False, True)], index.members.schema)
    index.save_findings(groups, members)
    index.invalidate(spark.createDataFrame([("a",)], "asset_id string"))
    assert ids(index.analysis.read()) == ["b", "c", "d"] and ids(index.members.read()) == ["c", "d"] and index.groups.read().count() == 1
    index.purge_except(spark.createDataFrame([("b",), ("c",)], "asset_id string"))
    assert ids(index.analysis.read()) == ["b", "c"] and index.members.read().count() == 0 and index.groups.read().count() == 0
    assert index.lookup("b").count() == 1 and index.reusable("s", 2).count() == 1


def test_history(spark, index):
    rows = lambda *at: spark.createDataFrame([(None, t, 1, 2, 3, 4) for t in at], index.history.schema)
    index.record_cleanup(rows(5, 9))
    index.record_cleanup(rows(5))
    assert [(r["id"], r["completed_at_ms"]) for r in index.cleanup_history().collect()] == [(2, 9), (3, 5), (1, 5)]


def test_history_is_numbered_in_many_tasks(spark):
    from lumagrain.operators.index import append_history
    from lumagrain.schema import HISTORY

    blank = lambda at: (None, at, 1, 2, 3, 4)
    times = [k * 7919 % 1000 for k in range(3000)] + [5] * 1000
    old = spark.createDataFrame([(41, 10**6, 1, 2, 3, 4)], HISTORY)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = append_history(old, spark.createDataFrame([blank(t) for t in times], HISTORY).repartition(3))
        rows = sorted((r["id"], r["completed_at_ms"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows == [(41, 10**6), *enumerate(sorted(times), 42)]
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def test_invalid_rows_are_refused(spark, index):
    for bad in (record("a", evidence=(float("nan"), 0.0, 0.0)), record("a", evidence=(1.0, 1.0, 2.0)), record("a", w=0), record(" "), record("a", bytes_=-1)):
        with pytest.raises(InvariantError):
            index.save(analysis(spark, [bad]))


def frame_of(k, w=40, h=36):
    y, x = np.mgrid[0:h, 0:w]
    return ((x * 7 + y * (k + 3) + k * 29) % 256).astype(np.uint8)


class Photos:
    """A library of frames; what was decoded and read is counted."""

    def __init__(self, spark, frames):
        self.spark, self.frames, self.access, self.signature, self.broken = spark, frames, "Full", "v1", set()
        self.decoded, self.read = [], []

    def library(self):
        return Library(lambda: self.access, self.listed, self.luma, self.originals)

    def listed(self):
        return descriptors(self.spark, [descriptor(i, self.signature, f.shape[1], f.shape[0], f.size, 1000) for i, f in self.frames.items()])

    def luma(self, wanted):
        names = ids(wanted)
        self.decoded += names
        return self.spark.createDataFrame([(i, self.frames[i].shape[1], self.frames[i].shape[0], None if i in self.broken else bytearray(self.frames[i].tobytes())) for i in names], "asset_id string, width int, height int, pixels binary")

    def originals(self, wanted):
        names = ids(wanted)
        self.read += names
        return self.spark.createDataFrame([(i, bytearray(self.frames[i].tobytes())) for i in names], "asset_id string, content binary")


POLICY = AnalysisPolicy("Balanced", 4, MAX_LONG, 1.0, BlurPolicy(0.0, 0.0))


def test_scan_then_warm_scan(spark, index):
    photos = Photos(spark, {"a": frame_of(1), "b": frame_of(1), "c": frame_of(90), "bad": frame_of(5)})
    photos.broken = {"bad"}
    scan = Coordinator(photos.library(), index, lambda: 77)
    one = scan.start(POLICY)
    assert (one.state, one.analysed, one.hashed) == ("Ready", 3, 2) and one.states == ["Indexing", "Analyzing", "Grouping", "Ready"]
    assert [r["asset_ids"] for r in one.snapshot.exact_groups.collect()] == [["a", "b"]]
    assert [tuple(r) for r in one.skips.collect()] == [("bad", "LumaDecode")]
    assert index.lookup("a").first()["sha256"] == hashlib.sha256(frame_of(1).tobytes()).hexdigest()
    photos.broken, photos.frames = set(), {k: photos.frames[k] for k in "abc"}
    photos.decoded, photos.read = [], []
    two = scan.start(POLICY)
    assert (two.analysed, two.hashed, photos.decoded, photos.read) == (0, 0, [], []) and two.snapshot.exact_groups.count() == 1
    photos.frames.pop("b")
    assert scan.start(POLICY).snapshot.exact_groups.count() == 0 and ids(index.analysis.read()) == ["a", "c"]


def test_failures_and_control(spark, index):
    photos = Photos(spark, {"a": frame_of(1)})
    scan = Coordinator(photos.library(), index, lambda: 1)
    photos.access = "Denied"
    assert scan.start(POLICY).reason.startswith("AccessUnavailable")
    photos.access = "Full"
    photos.listed = lambda: descriptors(spark, [descriptor("a"), descriptor("a")])
    scan.library = photos.library()
    assert scan.start(POLICY).reason.startswith("Invariant")
    scan.lock.acquire()
    assert scan.start(POLICY) is None
    scan.lock.release()
    assert scan.start(POLICY, scan.cancel).state == "Cancelled"


def test_progress_and_snapshots(spark, index):
    photos = Photos(spark, {f"p{k}": frame_of(k) for k in range(5)})
    scan = Coordinator(photos.library(), index, lambda: 1)
    scan.start(POLICY)
    done = [(s, n, t) for s, n, t in scan.progress if s == "Analyzing"]
    assert done == [("Analyzing", 0, 5), ("Analyzing", 2, 5), ("Analyzing", 4, 5), ("Analyzing", 5, 5)] and scan.published == 4
    assert [s for s, _, _ in scan.progress] == sorted((s for s, _, _ in scan.progress), key=["Indexing", "Analyzing", "Grouping"].index)
    scan._publish(scan.generation, "Grouping", -1, 0)
    scan._publish(scan.generation - 1, "Grouping", 99, 99)
    assert scan.progress[-1][1:] != (-1, 0) and scan.progress[-1][1:] != (99, 99)
    scan.start(POLICY)
    assert scan.published == 2 and scan.progress[1] == ("Analyzing", 5, 5)  # nothing changed: one snapshot, then the last


def test_failures_have_reasons(spark, index):
    photos = Photos(spark, {"a": frame_of(1), "b": frame_of(2)})
    scan = Coordinator(photos.library(), index, lambda: 1)
    scan.library.frames = lambda wanted: 1 / 0  # the platform fails, access remains: assets are skipped
    one = scan.start(POLICY)
    assert one.state == "Ready" and one.analysed == 0 and [r["stage"] for r in one.skips.collect()] == ["LumaDecode"] * 2

    def lost(wanted):
        photos.access = "Denied"
        raise OSError("gone")

    scan.library.frames = lost
    assert scan.start(POLICY).reason.startswith("AccessUnavailable")
    photos.access = "Full"
    scan.library = photos.library()
    scan.library.descriptors = lambda: 1 / 0
    assert scan.start(POLICY).reason.startswith("AccessUnavailable")
    scan.library = photos.library()
    scan.clock = lambda: 1 / 0
    assert scan.start(POLICY).reason.startswith("Invariant") and scan.start(POLICY) is not None


def test_tables_change_together(spark, index, monkeypatch):
    """A change that fails on its way leaves all tables as they were."""
    index.save(analysis(spark, [record("a"), record("b")]))
    groups = spark.createDataFrame([("x", "exact", "p", 1, False)], index.groups.schema)
    members = spark.createDataFrame([("x", "a", 0, True, False), ("x", "b", 1, False, True)], index.members.schema)
    index.save_findings(groups, members)
    with pytest.raises(InvariantError):
        index.save_findings(groups.where("false"), members)
    last = index.tables._last

    def fails(name, complete):
        if name == "finding_member" and not complete:
            raise OSError("disk")
        return last(name, complete)

    monkeypatch.setattr(index.tables, "_last", fails)
    with pytest.raises(OSError):
        index.invalidate(spark.createDataFrame([("a",)], "asset_id string"))
    monkeypatch.undo()
    assert ids(index.analysis.read()) == ["a", "b"] and index.members.read().count() == 2
    index.invalidate(spark.createDataFrame([("a",)], "asset_id string"))
    assert ids(index.analysis.read()) == ["b"] and index.members.read().count() == 0


def test_intermediate_tables(spark):
    from types import SimpleNamespace

    from lumagrain import storage

    with storage.intermediate(spark):
        gone = storage.stored(spark.range(3))
        stays = storage.stored(spark.range(4), kept=True)
        path = gone.inputFiles()[0].rpartition("/")[0]
        assert gone.count() == 3 and storage.exists(spark, path)
    assert not storage.exists(spark, path) and stays.count() == 4
    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))))
    with pytest.raises(RuntimeError):
        storage.shared_dir(away)


def test_late_changes_join_the_batch(spark, index, tmp_path):
    """What arrives while another scan holds the exclusion is reconciled with what waits for it."""
    photos = Photos(spark, {"a": frame_of(1), "b": frame_of(2), "c": frame_of(3)})
    scan = Coordinator(photos.library(), index, lambda: 1)
    scan.start(POLICY)
    photos.decoded = []
    feed = tmp_path / "feed"
    feed.mkdir()
    put = lambda k, i: (feed / f"{k}.json").write_text(json.dumps({"ts": "2026-01-01T00:00:00Z", "kind": "Changed", "asset_ids": [i]}) + "\n")
    follow = c.Reconciler(scan, index, lambda: POLICY)
    scan.lock.acquire()  # a scan is running
    query = follow.start(c.read_changes(spark, str(feed)), str(tmp_path / "ck"))
    put(1, "a")
    query.processAllAvailable()
    time.sleep(1)
    put(2, "c")
    query.processAllAvailable()
    assert follow.results == []
    scan.lock.release()
    follow.stop()
    assert len(follow.results) == 1 and sorted(photos.decoded) == ["a", "c"]
    again = c.Reconciler(scan, index, lambda: POLICY)  # nothing is left for the next process
    again.pending = follow.pending
    assert again._folders() == []


def event(ts, kind="Changed", ids_=()):
    return (datetime(2026, 1, 1) + timedelta(milliseconds=ts), kind, list(ids_))


def test_debounce(spark):
    rows = [event(0, ids_=["b"]), event(299, ids_=["a", "b"]), event(599, "AccessMayHaveChanged"), event(898, ids_=["c"]), event(5000, ids_=["d"])]
    got = c.debounced(spark.createDataFrame(rows, "ts timestamp, kind string, asset_ids array<string>")).orderBy("started").collect()
    assert [(r["asset_ids"], r["access_may_have_changed"], r["n"]) for r in got] == [(["a", "b"], False, 2), (["c"], True, 2), (["d"], False, 1)]


def test_change_set(spark):
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], "asset_id string")
    assert tuple(c.change_set(frame("b"), frame("a", "b"), frame("c")).first()) == ("Changed", ["a", "b", "c"])
    assert tuple(c.change_set(frame(), frame(), frame()).first()) == ("AccessMayHaveChanged", [])


def test_reconcile(spark, index):
    photos = Photos(spark, {"a": frame_of(1), "b": frame_of(2)})
    index.save(analysis(spark, [record("a"), record("b"), record("gone")]))
    scan = Coordinator(photos.library(), index, lambda: 1)
    pending = spark.createDataFrame([("Changed", ["a", "gone", "x"])], "kind string, asset_ids array<string>")
    c.reconcile(index, scan, pending)
    assert ids(index.analysis.read()) == ["b"]
    scan.library.descriptors = lambda: 1 / 0
    c.reconcile(index, scan, pending)
    assert index.analysis.read().count() == 0


def test_stream_of_changes(spark, index, tmp_path):
    photos = Photos(spark, {"a": frame_of(1), "b": frame_of(2)})
    scan = Coordinator(photos.library(), index, lambda: 1)
    scan.start(POLICY)
    photos.decoded = []
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "1.json").write_text("".join(json.dumps({"ts": "2026-01-01T00:00:00Z", "kind": "Changed", "asset_ids": ["a"]}) + "\n" for _ in range(1000)))
    follow = c.Reconciler(scan, index, lambda: POLICY)
    query = follow.start(c.read_changes(spark, str(feed)), str(tmp_path / "ck"))
    assert follow.start(None, "") is query
    query.processAllAvailable()
    follow.stop()
    assert photos.decoded == ["a"] and [r.state for r in follow.results] == ["Ready"] and ids(index.analysis.read()) == ["a", "b"]


def test_streamed_sessions(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    rows = [(0, "a"), (100, "b"), (5000, "c"), (200_000, "z")]
    (feed / "1.json").write_text("".join(json.dumps({"ts": (datetime(2026, 1, 1) + timedelta(milliseconds=t)).isoformat() + "Z", "kind": "Changed", "asset_ids": [i]}) + "\n" for t, i in rows))
    out = c.session_bursts(c.read_changes(spark, str(feed)))
    query = out.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert [r["asset_ids"] for r in spark.sql("SELECT * FROM bursts ORDER BY start").collect()] == [["a", "b"], ["c"]] and time and F and OPEN


def test_quiet_bursts(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    line = lambda kind, *i: json.dumps({"ts": "2026-01-01T00:00:00Z", "kind": kind, "asset_ids": list(i)}) + "\n"
    (feed / "1.json").write_text(line("Changed", "b") + line("Changed", "a", "b"))
    stream = c.read_changes(spark, str(feed)).withColumn("library", F.lit("l"))
    query = c.quiet_bursts(stream).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    def wait(n):
        until = time.time() + 40
        while time.time() < until and sum(r["n"] for r in spark.sql("SELECT n FROM quiet").collect()) < n:
            time.sleep(0.3)

    wait(2)
    (feed / "2.json").write_text(line("AccessMayHaveChanged"))
    wait(3)
    query.stop()
    rows = spark.sql("SELECT * FROM quiet").collect()
    assert sum(r["n"] for r in rows) == 3 and any(r["access_may_have_changed"] for r in rows)
    assert sorted({i for r in rows for i in r["asset_ids"]}) == ["a", "b"]
