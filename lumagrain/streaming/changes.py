"""Library changes as a stream: bursts that a quiet gap ends become one pending change, which reconciles the index."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumagrain.operators.index import Index
from lumagrain.plans.scan import Coordinator
from lumagrain.policy import AnalysisPolicy
from lumagrain.schema import CHANGES
from lumagrain.sources.media import READABLE
from lumagrain.storage import exists, folders, remove

QUIET = "300 milliseconds"


def debounced(changes: DataFrame, key: str | None = None, quiet: str = QUIET) -> DataFrame:
    """Batch replay: (key, started, ended, asset_ids, access_may_have_changed, n) of each burst. A change opens a new
    burst unless it comes less than the quiet gap after the last; ids of a burst are united and sorted."""
    keys = [key] if key else []
    w = Window.partitionBy(*keys).orderBy("ts") if keys else Window.partitionBy(F.lit(0)).orderBy("ts")
    gap = F.expr(f"interval {quiet}")
    last = F.lag("ts").over(w)
    marked = changes.withColumn("_new", F.when(last.isNull() | (F.col("ts") >= last + gap), 1).otherwise(0))
    burst = marked.withColumn("burst", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return burst.groupBy(*keys, "burst").agg(
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("asset_ids", F.array().cast("array<string>")))))).alias("asset_ids"),
        F.max(F.col("kind") == "AccessMayHaveChanged").alias("access_may_have_changed"),
        F.count("*").alias("n"),
    )


def session_bursts(changes: DataFrame, watermark: str = "1 minute", quiet: str = QUIET) -> DataFrame:
    """Streaming: bursts by event time, closed when the watermark passes; for replay of recorded streams. Sessions
    need a key beside the window; a library's changes all have the same."""
    library = F.length("kind") < 0
    return changes.withWatermark("ts", watermark).groupBy(F.session_window("ts", quiet).alias("s"), library).agg(F.flatten(F.collect_set("asset_ids")).alias("asset_ids"), F.max(F.col("kind") == "AccessMayHaveChanged").alias("access_may_have_changed"), F.count("*").alias("n")).select("s.start", "s.end", F.array_sort(F.array_distinct("asset_ids")).alias("asset_ids"), "access_may_have_changed", "n")


PENDING = "library string, asset_ids array<string>, access_may_have_changed boolean, n long"


def quiet_bursts(changes: DataFrame, key: str = "library", quiet_ms: int = 300) -> DataFrame:
    """Streaming by arrival: one pending change (library, asset_ids, access_may_have_changed, n) for each key once no
    change has arrived for the quiet period. State holds the united ids, the coarse signal and a count; each arrival
    sets the timer anew."""

    def follow(keys, batches, state):
        ids, coarse, n = state.get if state.exists else ([], False, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"library": [keys[0]], "asset_ids": [list(ids)], "access_may_have_changed": [bool(coarse)], "n": [int(n)]})
            return
        united = set(ids)
        for part in batches:
            for more in part["asset_ids"]:
                united.update(more if more is not None else ())
            coarse = bool(coarse) or bool((part["kind"] == "AccessMayHaveChanged").any())
            n += len(part)
        state.update((sorted(united), coarse, n))
        state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({"library": [], "asset_ids": [], "access_may_have_changed": [], "n": []})

    keyed = changes.select(F.col(key).cast("string").alias("library"), "kind", "asset_ids")
    return keyed.groupBy("library").applyInPandasWithState(follow, PENDING, "asset_ids array<string>, coarse boolean, n long", "append", "ProcessingTimeTimeout")


def change_set(inserted: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """One change row of the united ids; with no ids it is the coarse signal."""
    ids = inserted.select("asset_id").union(changed.select("asset_id")).union(removed.select("asset_id")).distinct()
    united = ids.agg(F.array_sort(F.collect_list("asset_id")).alias("asset_ids"))
    return united.select(F.when(F.size("asset_ids") == 0, F.lit("AccessMayHaveChanged")).otherwise(F.lit("Changed")).alias("kind"), "asset_ids")


def reconcile(index: Index, coordinator: Coordinator, pending: DataFrame) -> None:
    """Purges what can no longer be read, and invalidates changed ids that still can. Without access, or if the library
    cannot be listed, everything is purged."""
    library = coordinator.library
    try:
        readable = library.access() in READABLE
        accessible = library.descriptors().select("asset_id") if readable else None
        if accessible is not None:
            accessible = accessible.persist()
            accessible.count()
    except Exception:  # any failure to list is a library without assets
        accessible = None
    if accessible is None:
        accessible = index.spark.createDataFrame([], "asset_id string")
    index.purge_except(accessible)
    ids = pending.select(F.explode("asset_ids").alias("asset_id")).distinct().join(accessible, "asset_id", "left_semi")
    index.invalidate(ids)


class Reconciler:
    """Follows a stream of changes. Each micro-batch is written beside the stream's checkpoint as pending; once none has
    come for the quiet period, one scan reconciles all that is pending when it gets the exclusion, so what arrives while
    another scan holds that joins the same batch. Pending changes go when their scan has ended, and those that an earlier
    process left are taken up at the start."""

    def __init__(self, coordinator: Coordinator, index: Index, policy: Callable[[], AnalysisPolicy], quiet_ms: int = 300):
        self.coordinator, self.index, self.policy, self.quiet = coordinator, index, policy, quiet_ms / 1000
        self.results: list = []
        self.query = self.worker = None
        self.wake, self.ended, self.lock, self.last = threading.Event(), False, threading.Lock(), 0.0

    def _merge(self, changes: DataFrame, batch: int) -> None:
        if not changes.isEmpty():
            with self.lock:
                changes.select("kind", "asset_ids").write.mode("overwrite").parquet(f"{self.pending}/batch-{batch}")
                self.last = time.monotonic()
                self.wake.set()

    def _folders(self) -> list[str]:
        return [f for f in folders(self.index.spark, self.pending) if exists(self.index.spark, f"{f}/_SUCCESS")]

    def _reconcile(self) -> None:
        """Inside the exclusion: all that is pending by now."""
        with self.lock:
            self.taken = self._folders()
            self.wake.clear()
        if self.taken:
            reconcile(self.index, self.coordinator, self.index.spark.read.schema("kind string, asset_ids array<string>").parquet(*self.taken))

    def _follow(self) -> None:
        while not (self.ended and not self.wake.is_set()):
            if not self.wake.wait(0.1):
                continue
            left = self.last + self.quiet - time.monotonic()
            if left > 0:
                time.sleep(left)
                continue
            self.taken: list[str] = []
            self.results.append(self.coordinator.start(self.policy(), self._reconcile, wait=True))
            for f in self.taken:
                remove(self.index.spark, f)

    def start(self, changes: DataFrame, checkpoint: str, trigger: str = QUIET):
        if self.query is None:
            self.pending, self.ended = f"{checkpoint.rstrip('/')}-pending", False
            if self._folders():
                self.wake.set()
            self.worker = threading.Thread(target=self._follow, daemon=True)
            self.worker.start()
            self.query = changes.writeStream.foreachBatch(self._merge).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
        return self.query

    def stop(self) -> None:
        """Ends the stream; what is pending is still reconciled."""
        if self.query is not None:
            self.query.stop()
            self.ended = True
            self.worker.join()
            self.query = self.worker = None


def read_changes(spark, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).json(path)
