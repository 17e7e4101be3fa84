"""One scan of a library: diff against the index, analyse what changed, digest what could be equal, assemble."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrain.functions.kernels import analyze_frames
from lumagrain.operators.exact import exact_hash_work
from lumagrain.operators.findings import Snapshot, assemble
from lumagrain.operators.index import Index
from lumagrain.policy import ANALYZER_VERSION, AnalysisPolicy
from lumagrain.schema import InvariantError, require_unique
from lumagrain.sources.media import READABLE
from lumagrain.storage import stored

STAGES = {"LumaDecode": 0, "OriginalHash": 1}
MOST_PROGRESSIVE, LEAST_CADENCE, PROGRESSIVE_SNAPSHOTS = 1000, 2, 2  # libraries up to which snapshots come while analysing


@dataclass
class Library:
    """What a scan reads: the access state, descriptors, luma frames and original bytes of given assets."""

    access: Callable[[], str]
    descriptors: Callable[[], DataFrame]
    frames: Callable[[DataFrame], DataFrame]
    originals: Callable[[DataFrame], DataFrame]


@dataclass
class ScanResult:
    state: str
    reason: str | None = None
    snapshot: Snapshot | None = None
    skips: DataFrame | None = None
    analysed: int = 0
    hashed: int = 0
    states: list[str] = field(default_factory=list)


class Cancelled(Exception):
    pass


class ScanFailure(Exception):
    """A failure with its reason: AccessUnavailable, Database or Invariant."""


class Coordinator:
    """Runs scans one at a time; a start while one runs is ignored. Pause, resume and cancel take effect between
    steps, and access is read again when a paused scan goes on.

    `progress` is what has been published of the running scan: (state, completed, total), never falling within a state;
    `findings` the last snapshot. A scan of an earlier generation publishes nothing. Libraries of up to MOST_PROGRESSIVE
    assets get a snapshot at every half of the analysis and at its end; where nothing changed, one comes at once."""

    def __init__(self, library: Library, index: Index, clock: Callable[[], int], version: int = ANALYZER_VERSION, coverage: str = "complete"):
        self.library, self.index, self.clock, self.version, self.coverage = library, index, clock, version, coverage
        self.lock, self.go, self.stopped = threading.Lock(), threading.Event(), False
        self.go.set()
        self.states: list[str] = ["Idle"]
        self.generation, self.progress, self.findings, self.published = 0, [], None, 0

    def _publish(self, generation: int, state: str, completed: int, total: int) -> None:
        """Progress, unless it falls behind what is known or belongs to an earlier scan."""
        if generation != self.generation:
            return
        last = self.progress[-1] if self.progress else None
        if last is None or last[0] != state or completed >= last[1]:
            self.progress.append((state, completed, total))

    def _snapshot(self, generation: int, snapshot: Snapshot) -> None:
        if generation == self.generation:
            self.findings = snapshot
            self.published += 1

    def pause(self) -> None:
        self.go.clear()

    def resume(self) -> None:
        self.go.set()

    def cancel(self) -> None:
        self.stopped = True
        self.go.set()

    def _enter(self, state: str) -> None:
        if not self.go.is_set():
            self.states.append("Paused")
            self.go.wait()
            if not self.stopped:
                self._require_access("access was lost while paused")
        if self.stopped:
            raise Cancelled
        if not self.states or self.states[-1] != state:
            self.states.append(state)

    def _require_access(self, why: str) -> None:
        try:
            readable = self.library.access() in READABLE
        except Exception as e:
            raise ScanFailure(f"AccessUnavailable: {e}") from e
        if not readable:
            raise ScanFailure(f"AccessUnavailable: {why}")

    def _platform(self, read: Callable[[], DataFrame]) -> DataFrame | None:
        """What the platform reads, stored; None if it fails while access remains, so that its assets are skipped."""
        try:
            return stored(read())
        except Exception:
            self._require_access("access was lost")
            return None

    def start(self, policy: AnalysisPolicy, prepare: Callable[[], None] | None = None, wait: bool = False) -> ScanResult | None:
        """Runs a scan, or returns None if one is running; with wait, first waits for that. `prepare` runs inside the
        same exclusion, before the scan."""
        if not self.lock.acquire(blocking=wait):
            return None
        try:
            self.stopped = False
            self.states, self.progress, self.published = [], [], 0
            self.generation += 1
            if prepare:
                prepare()
            result = self._run(policy, self.generation)
        except Cancelled:
            result = ScanResult("Cancelled")
        except ScanFailure as e:
            result = ScanResult("RecoverableFailure", str(e))
        except InvariantError as e:
            result = ScanResult("RecoverableFailure", f"Invariant: {e}")
        except PermissionError as e:
            result = ScanResult("RecoverableFailure", f"AccessUnavailable: {e}")
        except PySparkException as e:
            result = ScanResult("RecoverableFailure", f"Database: {str(e)[:200]}")
        except Exception as e:  # whatever else goes wrong ends the scan and not its caller
            result = ScanResult("RecoverableFailure", f"Invariant: {type(e).__name__}: {str(e)[:200]}")
        finally:
            self.lock.release()
        self.states.append(result.state)
        result.states = list(self.states)
        return result

    def _listed(self) -> DataFrame:
        """The library's descriptors, stored. Repeated ids are an invariant's failure, all else of access."""
        try:
            found = stored(self.library.descriptors())
        except Exception as e:
            raise ScanFailure(f"AccessUnavailable: {str(e)[:200]}") from e
        return require_unique(found)

    def _analyse(self, changed: DataFrame) -> tuple[int, DataFrame]:
        """(rows saved, skips) of these assets."""
        spark = changed.sparkSession
        frames = self._platform(lambda: self.library.frames(changed))
        if frames is None:
            frames = spark.createDataFrame([], "asset_id string, width int, height int, pixels binary")
        found = stored(changed.join(analyze_frames(frames), "asset_id", "left").withColumn("skip_stage", F.when(F.col("perceptual_hash").isNull(), F.lit("LumaDecode"))))
        rows = found.where("skip_stage IS NULL").withColumnsRenamed({"content_signature": "source_signature"})
        rows = rows.withColumns({"analyzer_version": F.lit(self.version), "sha256": F.lit(None).cast("string"), "analyzed_at_ms": F.lit(self.clock()).cast("long")})
        rows = stored(rows.select(self.index.analysis.schema.names))
        n = rows.count()
        if n:
            self.index.save(rows)
        return n, found.where("skip_stage IS NOT NULL").select("asset_id", F.col("skip_stage").alias("stage"))

    def _parts(self, changed: DataFrame, reusable: int, total: int) -> list[tuple[DataFrame, int, bool]]:
        """(assets, completed after them, whether a snapshot follows): the changed assets up to each snapshot."""
        n = total - reusable
        if total > MOST_PROGRESSIVE or not n:
            return [(changed, total, False)] if n else []
        cadence = max(LEAST_CADENCE, total // PROGRESSIVE_SNAPSHOTS)
        ends = sorted({k for k in range(reusable + 1, total + 1) if k % cadence == 0 or k == total})
        names = [r["asset_id"] for r in changed.select("asset_id").orderBy("asset_id").collect()]  # MOST_PROGRESSIVE at most
        starts = [reusable, *ends[:-1]]
        return [(changed.where(F.col("asset_id").isin(names[a - reusable : b - reusable])), b, True) for a, b in zip(starts, ends, strict=True)]

    def _run(self, policy: AnalysisPolicy, generation: int) -> ScanResult:
        self._enter("Indexing")
        self._require_access("the library cannot be read")
        descriptors = self._listed()
        total = descriptors.count()
        self._publish(generation, "Indexing", total, total)
        self.index.purge_except(descriptors)
        _, changed = self.index.partition_changed(descriptors, self.version)
        changed = stored(changed)
        reusable = total - changed.count()
        self._enter("Analyzing")
        self._publish(generation, "Analyzing", reusable, total)
        skips = []
        analysed = 0
        parts = self._parts(changed, reusable, total)
        for some, completed, emits in parts:  # an unchanged library decodes nothing
            n, skipped = self._analyse(some)
            analysed += n
            skips.append(skipped)
            self._publish(generation, "Analyzing", completed, total)
            self._enter("Analyzing")
            if emits:
                self._snapshot(generation, assemble(self.index.analysis.read(), policy, self.coverage))
        if not parts:
            self._snapshot(generation, assemble(self.index.analysis.read(), policy, self.coverage))
        self._enter("Grouping")
        work = stored(exact_hash_work(self.index.analysis.read()))
        wanted = work.count()
        self._publish(generation, "Grouping", 0, wanted)
        hashed = 0
        if wanted:
            bytes_ = self._platform(lambda: self.library.originals(work).join(work, "asset_id", "left_semi").where("content IS NOT NULL").select("asset_id", F.sha2("content", 256).alias("sha256")))
            digests = bytes_ if bytes_ is not None else work.sparkSession.createDataFrame([], "asset_id string, sha256 string")
            hashed = digests.count()
            skips.append(work.join(digests, "asset_id", "left_anti").select("asset_id", F.lit("OriginalHash").alias("stage")))
            if hashed:
                self.index.save_digests(digests)
            self._publish(generation, "Grouping", wanted, wanted)
        self._enter("Grouping")
        snapshot = assemble(self.index.analysis.read(), policy, self.coverage)
        self._snapshot(generation, snapshot)
        spark = descriptors.sparkSession
        every = spark.createDataFrame([], "asset_id string, stage string")
        for s in skips:
            every = every.unionByName(s)
        rank = F.when(F.col("stage") == "LumaDecode", 0).otherwise(1)
        return ScanResult("Ready", None, snapshot, every.distinct().orderBy("asset_id", rank), analysed, hashed)
