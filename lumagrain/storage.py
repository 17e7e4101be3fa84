"""Tables on the storage that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []  # folders of intermediate tables that are there
_kept: list[str] = []  # and of those that outlive their block


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a temporary one stands in,
    in local mode only, where there is no other machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lumagrain-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame's rows as a reliable checkpoint on shared storage, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, kept: bool = False) -> DataFrame:
    """The frame written as Parquet to shared storage and read again: computed once, its lineage cut. The table goes with
    the `intermediate` block that it was made in, unless it is kept, or when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumagrain-{uuid.uuid4().hex}"
    if not _made and not _kept:
        atexit.register(_clear, spark)
    (_kept if kept else _made).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within the block are removed at its end, but for those that are kept: nothing else that is
    lazy may outlive it."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            remove(spark, path)
        del _made[before:]


def _clear(spark: SparkSession) -> None:
    """At the end of the process, as far as the session is still there."""
    while _made or _kept:
        try:
            remove(spark, (_made or _kept).pop())
        except Exception:
            return


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    _, fs, at = _fs(spark, path)
    return fs.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """What stands in a folder, by name; nothing if it isn't there."""
    _, fs, at = _fs(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    _, fs, at = _fs(spark, path)
    fs.delete(at, True)


class VersionedTables:
    """Tables as numbered Parquet snapshots under one path, and a manifest that says which are current. A change writes
    the next snapshots and then the next manifest, so tables that change together are read together or not at all, what
    is read is never overwritten, and a failed write leaves everything as it was."""

    MANIFEST = "name string, version long"

    def __init__(self, spark: SparkSession, path: str, schemas: dict):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas

    def _last(self, name: str, complete: bool) -> int:
        """The number of a folder's last snapshot, complete or begun; 0 before the first."""
        found = [f for f in folders(self.spark, f"{self.path}/{name}") if f.rpartition("/v")[2].isdigit()]
        return max((int(f.rpartition("/v")[2]) for f in found if not complete or exists(self.spark, f"{f}/_SUCCESS")), default=0)

    def versions(self) -> dict[str, int]:
        n = self._last("manifest", True)
        return {r["name"]: r["version"] for r in self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest/v{n}").collect()} if n else {}

    def read(self, name: str) -> DataFrame:
        n = self.versions().get(name)
        if not n:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}/v{n}")

    def replace(self, rows: dict[str, DataFrame]) -> None:
        now = self.versions()
        for name, df in rows.items():
            n = self._last(name, False) + 1
            df.select([f.name for f in self.schemas[name].fields]).write.parquet(f"{self.path}/{name}/v{n}")
            now[name] = n
        manifest = self.spark.createDataFrame(sorted(now.items()), self.MANIFEST).coalesce(1)
        manifest.write.parquet(f"{self.path}/manifest/v{self._last('manifest', False) + 1}")


class VersionedTable:
    """One of them."""

    def __init__(self, tables: VersionedTables, name: str):
        self.tables, self.name, self.schema = tables, name, tables.schemas[name]

    def read(self) -> DataFrame:
        return self.tables.read(self.name)

    def replace(self, rows: DataFrame) -> None:
        self.tables.replace({self.name: rows})
