"""The incremental index: which assets must be analysed again, and changes to the stored tables.

Each change is a function from frames to frames; Index applies them to tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumagrain.schema import ANALYSIS, GROUPS, HISTORY, MEMBERS, InvariantError, require_unique, require_valid_analysis
from lumagrain.storage import VersionedTable, VersionedTables, stored

STORED_AS = {"source_signature": "content_signature"}


def partition_changed(descriptors: DataFrame, index: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(reusable, changed): descriptors whose stored row has this signature and analyzer version, as they are stored;
    and all others, as they came. Columns of descriptors."""
    known = index.select("asset_id", F.col("source_signature").alias("_sig"), F.col("analyzer_version").alias("_ver"), *(F.col(c).alias(f"_{c}") for c in descriptors.columns if c not in ("asset_id", "content_signature")))
    joined = descriptors.join(known, "asset_id", "left")
    same = F.coalesce((F.col("_sig") == F.col("content_signature")) & (F.col("_ver") == version), F.lit(False))
    old = [F.col(c) if c in ("asset_id", "content_signature") else F.col(f"_{c}").alias(c) for c in descriptors.columns]
    return joined.where(same).select(*old), joined.where(~same).select(descriptors.columns)


def upsert(base: DataFrame, rows: DataFrame) -> DataFrame:
    """The base with these rows in place of those with the same ids. A row without a digest erases the stored one."""
    return base.join(rows, "asset_id", "left_anti").unionByName(rows.select(base.columns))


def attach_digests(base: DataFrame, digests: DataFrame) -> DataFrame:
    """The base with (asset_id, sha256) attached; a digest of an unknown asset is an error."""
    lost = digests.join(base, "asset_id", "left_anti").limit(1).collect()
    if lost:
        raise InvariantError(f"no analysis row for {lost[0]['asset_id']!r}")
    new = digests.select("asset_id", F.col("sha256").alias("_new"))
    return base.join(new, "asset_id", "left").withColumn("sha256", F.coalesce("_new", "sha256")).select(base.columns)


def purge_except(base: DataFrame, accessible: DataFrame) -> DataFrame:
    return base.join(accessible.select("asset_id"), "asset_id", "left_semi").select(base.columns)


def invalidate(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("asset_id"), "asset_id", "left_anti").select(base.columns)


def reusable(base: DataFrame, signature: str, version: int) -> DataFrame:
    """The rows of this signature and analyzer version, by id."""
    return base.where((F.col("source_signature") == signature) & (F.col("analyzer_version") == version)).orderBy("asset_id")


def drop_groups_of(groups: DataFrame, members: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and members without any group that has a member among the gone assets."""
    hit = members.join(gone.select("asset_id"), "asset_id", "left_semi").select("group_id").distinct()
    return groups.join(hit, "group_id", "left_anti").select(groups.columns), members.join(hit, "group_id", "left_anti").select(members.columns)


def append_history(history: DataFrame, rows: DataFrame) -> DataFrame:
    """History with new rows, whose ids go on from the largest, in the order of their times, equal times in any order.

    Rows are dealt in ranges of time, equal times over several ranges if need be, and numbered in each; the driver
    gets the ranges' sizes only."""
    last = history.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    order = ["completed_at_ms", "_at"]
    placed = stored(rows.withColumn("_at", F.monotonically_increasing_id()))
    ranges = stored(placed.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["count"] for r in ranges.groupBy("_range").count().collect()}
    before, starts = last, []
    for k in range(max(sizes, default=0) + 1):
        starts.append(before)
        before += sizes.get(k, 0)
    start = F.array(*(F.lit(n).cast("long") for n in starts))[F.col("_range")]
    numbered = ranges.withColumn("id", start + F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return history.unionByName(numbered.select(history.columns))


def history_newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("completed_at_ms"), F.desc("id"))


class Index:
    """The stored tables under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.tables = VersionedTables(spark, path, {"asset_analysis": ANALYSIS, "cleanup_history": HISTORY, "finding_group": GROUPS, "finding_member": MEMBERS})
        self.analysis, self.history, self.groups, self.members = (VersionedTable(self.tables, name) for name in self.tables.schemas)

    def partition_changed(self, descriptors: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
        return partition_changed(require_unique(descriptors), self.analysis.read(), version)

    def save(self, rows: DataFrame) -> None:
        rows = stored(require_valid_analysis(require_unique(rows)))
        self.analysis.replace(upsert(self.analysis.read(), rows))

    def save_digests(self, digests: DataFrame) -> None:
        self.analysis.replace(attach_digests(self.analysis.read(), digests))

    def purge_except(self, accessible: DataFrame) -> None:
        base = self.analysis.read()
        self._drop(invalidate(base, accessible).select("asset_id"), purge_except(base, accessible))

    def invalidate(self, ids: DataFrame) -> None:
        self._drop(ids, invalidate(self.analysis.read(), ids))

    def _drop(self, gone: DataFrame, left: DataFrame) -> None:
        groups, members = drop_groups_of(self.groups.read(), self.members.read(), gone)
        self.tables.replace({"asset_analysis": left, "finding_group": groups, "finding_member": members})

    def record_cleanup(self, rows: DataFrame) -> None:
        self.history.replace(append_history(self.history.read(), rows))

    def cleanup_history(self) -> DataFrame:
        return history_newest_first(self.history.read())

    def save_findings(self, groups: DataFrame, members: DataFrame) -> None:
        lost = members.join(groups, "group_id", "left_anti").limit(1).collect()
        if lost:
            raise InvariantError(f"a member of no group: {lost[0]['group_id']!r}")
        self.tables.replace({"finding_group": groups, "finding_member": members})

    def lookup(self, asset_id: str) -> DataFrame:
        return self.analysis.read().where(F.col("asset_id") == asset_id)

    def reusable(self, signature: str, version: int) -> DataFrame:
        return reusable(self.analysis.read(), signature, version)

    def records(self) -> DataFrame:
        return self.analysis.read().orderBy("asset_id")
