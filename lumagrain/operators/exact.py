"""Exact duplicates: buckets by edges and hash, digests, and sizes that must not contradict each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = ["short_edge", "long_edge", "perceptual_hash"]


def bucketed(records: DataFrame) -> DataFrame:
    return records.withColumns({"short_edge": F.least("width", "height"), "long_edge": F.greatest("width", "height")})


def exact_hash_work(records: DataFrame) -> DataFrame:
    """(asset_id) of records without a digest that need one: in buckets of two or more, those whose size is shared; all
    if a size in the bucket is unknown. Counts are summed before they are shuffled and joined back, so a large bucket
    is never one task's."""
    b = bucketed(records).select("asset_id", "sha256", "byte_count", *BUCKET)
    sizes = b.groupBy(*BUCKET, "byte_count").agg(F.count("*").alias("same"))
    whole = sizes.groupBy(*BUCKET).agg(F.sum("same").alias("all"), F.max(F.col("byte_count").isNull()).alias("unknown"))
    need = sizes.join(whole, BUCKET).where((F.col("all") >= 2) & (F.col("unknown") | (F.col("same") >= 2))).select(*BUCKET, "byte_count")
    on = [b[c] == need[c] for c in BUCKET] + [b["byte_count"].eqNullSafe(need["byte_count"])]
    return b.where("sha256 IS NULL").join(need, on, "left_semi").select("asset_id")


def exact_members(records: DataFrame) -> DataFrame:
    """The records of exact groups, with the group's key columns (edges, hash, digest, size_key).

    Records of one bucket and digest are one group; if their known sizes contradict each other, each size is a group,
    and records of unknown size are one of their own. Groups have two members or more."""
    b = bucketed(records).where("sha256 IS NOT NULL")
    key = [*BUCKET, "sha256"]
    sizes = b.groupBy(*key, "byte_count").agg(F.count("*").alias("same"))
    whole = sizes.groupBy(*key).agg(F.sum("same").alias("all"), F.count("byte_count").alias("known"))
    groups = sizes.join(whole, key).withColumn("size_key", F.when(F.col("known") > 1, F.coalesce("byte_count", F.lit(-1))))
    groups = groups.withColumn("members", F.when(F.col("known") > 1, F.col("same")).otherwise(F.col("all"))).where("members >= 2")
    g = groups.select(*(F.col(c).alias(f"g_{c}") for c in [*key, "byte_count"]), "size_key")
    on = [b[c] == g[f"g_{c}"] for c in key] + [b["byte_count"].eqNullSafe(g["g_byte_count"])]
    return b.join(g, on).drop(*(f"g_{c}" for c in [*key, "byte_count"]))


GROUP = [*BUCKET, "sha256", "size_key"]


