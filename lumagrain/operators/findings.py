"""The snapshot of findings: exact groups, near groups of the rest, blur items of the rest, and what they would free."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumagrain.functions.expressions import blur_verdict, saturating_sum, stable_finding_id
from lumagrain.operators.candidates import find_pairs
from lumagrain.operators.clustering import cluster
from lumagrain.operators.exact import GROUP, exact_members
from lumagrain.operators.graph import numbered
from lumagrain.operators.recommend import keeper_reasons, rank_keepers, removal_selected
from lumagrain.policy import AnalysisPolicy
from lumagrain.schema import require_unique
from lumagrain.storage import stored


@dataclass
class Snapshot:
    """Frames: exact_groups and near_groups (group_id, kind, asset_ids, keeper, reasons, selected, estimated_bytes),
    blur_items, coverage (status, attempted), and summary, one row."""

    exact_groups: DataFrame
    near_groups: DataFrame
    blur_items: DataFrame
    coverage: DataFrame
    summary: DataFrame


def assemble_groups(members: DataFrame, key: list[str], kind: str) -> DataFrame:
    """One row a group of members: stable id, sorted members, keeper, reasons, first selection, and its bytes."""
    ranked = rank_keepers(members, key).withColumn("selected", removal_selected(kind))
    # a group's key may hold nulls: it is one value for the joins below
    ranked = ranked.withColumn("_key", F.struct(*key)).withColumn("_k", F.xxhash64("_key")).withColumn("_t", F.to_json("_key", {"ignoreNullFields": "false"}))
    whole = ranked.groupBy("_k", "_t").agg(
        F.array_sort(F.collect_list("asset_id")).alias("asset_ids"),
        F.array_sort(F.collect_list(F.when(F.col("selected"), F.col("asset_id")))).alias("selected"),
        saturating_sum(F.when(F.col("selected"), F.col("byte_count"))).alias("estimated_bytes"),
    )
    reasons = keeper_reasons(ranked, ["_k", "_t"])
    joined = whole.join(reasons, ["_k", "_t"])
    return joined.select(stable_finding_id(kind, F.col("asset_ids")).alias("group_id"), F.lit(kind).alias("kind"), "asset_ids", "keeper", "reasons", "selected", "estimated_bytes")


def exact_groups(records: DataFrame) -> DataFrame:
    return assemble_groups(exact_members(records), GROUP, "exact")


def blur_items(records: DataFrame, policy: AnalysisPolicy) -> DataFrame:
    """(finding_id, asset_id, signals) of records whose stored signals say PossiblyBlurred under this policy."""
    verdict = blur_verdict(F.col("laplacian_variance"), F.col("edge_density"), F.col("local_texture_support"), policy.blur)
    found = records.where(verdict == "PossiblyBlurred")
    return found.select(stable_finding_id("blur", F.array("asset_id")).alias("finding_id"), "asset_id", "laplacian_variance", "edge_density", "local_texture_support")


def near_groups(records: DataFrame, policy: AnalysisPolicy, coverage: str) -> tuple[DataFrame, DataFrame]:
    named = stored(numbered(records, "asset_id", "_n"))
    numbers = named.withColumn("asset_id", F.col("_n")).drop("_n")
    pairs, status = find_pairs(numbers, policy, coverage)
    clusters = cluster(numbers, pairs).withColumnRenamed("asset_id", "_n")
    large = clusters.groupBy("cluster_id").count().where("count >= 2").select("cluster_id")
    members = named.join(clusters.join(large, "cluster_id", "left_semi"), "_n").drop("_n")
    return assemble_groups(members, ["cluster_id"], "near"), status


def assemble(records: DataFrame, policy: AnalysisPolicy, coverage: str = "complete") -> Snapshot:
    """All findings of stored analysis rows under a policy. Members of exact groups are in no other finding; a record
    may be in a near group and a blur item. An empty table gives empty findings and zero bytes."""
    records = stored(require_unique(records))
    exact = stored(exact_groups(records))
    taken = exact.select(F.explode("asset_ids").alias("asset_id"))
    rest = stored(records.join(taken, "asset_id", "left_anti"))
    near, status = near_groups(rest, policy, coverage)
    near = stored(near)
    blur = blur_items(rest, policy)
    both = exact.unionByName(near)
    counted = both.agg(F.count_if(F.col("kind") == "exact").alias("exact_count"), F.count_if(F.col("kind") == "near").alias("near_count"), saturating_sum(F.col("estimated_bytes")).alias("estimated_bytes"))
    summary = counted.crossJoin(blur.agg(F.count("*").alias("blur_count"))).crossJoin(status)  # one row each
    return Snapshot(exact, near, blur, status, summary.withColumn("total_count", F.col("exact_count") + F.col("near_count") + F.col("blur_count")))


def finding_tables(snapshot: Snapshot, policy_key: str) -> tuple[DataFrame, DataFrame]:
    """(groups, members) as persisted: one row a group, one row a member with its position."""
    both = snapshot.exact_groups.unionByName(snapshot.near_groups)
    groups = both.select("group_id", "kind", F.lit(policy_key).alias("policy_key"), F.col("estimated_bytes").alias("estimated_recoverable_bytes"), F.lit(False).alias("reviewed"))
    members = both.select("group_id", "keeper", "selected", F.posexplode("asset_ids").alias("position", "asset_id"))
    members = members.select("group_id", "asset_id", "position", (F.col("asset_id") == F.col("keeper")).alias("is_keeper"), F.array_contains("selected", F.col("asset_id")).alias("selected_for_removal"))
    return groups, members
