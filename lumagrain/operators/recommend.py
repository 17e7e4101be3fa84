"""Which member of a group to keep, why, and what to select for removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumagrain.functions.expressions import finite, pixel_count


def _measured(rows: DataFrame) -> DataFrame:
    sharp = finite(F.col("laplacian_variance")) & finite(F.col("edge_density"))
    return rows.withColumns({"px": pixel_count(F.col("width"), F.col("height")), "has_sharpness": sharp})


def rank_keepers(members: DataFrame, group: list[str]) -> DataFrame:
    """Adds is_keeper to group members whose evidence is finite, as stored rows' is: the order is total, so the keeper
    is the first by favourite, edited, sharpness, pixels, and the least id."""
    order = [F.desc("is_favorite"), F.desc("is_edited"), F.desc("laplacian_variance"), F.desc("edge_density"), F.desc("px"), F.asc("asset_id")]
    ranked = _measured(members).withColumn("is_keeper", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1)
    return ranked.drop("px", "has_sharpness")


def keeper_reasons(members: DataFrame, group: list[str]) -> DataFrame:
    """(group, keeper, reasons): why the keeper is preferred to any other member, in a fixed order of reasons.

    The keeper's values are compared with sums over its group, so no group is gathered in one row."""
    m = _measured(members)
    keeper = m.where("is_keeper").select(*group, *(F.col(c).alias(f"k_{c}") for c in ("asset_id", "is_favorite", "is_edited", "laplacian_variance", "edge_density", "px", "has_sharpness")))
    both = m.join(keeper, group).withColumn("other", F.col("asset_id") != F.col("k_asset_id"))
    known = F.col("has_sharpness") & F.col("k_has_sharpness")
    more = (F.col("k_laplacian_variance") > F.col("laplacian_variance")) | ((F.col("k_laplacian_variance") == F.col("laplacian_variance")) & (F.col("k_edge_density") > F.col("edge_density")))
    same = ~known | ((F.col("k_laplacian_variance") == F.col("laplacian_variance")) & (F.col("k_edge_density") == F.col("edge_density")))
    tie = (F.col("k_asset_id") < F.col("asset_id")) & (F.col("k_is_favorite") == F.col("is_favorite")) & (F.col("k_is_edited") == F.col("is_edited")) & same & (F.col("k_px") == F.col("px"))
    any_ = lambda c: F.max(F.coalesce(F.col("other") & c, F.lit(False)))
    found = both.groupBy(*group, F.col("k_asset_id").alias("keeper")).agg(
        any_(F.col("k_is_favorite") & ~F.col("is_favorite")).alias("Favorite"),
        any_(F.col("k_is_edited") & ~F.col("is_edited")).alias("Edited"),
        any_(known & more).alias("Sharper"),
        any_(F.col("k_px") > F.col("px")).alias("HigherResolution"),
        any_(tie).alias("StableTieBreak"),
    )
    names = ["Favorite", "Edited", "Sharper", "HigherResolution", "StableTieBreak"]
    return found.select(*group, "keeper", F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in names))).alias("reasons"))


def fold_keeper(members: Column) -> Column:
    """The keeper of an array of structs (asset_id, is_favorite, is_edited, laplacian_variance, edge_density, width,
    height) in the array's order, where evidence may be missing: a fold that replaces on strictly better only, as a
    missing or infinite signal ties with any and so orders nothing."""

    def better(new: Column, old: Column) -> Column:
        known = finite(new["laplacian_variance"]) & finite(new["edge_density"]) & finite(old["laplacian_variance"]) & finite(old["edge_density"])
        px, old_px = (pixel_count(x["width"], x["height"]) for x in (new, old))
        steps = [(new["is_favorite"], old["is_favorite"], F.lit(True)), (new["is_edited"], old["is_edited"], F.lit(True)), (new["laplacian_variance"], old["laplacian_variance"], known), (new["edge_density"], old["edge_density"], known), (px, old_px, F.lit(True))]
        out = new["asset_id"] < old["asset_id"]
        for a, b, counts in reversed(steps):
            out = F.when(counts & (a > b), F.lit(True)).when(counts & (a < b), F.lit(False)).otherwise(out)
        return out

    return F.aggregate(F.slice(members, 2, F.greatest(F.size(members) - 1, F.lit(0))), F.get(members, F.lit(0)), lambda old, new: F.when(better(new, old), new).otherwise(old))["asset_id"]


def removal_selected(kind: str) -> Column:
    """Whether a member is selected for removal at first: in exact groups all but the keeper and favourites, in near
    groups and blur items nothing."""
    return (~F.col("is_keeper") & ~F.col("is_favorite")) if kind == "exact" else F.lit(False)
