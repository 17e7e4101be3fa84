"""Connected components of a graph that lies in tables: nothing of it comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumagrain.storage import checkpointed, stored

LINKS_A_PART = 200_000


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, label): the least node of each linked node's component.

    Labels flow along links and then jump to their own label's label, so chains shorten by half a round. Links are
    joined on the node, where adaptive skew joins split a hub's links; minima are partial before the shuffle. Each
    round is checkpointed, in as many files as the links need. No links give no rows; repeated links and self links
    change nothing."""
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = checkpointed(links.union(links.select("b", "a")).distinct())
    parts = max(1, -(-both.count() // LINKS_A_PART))

    def kept(df: DataFrame) -> DataFrame:
        return checkpointed(df.coalesce(parts))

    both = both.coalesce(parts)
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(rounds):
        told = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("to")).agg(F.min("label").alias("m"))
        near = kept(labels.join(told, labels["node"] == told["to"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old")))
        far = near.select(F.col("node").alias("at"), F.col("label").alias("next"))
        new = kept(near.join(far, near["label"] == far["at"]).select("node", F.col("next").alias("label"), (F.col("next") != F.col("old")).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The rows with their places in the order of a unique key, from 0: dealt in ranges and numbered in each; the driver
    gets the ranges' sizes only."""
    ranges = stored(rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    before, starts = 0, {}
    for r in ranges.groupBy("_range").count().orderBy("_range").collect():
        starts[r["_range"]] = before
        before += r["count"]
    start = F.array(*(F.lit(starts.get(k, 0)).cast("long") for k in range(max(starts, default=0) + 1)))[F.col("_range")]
    return ranges.withColumn(name, start + F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1).drop("_range")
