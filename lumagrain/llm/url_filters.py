"""URL rules, and trust that flows along links between hosts, in DataFrame expressions only.

Rules judge the urls they fit. For the others, trust is a personalised PageRank from hosts with allowed pages along
the host graph, distrust one from hosts with blocked pages along the reversed graph; a host is blocked where the
distrust it received through links is over the threshold, which is a part of one blocked page's mass, and over the
trust it received. The mass that seeds start with is no verdict on their own other pages; links alone give that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumagrain.storage import checkpointed

from .common import shielded, table

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
MOST_RULES = 1000  # up to which they are one expression; more are joined by host
ROUNDS, SETTLED = 100, 1e-5  # of a propagation at most, and the part of all mass that may still move when it ends
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'<>\s]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or a url without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The verdict and text of the longest rule that fits; null if none does. A rule fits its host and all its
    subdomains, if the path starts with the rule's path."""
    verdict, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        verdict, rule = F.when(fits, F.lit(says)).otherwise(verdict), F.when(fits, F.lit(text)).otherwise(rule)
    return verdict, rule


def with_longest_rule(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule and _says to pages with host and path. Beyond MOST_RULES the rules are a table: each host that occurs
    meets the rules of its own name and of the names it ends with, and its pages ask those only."""
    if len(rules) <= MOST_RULES:
        verdict, rule = longest_rule(F.col("host"), F.col("path"), rules)
        return pages.withColumns({"rule": rule, "_says": verdict})
    spark = pages.sparkSession
    listed = spark.createDataFrame([(text.partition("/")[0], len(text), "".join(text.partition("/")[1:]), text, says) for says, text in rules], "name string, size int, start string, rule string, says string")
    parts = F.split("host", "\\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    hosts = pages.select("host").distinct().select("host", F.explode(names).alias("name"))
    fitting = hosts.join(listed, "name").groupBy(F.col("host").alias("_h")).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("k"), "start", "rule", "says"))).alias("_rules"))
    met = pages.join(fitting, F.col("host") == F.col("_h"), "left")
    first = F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(0))
    return met.withColumns({"rule": first["rule"], "_says": first["says"]}).drop("_h", "_rules")


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, summed before anything else sees them."""
    linked = pages.select(F.col(host).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)))).alias("to"))
    target = F.translate(F.regexp_replace("to", r"^[^@]*@|:\d*$", ""), UPPER, LOWER)
    return linked.select("src", target.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = 0.85, settled: float = SETTLED) -> DataFrame:
    """(host, received): a personalised PageRank's mass that came to each host through links, without what the seeds
    were given. `seeds` is (host, weight); `edges` is (src, dst, n). Each round is a join on the source and a sum by
    target with partial sums before the shuffle; hub hosts are split by adaptive skew joins. Rounds end when what moved
    in the last is at most `settled` of all mass; every third is checkpointed and looked at."""
    total = seeds.agg(F.sum("weight")).first()[0]
    start = seeds.select("host", (F.col("weight") / F.lit(float(total or 1.0)) * (1 - damping)).alias("mass"))
    out = edges.groupBy("src").agg(F.sum("n").alias("all_n"))
    moves = checkpointed(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all_n") * damping).alias("share")))
    received = start.select("host", F.lit(0.0).alias("received"), F.lit(0.0).alias("was")).where(F.lit(False))
    if not total or moves.isEmpty():
        return received.select("host", "received")
    for k in range(rounds):
        mass = start.unionByName(received.select("host", F.col("received").alias("mass"))).groupBy("host").agg(F.sum("mass").alias("mass"))
        told = moves.join(mass, moves["src"] == mass["host"]).select(F.col("dst").alias("host"), (F.col("share") * F.col("mass")).alias("received"), F.lit(0.0).alias("was"))
        kept = received.select("host", F.lit(0.0).alias("received"), F.col("received").alias("was"))
        received = told.unionByName(kept).groupBy("host").agg(F.sum("received").alias("received"), F.sum("was").alias("was"))
        if k % 3 == 2:
            received = checkpointed(received)
            if (received.agg(F.sum(F.abs(F.col("received") - F.col("was")))).first()[0] or 0.0) <= settled:
                break
    return received.where("received > 0").select("host", "received")


@shielded("_says", "_bad", "_h", "_rules")
def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", html: str = "html", rounds: int = ROUNDS, threshold: float = 1e-6) -> DataFrame:
    """Adds host, path, rule and verdict (allow or block) to each page; every row stays, and columns with these names
    are replaced. `threshold` is a part of one blocked page's mass, so a verdict doesn't depend on the table's size.

    A null url, or one without ://, has an empty host and path, no rule, and is allowed. Null or empty html has no
    links. Repeated rows are judged alike and their links count each time. An empty table gives an empty one. Up to
    MOST_RULES rules are an expression, more a table; the hosts' scores are joined by Spark, broadcast only if it knows
    them to be small."""
    pages = pages.drop(*({"host", "path", "rule", "verdict"} - {url, html}))
    host, path = url_parts(F.col(url))
    parts = pages.withColumns({"host": host, "path": path})
    ruled = with_longest_rule(parts, rules)
    edges = checkpointed(host_edges(ruled.select("host", html), html=html))
    if edges.isEmpty():  # no host has received anything
        return ruled.withColumn("verdict", F.coalesce("_says", F.lit("allow"))).drop("_says")
    seen = ruled.where("_says IS NOT NULL").groupBy("host").agg(F.count_if(F.col("_says") == "allow").alias("good"), F.count_if(F.col("_says") == "block").alias("bad"))
    seen = checkpointed(seen)
    trust = propagate(edges, seen.where("good > 0").select("host", F.col("good").cast("double").alias("weight")), rounds)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    pages_bad = float(seen.agg(F.sum("bad")).first()[0] or 0)  # propagated mass is 1 in all: a blocked page's is 1 / pages_bad
    distrust = propagate(back, seen.where("bad > 0").select("host", F.col("bad").cast("double").alias("weight")), rounds)
    blocked = distrust.withColumnRenamed("received", "bad").join(trust.withColumnRenamed("received", "good"), "host", "left").where((F.col("bad") * pages_bad > threshold) & (F.col("bad") > F.coalesce("good", F.lit(0.0))))
    marked = ruled.join(blocked.select("host", F.lit(True).alias("_bad")), "host", "left")
    return marked.withColumn("verdict", F.coalesce("_says", F.when(F.col("_bad"), F.lit("block")), F.lit("allow"))).drop("_says", "_bad")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")
