"""Every registered query of the library, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumagrain.functions import expressions as X
from lumagrain.functions.kernels import analyze_frames
from lumagrain.operators import candidates, clustering, exact, findings, index, quality, recommend
from lumagrain.plans import projections as P
from lumagrain.policy import BALANCED, MAX_LONG
from lumagrain.sources import media, synthetic
from lumagrain.storage import stored
from lumagrain.streaming.changes import debounced

FLAGSHIP = "exact_groups"
LOOSE = BALANCED.with_(max_capture_gap_ms=MAX_LONG, max_perceptual_distance=19)
LOOSE_BLUR = BALANCED.with_(blur=quality.BlurPolicy(0.3, 0.4))
FAR = BALANCED.with_(max_perceptual_distance=64, max_aspect_ratio_delta=1.0, max_capture_gap_ms=0)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def joined(column: str):
    return F.array_join(column, ",")


# ---- exact duplicates

EXACT_SQL = f"""{P.DOCS_SQL},
b AS (SELECT *, least(width, height) AS se, greatest(width, height) AS le FROM photo_docs),
c AS (SELECT *, count(DISTINCT byte_count) OVER (PARTITION BY se, le, perceptual_hash, sha256) AS sizes FROM b),
k AS (SELECT *, CASE WHEN sizes > 1 THEN coalesce(byte_count, -1) END AS size_key FROM c),
m AS (SELECT *, count(*) OVER (PARTITION BY se, le, perceptual_hash, sha256, size_key) AS n,
 row_number() OVER (PARTITION BY se, le, perceptual_hash, sha256, size_key ORDER BY is_favorite DESC, is_edited DESC, laplacian_variance DESC, edge_density DESC, CAST(width AS BIGINT) * height DESC, asset_id) AS r FROM k),
g AS (SELECT *, first_value(asset_id) OVER (PARTITION BY se, le, perceptual_hash, sha256, size_key ORDER BY r) AS keeper FROM m WHERE n >= 2)"""


@query(f"""WITH {P.DOCS_SQL}, b AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE sha256 END AS digest, least(width, height) AS se, greatest(width, height) AS le FROM photo_docs),
c AS (SELECT *, count(*) OVER (PARTITION BY se, le, perceptual_hash) AS n, max(CASE WHEN byte_count IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY se, le, perceptual_hash) AS u,
 count(*) OVER (PARTITION BY se, le, perceptual_hash, byte_count) AS s FROM b)
SELECT asset_id FROM c WHERE n >= 2 AND (u = 1 OR s >= 2) AND digest IS NULL""")
def exact_hash_work(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.when(F.substring("asset_id", 5, 8).cast("long") % 3 != 0, F.col("sha256"))
    return exact.exact_hash_work(P.photo_docs(spark, sf).withColumn("sha256", digest))


@query(f"""WITH {EXACT_SQL} SELECT concat('exact:', string_agg(concat(length(asset_id), ':', asset_id), '' ORDER BY asset_id)) AS group_id,
 string_agg(asset_id, ',' ORDER BY asset_id) AS members, count(*) AS n, min(keeper) AS keeper,
 coalesce(string_agg(asset_id, ',' ORDER BY asset_id) FILTER (WHERE r > 1 AND NOT is_favorite), '') AS selected,
 CAST(coalesce(sum(byte_count) FILTER (WHERE r > 1 AND NOT is_favorite), 0) AS BIGINT) AS estimated_bytes
FROM g GROUP BY se, le, perceptual_hash, sha256, size_key""")
def exact_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = findings.exact_groups(P.photo_docs(spark, sf))
    return g.select("group_id", joined("asset_ids").alias("members"), F.size("asset_ids").cast("long").alias("n"), "keeper", joined("selected").alias("selected"), "estimated_bytes")


@query(f"""WITH {EXACT_SQL}, j AS (SELECT g.*, k.is_favorite AS kf, k.is_edited AS ke, k.laplacian_variance AS kl, k.edge_density AS kd, CAST(k.width AS BIGINT) * k.height AS kp, CAST(g.width AS BIGINT) * g.height AS px
 FROM g JOIN photo_docs k ON k.asset_id = g.keeper)
SELECT keeper, concat_ws(',', CASE WHEN bool_or(kf AND NOT is_favorite) THEN 'Favorite' END, CASE WHEN bool_or(ke AND NOT is_edited) THEN 'Edited' END,
 CASE WHEN bool_or(kl > laplacian_variance OR (kl = laplacian_variance AND kd > edge_density)) THEN 'Sharper' END, CASE WHEN bool_or(kp > px) THEN 'HigherResolution' END,
 CASE WHEN bool_or(asset_id > keeper AND kf = is_favorite AND ke = is_edited AND kl = laplacian_variance AND kd = edge_density AND kp = px) THEN 'StableTieBreak' END) AS reasons
FROM j GROUP BY keeper""")
def keeper_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return findings.exact_groups(P.photo_docs(spark, sf)).select("keeper", joined("reasons").alias("reasons"))


@query(f"""WITH {P.DOCS_SQL}, r AS (SELECT width, height, asset_id, row_number() OVER (PARTITION BY width, height ORDER BY is_favorite DESC, is_edited DESC, laplacian_variance DESC, edge_density DESC, CAST(width AS BIGINT) * height DESC, asset_id) AS r FROM photo_docs)
SELECT width, height, asset_id AS keeper FROM r WHERE r = 1""")
def keeper_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.rank_keepers(P.photo_docs(spark, sf), ["width", "height"]).where("is_keeper").select("width", "height", F.col("asset_id").alias("keeper"))


@query(f"""WITH {P.DOCS_SQL}, r AS (SELECT width, asset_id, row_number() OVER (PARTITION BY width ORDER BY is_favorite DESC, is_edited DESC, laplacian_variance DESC, edge_density DESC, CAST(width AS BIGINT) * height DESC, asset_id) AS r FROM photo_docs)
SELECT width, asset_id AS keeper FROM r WHERE r = 1""")
def keeper_fold(spark: SparkSession, sf: str) -> DataFrame:
    fields = ["asset_id", "is_favorite", "is_edited", "laplacian_variance", "edge_density", "width", "height"]
    rows = P.photo_docs(spark, sf).groupBy(F.col("width").alias("w")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("m"))
    return rows.select(F.col("w").alias("width"), recommend.fold_keeper(F.col("m")).alias("keeper"))


@query(f"""WITH {EXACT_SQL} SELECT asset_id, r > 1 AND NOT is_favorite AS selected_for_removal, r = 1 AS is_keeper FROM g""")
def review_selection(spark: SparkSession, sf: str) -> DataFrame:
    members = recommend.rank_keepers(exact.exact_members(P.photo_docs(spark, sf)), exact.GROUP)
    return members.select("asset_id", recommend.removal_selected("exact").alias("selected_for_removal"), "is_keeper")


@query(f"""WITH {EXACT_SQL} SELECT CAST(least(coalesce(sum(CAST(byte_count AS HUGEINT) * 9007199254740993), 0), 9223372036854775807) AS BIGINT) AS saturated,
 CAST(coalesce(sum(byte_count), 0) AS BIGINT) AS plain FROM g WHERE r > 1 AND NOT is_favorite""")
def recoverable_bytes(spark: SparkSession, sf: str) -> DataFrame:
    members = recommend.rank_keepers(exact.exact_members(P.photo_docs(spark, sf)), exact.GROUP).where(recommend.removal_selected("exact"))
    large = F.col("byte_count").cast("decimal(38,0)") * F.lit(9007199254740993).cast("decimal(17,0)")
    return members.agg(X.saturating_sum(large).alias("saturated"), X.saturating_sum(F.col("byte_count")).alias("plain"))


@query(f"""WITH {EXACT_SQL}, x AS (SELECT se, le, perceptual_hash, sha256, size_key, concat('exact:', string_agg(concat(length(asset_id), ':', asset_id), '' ORDER BY asset_id)) AS group_id FROM g GROUP BY ALL)
SELECT x.group_id, g.asset_id, CAST(row_number() OVER (PARTITION BY x.group_id ORDER BY g.asset_id) - 1 AS INT) AS position, r = 1 AS is_keeper, r > 1 AND NOT is_favorite AS selected_for_removal
FROM g JOIN x ON g.se = x.se AND g.le = x.le AND g.perceptual_hash = x.perceptual_hash AND g.sha256 = x.sha256 AND g.size_key IS NOT DISTINCT FROM x.size_key""")
def finding_members(spark: SparkSession, sf: str) -> DataFrame:
    g = findings.exact_groups(P.photo_docs(spark, sf))
    empty = g.where("false")
    return findings.finding_tables(findings.Snapshot(g, empty, empty, empty, empty), "Balanced")[1]


# ---- candidate pairs and clusters

def _pairs_sql(policy, where: str = "") -> str:
    near = "" if policy.max_perceptual_distance == 64 else f"AND bit_count(xor(a.perceptual_hash, b.perceptual_hash)) <= {policy.max_perceptual_distance}"
    gap = "" if policy.max_capture_gap_ms >= MAX_LONG else f"AND (a.captured_at_ms IS NULL OR b.captured_at_ms IS NULL OR abs(a.captured_at_ms - b.captured_at_ms) <= {policy.max_capture_gap_ms})"
    return f"""a.asset_id < b.asset_id {near} {gap}
 AND abs(CAST(least(a.width, a.height) AS DOUBLE) / greatest(a.width, a.height) - CAST(least(b.width, b.height) AS DOUBLE) / greatest(b.width, b.height)) <= {policy.max_aspect_ratio_delta}"""


@query(f"""WITH {P.VECS_SQL} SELECT a.asset_id AS first_id, b.asset_id AS second_id, CAST(bit_count(xor(a.perceptual_hash, b.perceptual_hash)) AS INT) AS distance
FROM photo_vecs a JOIN photo_vecs b ON {_pairs_sql(BALANCED)}""")
def near_pairs_complete(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.complete_pairs(P.photo_vecs(spark, sf), BALANCED)


@query(f"""WITH {P.VECS_SQL} SELECT a.asset_id AS first_id, b.asset_id AS second_id, CAST(bit_count(xor(a.perceptual_hash, b.perceptual_hash)) AS INT) AS distance
FROM photo_vecs a JOIN photo_vecs b ON {_pairs_sql(LOOSE)}""")
def near_pairs_unbounded_gap(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.complete_pairs(P.photo_vecs(spark, sf), LOOSE)


def _bands_sql(distance: int, source: str) -> str:
    each = " UNION ALL ".join(f"SELECT *, {s} AS start_bit, {n} AS bit_count, (perceptual_hash >> {s}) & {(1 << n) - 1} AS value FROM {source}" for s, n in X.band_layout(distance))
    return f"bands AS ({each})"


def _attempts_sql() -> str:
    return f"""{P.VECS_SQL}, u AS (SELECT * FROM photo_vecs), {_bands_sql(19, 'u')},
p AS (SELECT a.asset_id AS l, b.asset_id AS r, min((a.start_bit, a.value, a.asset_id, b.asset_id)) AS o FROM bands a JOIN bands b ON a.start_bit = b.start_bit AND a.value = b.value AND a.asset_id < b.asset_id GROUP BY ALL),
t AS (SELECT * FROM p ORDER BY o LIMIT 100000)"""


@query(f"""WITH {_attempts_sql()} SELECT a.asset_id AS first_id, b.asset_id AS second_id, CAST(bit_count(xor(a.perceptual_hash, b.perceptual_hash)) AS INT) AS distance
FROM t JOIN photo_vecs a ON a.asset_id = t.l JOIN photo_vecs b ON b.asset_id = t.r WHERE {_pairs_sql(BALANCED)}""")
def near_pairs_budgeted(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.budgeted_pairs(P.photo_vecs(spark, sf), BALANCED)[0]


@query(f"""WITH {_attempts_sql()} SELECT CASE WHEN (SELECT count(*) FROM p) > 100000 THEN 'PairLimitReached' ELSE 'Complete' END AS status, (SELECT count(*) FROM t) AS attempted""")
def candidate_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.budgeted_pairs(P.photo_vecs(spark, sf), BALANCED)[1]


@query(f"""WITH {P.VECS_SQL}, p AS (SELECT a.asset_id AS l, b.asset_id AS r FROM photo_vecs a JOIN photo_vecs b ON a.asset_id < b.asset_id ORDER BY 1, 2 LIMIT 100000)
SELECT a.asset_id AS first_id, b.asset_id AS second_id, CAST(bit_count(xor(a.perceptual_hash, b.perceptual_hash)) AS INT) AS distance FROM p JOIN photo_vecs a ON a.asset_id = l JOIN photo_vecs b ON b.asset_id = r WHERE {_pairs_sql(FAR)}""")
def near_pairs_any_distance(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.budgeted_pairs(P.photo_vecs(spark, sf), FAR)[0]


@query(f"""WITH {P.VECS_SQL}, u AS (SELECT asset_id, perceptual_hash & 9223372036854775807 AS perceptual_hash FROM photo_vecs), {_bands_sql(19, 'u')} SELECT asset_id, start_bit, bit_count, value FROM bands""")
def hash_bands(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("perceptual_hash").bitwiseAND(F.lit(MAX_LONG))
    return P.photo_vecs(spark, sf).select("asset_id", F.explode(X.hash_bands(h, 19)).alias("b")).select("asset_id", "b.start_bit", "b.bit_count", "b.value")


def _clusters_sql(source: str, policy) -> str:
    """Greedy merges, one a round: of clusters whose members are all linked, the least (distance, first ids) first."""
    place = "(SELECT i, unnest(live[i]) AS id FROM (SELECT live, unnest(range(1, len(live) + 1)) AS i FROM merges))"
    return f"""link AS MATERIALIZED (SELECT a.asset_id AS f, b.asset_id AS s, bit_count(xor(a.perceptual_hash, b.perceptual_hash)) AS d FROM {source} a JOIN {source} b ON {_pairs_sql(policy)}),
merges(step, live) AS (SELECT 0, (SELECT list([i] ORDER BY i) FROM (SELECT f AS i FROM link UNION SELECT s FROM link))
 UNION ALL SELECT step + 1, list_concat(list_filter(live, lambda x: x[1] <> live[best.i][1] AND x[1] <> live[best.j][1]), [list_sort(list_concat(live[best.i], live[best.j]))])
 FROM merges, (SELECT c.i, c.j FROM (SELECT least(x.i, y.i) AS i, greatest(x.i, y.i) AS j, count(*) AS n, max(d) AS d FROM link JOIN {place} x ON x.id = f JOIN {place} y ON y.id = s WHERE x.i <> y.i GROUP BY 1, 2) c, merges
  WHERE c.n = len(live[c.i]) * len(live[c.j]) ORDER BY c.d, live[c.i][1], live[c.j][1] LIMIT 1) best),
cl AS (SELECT unnest(m) AS asset_id, m[1] AS cluster_id, len(m) AS size FROM (SELECT unnest(live) AS m FROM (SELECT live FROM merges ORDER BY step DESC LIMIT 1)))"""


def _blur_sql(policy) -> str:
    return f"local_texture_support >= 0.01 AND laplacian_variance <= {policy.blur.laplacian_variance_ceiling} AND edge_density <= {policy.blur.edge_density_ceiling}"


@query(f"""WITH RECURSIVE {P.VECS_SQL}, {_clusters_sql("photo_vecs", BALANCED)} SELECT v.asset_id, coalesce(cluster_id, v.asset_id) AS cluster_id FROM photo_vecs v LEFT JOIN cl ON cl.asset_id = v.asset_id""")
def near_clusters(spark: SparkSession, sf: str) -> DataFrame:
    records = P.photo_vecs(spark, sf)
    return clustering.cluster(records, stored(candidates.complete_pairs(records, BALANCED)))


@query(f"""WITH RECURSIVE {P.VECS_SQL}, {_clusters_sql("photo_vecs", BALANCED)},
m AS (SELECT v.*, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY is_favorite DESC, is_edited DESC, laplacian_variance DESC, edge_density DESC, CAST(width AS BIGINT) * height DESC, v.asset_id) AS r FROM photo_vecs v JOIN cl ON cl.asset_id = v.asset_id WHERE size > 1),
j AS (SELECT m.*, k.asset_id AS keeper, k.is_favorite AS kf, k.is_edited AS ke, k.laplacian_variance AS kl, k.edge_density AS kd, CAST(k.width AS BIGINT) * k.height AS kp, CAST(m.width AS BIGINT) * m.height AS px FROM m JOIN m k ON k.cluster_id = m.cluster_id AND k.r = 1)
SELECT concat('near:', string_agg(concat(length(asset_id), ':', asset_id), '' ORDER BY asset_id)) AS group_id, string_agg(asset_id, ',' ORDER BY asset_id) AS members, keeper,
 concat_ws(',', CASE WHEN bool_or(kf AND NOT is_favorite) THEN 'Favorite' END, CASE WHEN bool_or(ke AND NOT is_edited) THEN 'Edited' END,
 CASE WHEN bool_or(kl > laplacian_variance OR (kl = laplacian_variance AND kd > edge_density)) THEN 'Sharper' END, CASE WHEN bool_or(kp > px) THEN 'HigherResolution' END,
 CASE WHEN bool_or(asset_id > keeper AND kf = is_favorite AND ke = is_edited AND kl = laplacian_variance AND kd = edge_density AND kp = px) THEN 'StableTieBreak' END) AS reasons,
 CAST(0 AS BIGINT) AS estimated_bytes FROM j GROUP BY cluster_id, keeper""")
def near_groups(spark: SparkSession, sf: str) -> DataFrame:
    g, _ = findings.near_groups(P.photo_vecs(spark, sf), BALANCED, "complete")
    return g.select("group_id", joined("asset_ids").alias("members"), "keeper", joined("reasons").alias("reasons"), "estimated_bytes")


@query(f"""WITH RECURSIVE {EXACT_SQL}, {P.VECS_SQL}, x AS (SELECT sum(byte_count) FILTER (WHERE r > 1 AND NOT is_favorite) AS freed FROM g GROUP BY se, le, perceptual_hash, sha256, size_key),
rest AS (SELECT * EXCLUDE doc_id FROM photo_docs WHERE asset_id NOT IN (SELECT asset_id FROM g) UNION ALL BY NAME SELECT * EXCLUDE vec_id FROM photo_vecs), {_clusters_sql("rest", BALANCED)},
n AS (SELECT (SELECT count(*) FROM x) AS exact_count, (SELECT count(DISTINCT cluster_id) FROM cl WHERE size > 1) AS near_count, (SELECT CAST(coalesce(sum(freed), 0) AS BIGINT) FROM x) AS estimated_bytes,
 (SELECT count(*) FROM rest WHERE {_blur_sql(BALANCED)}) AS blur_count, 'Complete' AS status, (SELECT count(*) FROM link) AS attempted)
SELECT *, exact_count + near_count + blur_count AS total_count FROM n""")
def finding_summary(spark: SparkSession, sf: str) -> DataFrame:
    every = P.photo_docs(spark, sf).unionByName(P.photo_vecs(spark, sf))
    return findings.assemble(every, BALANCED).summary


# ---- blur and kernels

@query(f"""WITH {P.DOCS_SQL} SELECT asset_id, CASE WHEN local_texture_support >= 0.01 AND laplacian_variance <= 0.3 AND edge_density <= 0.4 THEN 'PossiblyBlurred' ELSE 'Inconclusive' END AS verdict FROM photo_docs""")
def blur_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    policy = quality.BlurPolicy(0.3, 0.4)
    return P.photo_docs(spark, sf).select("asset_id", X.blur_verdict(F.col("laplacian_variance"), F.col("edge_density"), F.col("local_texture_support"), policy).alias("verdict"))


@query(f"""WITH {EXACT_SQL} SELECT concat('blur:', length(asset_id), ':', asset_id) AS finding_id, asset_id FROM photo_docs
WHERE local_texture_support >= 0.01 AND laplacian_variance <= 0.3 AND edge_density <= 0.4 AND asset_id NOT IN (SELECT asset_id FROM g)""")
def blur_findings(spark: SparkSession, sf: str) -> DataFrame:
    records = P.photo_docs(spark, sf)
    rest = records.join(exact.exact_members(records).select("asset_id"), "asset_id", "left_anti")
    return findings.blur_items(rest, BALANCED.with_(blur=quality.BlurPolicy(0.3, 0.4))).select("finding_id", "asset_id")


FRAMES_SQL = """k AS (SELECT CAST(range AS INT) AS k, CAST(32 + range % 9 AS INT) AS w, CAST(32 + range % 7 AS INT) AS h FROM range(24)),
px AS (SELECT k, w, h, CAST(i % w AS INT) AS x, CAST(i // w AS INT) AS y, CAST((i * 17 + k * 29 + (i // w) * 11) & 255 AS DOUBLE) AS v FROM (SELECT *, unnest(range(w * h)) AS i FROM k))"""


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT c.k, c.x, c.y,
 max(CASE WHEN n.x = c.x - 1 AND n.y = c.y - 1 THEN n.v / 255.0 END) AS tl, max(CASE WHEN n.x = c.x AND n.y = c.y - 1 THEN n.v / 255.0 END) AS t, max(CASE WHEN n.x = c.x + 1 AND n.y = c.y - 1 THEN n.v / 255.0 END) AS tr,
 max(CASE WHEN n.x = c.x - 1 AND n.y = c.y THEN n.v / 255.0 END) AS l, max(CASE WHEN n.x = c.x AND n.y = c.y THEN n.v / 255.0 END) AS m, max(CASE WHEN n.x = c.x + 1 AND n.y = c.y THEN n.v / 255.0 END) AS r,
 max(CASE WHEN n.x = c.x - 1 AND n.y = c.y + 1 THEN n.v / 255.0 END) AS bl, max(CASE WHEN n.x = c.x AND n.y = c.y + 1 THEN n.v / 255.0 END) AS b, max(CASE WHEN n.x = c.x + 1 AND n.y = c.y + 1 THEN n.v / 255.0 END) AS br,
 max(n.v) / 255.0 - min(n.v) / 255.0 AS span
 FROM px c JOIN px n ON n.k = c.k AND n.x BETWEEN c.x - 1 AND c.x + 1 AND n.y BETWEEN c.y - 1 AND c.y + 1 WHERE c.x BETWEEN 1 AND c.w - 2 AND c.y BETWEEN 1 AND c.h - 2 GROUP BY ALL),
z AS (SELECT k, t + l - 4.0 * m + r + b AS lap, -tl + tr - 2.0 * l + 2.0 * r - bl + br AS gx, -tl - 2.0 * t - tr + bl + 2.0 * b + br AS gy, span FROM s)
SELECT concat('frame:', lpad(CAST(k AS VARCHAR), 3, '0')) AS asset_id, round(avg(lap * lap) - avg(lap) * avg(lap), 9) AS laplacian_variance,
 round(avg(CASE WHEN sqrt(gx * gx + gy * gy) / (4.0 * 1.4142135623730951) >= 0.125 THEN 1.0 ELSE 0.0 END), 9) AS edge_density, round(avg(CASE WHEN span >= 0.10 THEN 1.0 ELSE 0.0 END), 9) AS local_texture_support FROM z GROUP BY k""")
def blur_signals(spark: SparkSession, sf: str) -> DataFrame:
    names = ["laplacian_variance", "edge_density", "local_texture_support"]
    return analyze_frames(P.generated_frames(spark)).select("asset_id", *(F.round(c, 9).alias(c) for c in names))


@query(f"""WITH {FRAMES_SQL}, t AS (SELECT range AS c FROM range(32)),
xw AS (SELECT k, x, t.c AS tx, least(x + 1.0, (t.c + 1) * CAST(w AS DOUBLE) / 32) - greatest(CAST(x AS DOUBLE), t.c * CAST(w AS DOUBLE) / 32) AS o FROM (SELECT DISTINCT k, w, x FROM px) JOIN t ON least(x + 1.0, (t.c + 1) * CAST(w AS DOUBLE) / 32) > greatest(CAST(x AS DOUBLE), t.c * CAST(w AS DOUBLE) / 32)),
yw AS (SELECT k, y, t.c AS ty, least(y + 1.0, (t.c + 1) * CAST(h AS DOUBLE) / 32) - greatest(CAST(y AS DOUBLE), t.c * CAST(h AS DOUBLE) / 32) AS o FROM (SELECT DISTINCT k, h, y FROM px) JOIN t ON least(y + 1.0, (t.c + 1) * CAST(h AS DOUBLE) / 32) > greatest(CAST(y AS DOUBLE), t.c * CAST(h AS DOUBLE) / 32)),
n AS (SELECT px.k, tx, ty, sum(v * xw.o * yw.o) / (px.w / 32.0 * (px.h / 32.0)) AS v FROM px JOIN xw ON xw.k = px.k AND xw.x = px.x JOIN yw ON yw.k = px.k AND yw.y = px.y GROUP BY px.k, px.w, px.h, tx, ty),
f AS (SELECT CAST(range AS INT) AS i, CAST(range // 8 AS INT) AS vf, CAST(range % 8 AS INT) AS hf FROM range(64)),
d AS (SELECT k, i, sum(v * cos((2 * ty + 1) * vf * pi() / 64) * cos((2 * tx + 1) * hf * pi() / 64)) * CASE WHEN vf = 0 THEN 1 / sqrt(32.0) ELSE sqrt(2.0 / 32) END * CASE WHEN hf = 0 THEN 1 / sqrt(32.0) ELSE sqrt(2.0 / 32) END AS c FROM n, f GROUP BY k, i, vf, hf),
e AS (SELECT k, i, CASE WHEN abs(c) < 1e-6 THEN 0.0 ELSE c END AS c FROM d),
q AS (SELECT k, list_sort(list(c) FILTER (WHERE i > 0))[32] AS med FROM e GROUP BY k)
SELECT concat('frame:', lpad(CAST(e.k AS VARCHAR), 3, '0')) AS asset_id, CAST(sum(CASE WHEN c > med AND i > 0 THEN (1::HUGEINT << (63 - i)) WHEN c > med THEN -9223372036854775808::HUGEINT ELSE 0 END) AS BIGINT) AS perceptual_hash FROM e JOIN q ON q.k = e.k GROUP BY e.k""")
def perceptual_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return analyze_frames(P.generated_frames(spark)).select("asset_id", "perceptual_hash")


@query("""SELECT event_id, CAST(((event_id % 256) * 77 + (event_id * 7 % 256) * 150 + (event_id * 13 % 256) * 29 + 128) >> 8 AS INT) AS luma FROM events""")
def luma(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return P.table(spark, sf, "events").select("event_id", X.luma(e % 256, e * 7 % 256, e * 13 % 256).alias("luma"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    return P.table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))


# ---- the incremental index

OLD_COLUMNS = "s.asset_id, s.width, s.height, s.byte_count, s.captured_at_ms, s.is_favorite, s.is_edited"


@query(f"""WITH {P.DOCS_SQL}, {P.INDEX_SQL}, j AS (SELECT c.*, s.asset_id IS NOT NULL AND s.source_signature = c.content_signature AND s.analyzer_version = 1 AS same FROM current_ c LEFT JOIN stored s ON s.asset_id = c.asset_id)
SELECT asset_id, content_signature, width, height, byte_count, CASE WHEN same THEN 'reusable' ELSE 'changed' END AS part FROM j""")
def partition_changed(spark: SparkSession, sf: str) -> DataFrame:
    old, new = index.partition_changed(P.descriptors(spark, sf), P.stored_index(spark, sf), 1)
    both = old.withColumn("part", F.lit("reusable")).unionByName(new.withColumn("part", F.lit("changed")))
    return both.select("asset_id", "content_signature", "width", "height", "byte_count", "part")


@query(f"""WITH {P.DOCS_SQL}, {P.INDEX_SQL}, u AS (SELECT asset_id, content_signature AS source_signature, 3 AS analyzer_version, NULL AS sha256 FROM current_ WHERE doc_id % 3 = 0)
SELECT asset_id, source_signature, CAST(analyzer_version AS INT) AS analyzer_version, sha256 FROM stored WHERE asset_id NOT IN (SELECT asset_id FROM u) UNION ALL SELECT * FROM u""")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.descriptors(spark, sf).where(F.substring("asset_id", 5, 8).cast("long") % 3 == 0)
    rows = rows.select("asset_id", F.col("content_signature").alias("source_signature"), F.lit(3).alias("analyzer_version"), F.lit(None).cast("string").alias("sha256"))
    return index.upsert(P.stored_index(spark, sf).select(rows.columns), rows)


@query(f"""WITH {P.DOCS_SQL}, {P.INDEX_SQL} SELECT asset_id, CASE WHEN doc_id % 7 = 1 THEN concat('new-', doc_id) ELSE sha256 END AS sha256 FROM stored""")
def attach_digests(spark: SparkSession, sf: str) -> DataFrame:
    base = P.stored_index(spark, sf)
    d = F.substring("asset_id", 5, 8).cast("long")
    return index.attach_digests(base, base.where(d % 7 == 1).select("asset_id", F.concat(F.lit("new-"), d.cast("string")).alias("sha256"))).select("asset_id", "sha256")


@query(f"""WITH {P.DOCS_SQL}, {P.INDEX_SQL} SELECT asset_id, source_signature FROM stored WHERE asset_id IN (SELECT asset_id FROM current_)""")
def purge(spark: SparkSession, sf: str) -> DataFrame:
    return index.purge_except(P.stored_index(spark, sf), P.descriptors(spark, sf)).select("asset_id", "source_signature")


@query(f"""WITH {P.DOCS_SQL}, {P.INDEX_SQL} SELECT asset_id, source_signature FROM stored WHERE asset_id NOT IN (SELECT asset_id FROM current_ WHERE doc_id % 5 = 2)""")
def invalidate(spark: SparkSession, sf: str) -> DataFrame:
    ids = P.descriptors(spark, sf).where(F.substring("asset_id", 5, 8).cast("long") % 5 == 2)
    return index.invalidate(P.stored_index(spark, sf), ids).select("asset_id", "source_signature")


GROUPED_SQL = """gm AS (SELECT concat('g', doc_id % 50) AS group_id, asset_id FROM photo_docs), gone AS (SELECT asset_id FROM photo_docs WHERE doc_id % 97 = 5)"""


@query(f"""WITH {P.DOCS_SQL}, {GROUPED_SQL} SELECT group_id, count(*) AS members FROM gm WHERE group_id NOT IN (SELECT group_id FROM gm WHERE asset_id IN (SELECT asset_id FROM gone)) GROUP BY group_id""")
def groups_without(spark: SparkSession, sf: str) -> DataFrame:
    d = F.substring("asset_id", 5, 8).cast("long")
    docs = P.photo_docs(spark, sf)
    members = docs.select(F.concat(F.lit("g"), (d % 50).cast("string")).alias("group_id"), "asset_id")
    _, left = index.drop_groups_of(members.select("group_id").distinct(), members, docs.where(d % 97 == 5))
    return left.groupBy("group_id").agg(F.count("*").alias("members"))


@query("""SELECT row_number() OVER (ORDER BY event_id) AS id, event_id AS completed_at_ms, CAST(user_id AS INT) AS exact_count FROM events WHERE event_type = 'purchase'""")
def cleanup_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("completed_at_ms"), F.col("user_id").cast("int").alias("exact_count"), F.lit(0).alias("near_count"), F.lit(0).alias("blur_count"), F.lit(0).cast("long").alias("confirmed_estimated_bytes"))
    empty = spark.createDataFrame([], index.HISTORY)
    return index.history_newest_first(index.append_history(empty, rows)).select("id", "completed_at_ms", "exact_count")


@query(f"""WITH RECURSIVE {EXACT_SQL}, x AS (SELECT DISTINCT se, le, perceptual_hash, sha256, size_key FROM g), rest AS (SELECT * FROM photo_docs WHERE asset_id NOT IN (SELECT asset_id FROM g)), {_clusters_sql("rest", LOOSE_BLUR)},
n AS (SELECT (SELECT count(*) FROM x) AS exact_count, (SELECT count(DISTINCT cluster_id) FROM cl WHERE size > 1) AS near_count, (SELECT count(*) FROM rest WHERE {_blur_sql(LOOSE_BLUR)}) AS blur_count)
SELECT *, exact_count + near_count + blur_count AS total_count FROM n""")
def review_totals(spark: SparkSession, sf: str) -> DataFrame:
    return findings.assemble(P.photo_docs(spark, sf), LOOSE_BLUR).summary.select("exact_count", "near_count", "blur_count", "total_count")


# ---- sources and changes

@query("""SELECT concat('android-media:', event_id) AS asset_id, CASE WHEN value < 5 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS byte_count, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id * 1000 END AS captured_at_ms,
 concat('android-v1|w=', 10 + event_id % 50, '|h=', 20 + event_id % 30, '|s=', CASE WHEN value < 5 THEN 'null' ELSE CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) END, '|taken=', CASE WHEN user_id % 5 = 0 THEN 'null' ELSE CAST(user_id * 1000 AS VARCHAR) END,
 '|modified=', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE CAST(event_id AS VARCHAR) END, '|orientation=', ((event_id % 8 - 4) * 90 % 360 + 360) % 360, '|favorite=', CASE WHEN event_id % 6 = 0 THEN 'true' ELSE 'false' END) AS content_signature
FROM events WHERE event_type <> 'error'""")
def access_enumeration(spark: SparkSession, sf: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    rows = P.table(spark, sf, "events").select(
        e.alias("_id"), (F.lit(10) + e % 50).alias("width"), (F.lit(20) + e % 30).alias("height"), F.when(F.col("value") < 5, F.lit(-1).cast("long")).otherwise(F.floor(F.col("value") * 10)).alias("_size"),
        F.when(u % 5 != 0, u * 1000).otherwise(F.lit(0)).alias("datetaken"), F.when(e % 3 != 0, e).alias("date_modified"), ((e % 8 - 4) * 90).alias("orientation"),
        F.when(e % 6 == 0, F.lit(1)).when(e % 6 == 1, F.lit(0)).alias("is_favorite"), F.when(F.col("event_type") == "error", 3).otherwise(1).alias("media_type"),
    )
    return media.enumerate_android(rows).select("asset_id", "byte_count", "captured_at_ms", "content_signature")


@query("""SELECT concat('ios-photo:', event_id) AS asset_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id * 1500 END AS captured_at_ms, event_id % 6 = 0 AS is_favorite, event_id % 4 = 1 AS is_edited,
 concat('ios-v1|w=', 10 + event_id % 50, '|h=', 20 + event_id % 30, '|created=', CASE WHEN user_id % 5 = 0 THEN 'null' ELSE CAST(user_id * 1500 AS VARCHAR) END, '|modified=null|favorite=', CASE WHEN event_id % 6 = 0 THEN 'true' ELSE 'false' END, '|edited=', CASE WHEN event_id % 4 = 1 THEN 'true' ELSE 'false' END) AS content_signature FROM events""")
def ios_enumeration(spark: SparkSession, sf: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    rows = P.table(spark, sf, "events").select(
        e.cast("string").alias("localIdentifier"), (F.lit(10) + e % 50).alias("width"), (F.lit(20) + e % 30).alias("height"), F.when(u % 5 != 0, u * 1.5).alias("createdSeconds"), F.lit(None).cast("double").alias("modifiedSeconds"),
        (e % 6 == 0).alias("isFavorite"), F.when(e % 4 == 1, F.lit(True)).when(e % 4 == 2, F.lit(False)).alias("hasAdjustments"),
    )
    return media.enumerate_ios(rows).select("asset_id", "captured_at_ms", "is_favorite", "is_edited", "content_signature")


@query(f"""WITH {P.DOCS_SQL}, {P.INDEX_SQL} SELECT asset_id, analyzer_version, perceptual_hash FROM stored WHERE source_signature = 'v1|103' AND analyzer_version = 1""")
def reusable_rows(spark: SparkSession, sf: str) -> DataFrame:
    return index.reusable(P.stored_index(spark, sf), "v1|103", 1).select("asset_id", "analyzer_version", "perceptual_hash")


@query("""WITH s AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM s)
SELECT user_id, CAST(burst AS BIGINT) AS burst, epoch_us(min(ts)) AS started_us, count(*) AS n, bool_or(event_type = 'error') AS access_may_have_changed,
 coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR)) FILTER (WHERE event_type <> 'error'), '') AS ids FROM b GROUP BY user_id, burst""")
def change_debounce(spark: SparkSession, sf: str) -> DataFrame:
    bursts = debounced(P.changes(spark, sf), "user_id", "30 minutes")
    return bursts.select("user_id", F.col("burst").cast("long").alias("burst"), F.unix_micros(F.col("started").cast("timestamp")).alias("started_us"), "n", "access_may_have_changed", joined("asset_ids").alias("ids"))


# ---- policy search

PAIRS_SQL = f"""{P.VECS_SQL}, pr AS (SELECT a.asset_id AS f, b.asset_id AS s, bit_count(xor(a.perceptual_hash, b.perceptual_hash)) AS d, abs(a.captured_at_ms - b.captured_at_ms) AS gap,
 abs(CAST(least(a.width, a.height) AS DOUBLE) / greatest(a.width, a.height) - CAST(least(b.width, b.height) AS DOUBLE) / greatest(b.width, b.height)) AS ar, (a.vec_id + b.vec_id) % 3 = 0 AND bit_count(xor(a.perceptual_hash, b.perceptual_hash)) <= 20 AS lab
 FROM photo_vecs a JOIN photo_vecs b ON a.asset_id < b.asset_id)"""


def _labelled(spark: SparkSession, sf: str):
    assets = P.photo_vecs(spark, sf).withColumn("sha256", F.col("asset_id"))
    v = lambda c: F.substring(c, 5, 8).cast("long")
    near = candidates.complete_pairs(assets, FAR.with_(max_perceptual_distance=20, max_capture_gap_ms=MAX_LONG))
    return assets, near.where((v("first_id") + v("second_id")) % 3 == 0).select("first_id", "second_id")


@query(f"""WITH {PAIRS_SQL}, p AS (SELECT *, d <= 19 AND coalesce(gap <= 180000, true) AND ar <= 0.04 AS hit FROM pr)
SELECT count(*) FILTER (WHERE hit AND lab) AS true_positive, count(*) FILTER (WHERE hit AND NOT lab) AS false_positive, count(*) FILTER (WHERE NOT hit AND lab) AS false_negative,
 CASE WHEN count(*) FILTER (WHERE hit) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE hit AND lab) / CAST(count(*) FILTER (WHERE hit) AS DOUBLE) END AS precision,
 CASE WHEN count(*) FILTER (WHERE lab) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE hit AND lab) / CAST(count(*) FILTER (WHERE lab) AS DOUBLE) END AS recall FROM p""")
def quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    assets, labels = _labelled(spark, sf)
    return quality.metrics(quality.near_predictions(quality.pair_features(assets), BALANCED), labels, quality.PAIR)


@query(f"""WITH {PAIRS_SQL}, g AS (SELECT d.range AS max_distance, w.w * 1000 AS max_gap_ms, a.a AS max_aspect FROM range(21) d, (SELECT unnest([15, 30, 60, 90, 120, 180]) AS w) w, (SELECT unnest([0.005, 0.01, 0.02, 0.04]::DOUBLE[]) AS a) a),
h AS (SELECT g.*, lab, d <= max_distance AND coalesce(gap <= max_gap_ms, true) AND ar <= max_aspect AS hit FROM g, pr WHERE d <= 20)
SELECT CAST(max_distance AS INT) AS max_distance, CAST(max_gap_ms AS BIGINT) AS max_gap_ms, max_aspect, count(*) FILTER (WHERE hit AND lab) AS true_positive, count(*) FILTER (WHERE hit AND NOT lab) AS false_positive, count(*) FILTER (WHERE NOT hit AND lab) AS false_negative FROM h GROUP BY ALL""")
def policy_grid(spark: SparkSession, sf: str) -> DataFrame:
    assets, labels = _labelled(spark, sf)
    return quality.near_grid(spark, assets, labels).select("max_distance", "max_gap_ms", "max_aspect", "true_positive", "false_positive", "false_negative")


@query("""SELECT * FROM (VALUES ('exact', 4, 0, 0), ('near', 24, 1, 0), ('blur', 2, 0, 1)) t(kind, true_positive, false_positive, false_negative)""")
def corpus_metrics(spark: SparkSession, sf: str) -> DataFrame:
    c = synthetic.development_corpus(spark)
    m = quality.evaluate(c["assets"], c["exact"], c["near"], c["blur"], BALANCED)
    return m.select("kind", *(F.col(x).cast("int").alias(x) for x in ("true_positive", "false_positive", "false_negative")))
