"""Deterministic projections of the driver's tables that stand in for photo libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumagrain.sources.media import bytes_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photo_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis rows from documents: the digest is the text's, the hash its first 60 bits."""
    d, n = F.col("doc_id"), F.col("n_chars")
    size = F.octet_length("text").cast("long") + F.when(d % 5 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc:"), F.lpad(d.cast("string"), 8, "0")).alias("asset_id"),
        (F.lit(100) + n % 7).cast("int").alias("width"),
        (F.lit(80) + n % 5).cast("int").alias("height"),
        F.when(d % 11 != 0, size).alias("byte_count"),
        F.when(d % 13 != 0, d * 1000).alias("captured_at_ms"),
        (d % 17 == 0).alias("is_favorite"),
        (d % 19 == 0).alias("is_edited"),
        F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long").alias("perceptual_hash"),
        F.sha2("text", 256).alias("sha256"),
        ((d % 101).cast("double") / 101).alias("laplacian_variance"),
        ((d % 53).cast("double") / 53).alias("edge_density"),
        ((d % 100).cast("double") / 1000).alias("local_texture_support"),
    )


def photo_vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis rows from embeddings: the hash is the signs of the 64 floats."""
    v = F.col("vec_id")
    signs = F.aggregate("embedding", F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("vec:"), F.lpad(v.cast("string"), 8, "0")).alias("asset_id"),
        (F.lit(100) + v % 3).cast("int").alias("width"),
        F.lit(100).alias("height"),
        F.when(v % 7 != 0, v * 10).alias("byte_count"),
        F.when(v % 10 != 0, F.col("label") * 100000 + v * 500).alias("captured_at_ms"),
        (v % 17 == 0).alias("is_favorite"),
        (v % 19 == 0).alias("is_edited"),
        signs.alias("perceptual_hash"),
        F.lit(None).cast("string").alias("sha256"),
        ((v % 101).cast("double") / 101).alias("laplacian_variance"),
        ((v % 53).cast("double") / 53).alias("edge_density"),
        ((v % 100).cast("double") / 1000).alias("local_texture_support"),
    )


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current listing of photo_docs: a new signature where doc_id % 6 = 0, gone where doc_id % 10 = 9."""
    p = photo_docs(spark, sf_dir).withColumn("_d", F.substring("asset_id", 5, 8).cast("long"))
    signature = F.concat(F.when(F.col("_d") % 6 == 0, F.lit("v2|")).otherwise(F.lit("v1|")), F.col("width").cast("string"))
    kept = p.where("_d % 10 <> 9").withColumn("content_signature", signature)
    return kept.select("asset_id", "content_signature", "width", "height", "byte_count", "captured_at_ms", "is_favorite", "is_edited")


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rows: photo_docs without doc_id % 4 = 0, with old signatures."""
    p = photo_docs(spark, sf_dir).withColumn("_d", F.substring("asset_id", 5, 8).cast("long")).where("_d % 4 <> 0")
    return p.withColumns({"source_signature": F.concat(F.lit("v1|"), F.col("width").cast("string")), "analyzer_version": (F.lit(1) + (F.col("_d") % 8 == 0).cast("int")), "analyzed_at_ms": F.col("_d")}).drop("_d")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change rows from events: the id is the event's; an error is the coarse signal."""
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select("user_id", "ts", F.when(error, "AccessMayHaveChanged").otherwise("Changed").alias("kind"), F.when(~error, F.array(F.col("event_id").cast("string"))).otherwise(F.array().cast("array<string>")).alias("asset_ids"))


def generated_frames(spark: SparkSession, count: int = 24) -> DataFrame:
    """Luma frames of varying size from a formula of the pixel's index."""
    k = F.col("k")
    sized = spark.range(count).select(F.col("id").cast("int").alias("k")).withColumns({"width": F.lit(32) + k % 9, "height": F.lit(32) + k % 7})
    pixel = F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda i: (i * 17 + k * 29 + F.floor(i / F.col("width")).cast("int") * 11).bitwiseAND(F.lit(255)))
    return sized.select(F.concat(F.lit("frame:"), F.lpad(k.cast("string"), 3, "0")).alias("asset_id"), "width", "height", bytes_of(pixel).alias("pixels"))


# The same projections for DuckDB, as common table expressions.
DOCS_SQL = """photo_docs AS (SELECT concat('doc:', lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS asset_id, doc_id,
 CAST(100 + n_chars % 7 AS INT) AS width, CAST(80 + n_chars % 5 AS INT) AS height,
 CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(octet_length(encode(text)) AS BIGINT) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END END AS byte_count,
 CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id * 1000 END AS captured_at_ms,
 doc_id % 17 = 0 AS is_favorite, doc_id % 19 = 0 AS is_edited,
 CAST('0x' || substr(sha256(text), 1, 15) AS BIGINT) AS perceptual_hash, sha256(text) AS sha256,
 CAST(doc_id % 101 AS DOUBLE) / 101 AS laplacian_variance, CAST(doc_id % 53 AS DOUBLE) / 53 AS edge_density,
 CAST(doc_id % 100 AS DOUBLE) / 1000 AS local_texture_support FROM documents)"""
VECS_SQL = """photo_vecs AS (SELECT concat('vec:', lpad(CAST(vec_id AS VARCHAR), 8, '0')) AS asset_id, vec_id,
 CAST(100 + vec_id % 3 AS INT) AS width, 100 AS height,
 CASE WHEN vec_id % 7 = 0 THEN NULL ELSE vec_id * 10 END AS byte_count,
 CASE WHEN vec_id % 10 = 0 THEN NULL ELSE label * 100000 + vec_id * 500 END AS captured_at_ms,
 vec_id % 17 = 0 AS is_favorite, vec_id % 19 = 0 AS is_edited,
 CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << (63 - i)::BIGINT) ELSE 0 END)) AS BIGINT)
   + CASE WHEN embedding[1] > 0 THEN -9223372036854775808 ELSE 0 END AS perceptual_hash,
 CAST(vec_id % 101 AS DOUBLE) / 101 AS laplacian_variance, CAST(vec_id % 53 AS DOUBLE) / 53 AS edge_density,
 CAST(vec_id % 100 AS DOUBLE) / 1000 AS local_texture_support FROM embeddings)"""
INDEX_SQL = """stored AS (SELECT p.*, concat('v1|', width) AS source_signature, 1 + CAST(doc_id % 8 = 0 AS INT) AS analyzer_version, doc_id AS analyzed_at_ms FROM photo_docs p WHERE doc_id % 4 <> 0),
current_ AS (SELECT p.*, concat(CASE WHEN doc_id % 6 = 0 THEN 'v2|' ELSE 'v1|' END, width) AS content_signature FROM photo_docs p WHERE doc_id % 10 <> 9)"""
