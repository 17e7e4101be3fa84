"""The corpus pipeline: a list of stages over documents, each written as Parquet and read again by the next.

Documents that the quality classifier rejects go; of each class of near duplicates the first stays; passages that
stood earlier are cut out of texts; contaminated documents go; what is left is packed into training sequences.
Documents that a stage does not change keep all their columns as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumagrain.llm.common import table
from lumagrain.storage import intermediate, stored
from lumagrain.llm.decontamination import decontaminate
from lumagrain.llm.near_dedup import without_near_duplicates
from lumagrain.llm.packing import pack
from lumagrain.llm.quality_classifier import resample
from lumagrain.llm.substring_dedup import remove_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resample(docs, table(spark, sf_dir, "labels")).where("kept").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut texts are their kept words joined by one space; texts without a repeated passage stay as they are."""
    cut = remove_passages(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns({"text": text, "n_chars": size}).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]
ORACLE_SQL = None  # models, sketches and tokenizers are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage stored on its way is removed once its result is."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with intermediate(spark):
            docs = stored(stage(spark, docs, sf_dir), kept=True)
    return docs
