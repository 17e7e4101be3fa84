"""Builders of analysis rows with the tests' defaults."""

from lumagrain.policy import MAX_LONG, AnalysisPolicy, BlurPolicy
from lumagrain.schema import ANALYSIS, DESCRIPTORS

OPEN = AnalysisPolicy("Balanced", 8, MAX_LONG, 1.0, BlurPolicy(0.1, 0.1))
SHARP, BLURRED = (1.0, 1.0, 1.0), (0.01, 0.01, 1.0)


def record(asset_id, hash_=0, sha=None, bytes_=10, w=100, h=100, captured=None, fav=False, edited=False, evidence=SHARP, signature="s", version=1):
    return (asset_id, signature, version, w, h, bytes_, captured, fav, edited, hash_, sha, *evidence, 1)


def analysis(spark, rows):
    return spark.createDataFrame(rows, ANALYSIS)


def descriptor(asset_id, signature="s", w=100, h=100, bytes_=10, captured=None, fav=False, edited=False):
    return (asset_id, signature, w, h, bytes_, captured, fav, edited)


def descriptors(spark, rows):
    return spark.createDataFrame(rows, DESCRIPTORS)
