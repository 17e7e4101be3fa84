"""Schemas of the tables, and the guards that data must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(text: str) -> T.StructType:
    """A schema from "name kind, ..."; needs no session, as a parsed DDL text would."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (field.split() for field in text.split(", "))])


DESCRIPTORS = _struct("asset_id string, content_signature string, width int, height int, byte_count long, captured_at_ms long, is_favorite boolean, is_edited boolean")
ANALYSIS = _struct(
    "asset_id string, source_signature string, analyzer_version int, width int, height int, byte_count long, captured_at_ms long, is_favorite boolean, is_edited boolean, "
    "perceptual_hash long, sha256 string, laplacian_variance double, edge_density double, local_texture_support double, analyzed_at_ms long"
)
HISTORY = _struct("id long, completed_at_ms long, exact_count int, near_count int, blur_count int, confirmed_estimated_bytes long")
GROUPS = _struct("group_id string, kind string, policy_key string, estimated_recoverable_bytes long, reviewed boolean")
MEMBERS = _struct("group_id string, asset_id string, position int, is_keeper boolean, selected_for_removal boolean")
FRAMES = _struct("asset_id string, width int, height int, pixels binary")
CHANGES = _struct("ts timestamp, kind string, asset_ids array<string>")


class InvariantError(ValueError):
    """Data that the engine's invariants exclude."""


def require_unique(df: DataFrame, key: str = "asset_id") -> DataFrame:
    """The frame, if every key is there once and not blank. One pass that sums before it shuffles."""
    bad = df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull() | (F.trim(key) == "")).limit(1).collect()
    if bad:
        raise InvariantError(f"{key} must be unique and not blank: {bad[0][key]!r} stands {bad[0]['count']} times")
    return df


def require_valid_analysis(df: DataFrame) -> DataFrame:
    """The analysis rows, if all values are in their ranges."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("laplacian_variance", "edge_density", "local_texture_support")]
    good = finite[0] & finite[1] & finite[2] & F.col("local_texture_support").between(0, 1) & (F.col("width") > 0) & (F.col("height") > 0)
    good &= (F.col("analyzer_version") >= 0) & (F.col("analyzed_at_ms") >= 0) & (F.trim("source_signature") != "")
    good &= F.coalesce(F.col("byte_count") >= 0, F.lit(True)) & F.coalesce(F.trim("sha256") != "", F.lit(True))
    bad = df.where(~F.coalesce(good, F.lit(False))).select("asset_id").limit(1).collect()
    if bad:
        raise InvariantError(f"invalid analysis row {bad[0][0]!r}")
    return df
