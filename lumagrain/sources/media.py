"""Photo libraries as frames: enumeration of two platforms' rows, identifiers, original bytes, luminance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumagrain.functions.expressions import LUMA
from lumagrain.schema import DESCRIPTORS, FRAMES

# Prefixes of ids, and below the fields of signatures and their order.
ANDROID_PREFIX, IOS_PREFIX = "android-media:", "ios-photo:"
READABLE = ("Full", "Partial")
MOST_BYTES = 1 << 30  # of an original that is held in one cell


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("null"))


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


def access_state(full: Column, partial: Column, denied: Column, restricted: Column | None = None) -> Column:
    """Full, Partial, Denied, Restricted or NotDetermined from permission columns."""
    restricted = F.lit(False) if restricted is None else restricted
    return F.when(full, "Full").when(partial, "Partial").when(restricted, "Restricted").when(denied, "Denied").otherwise("NotDetermined")


def android_asset_id(media_id: Column) -> Column:
    return F.when(media_id >= 0, F.concat(F.lit(ANDROID_PREFIX), media_id.cast("string"))).otherwise(F.raise_error(F.lit("negative media id")))


def android_media_id(asset_id: Column) -> Column:
    digits = F.regexp_extract(asset_id, rf"^{ANDROID_PREFIX}(\d+)$", 1)
    return F.when(digits != "", digits.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not an android asset id: "), asset_id)))


def ios_asset_id(identifier: Column) -> Column:
    return F.when(F.trim(identifier) != "", F.concat(F.lit(IOS_PREFIX), identifier)).otherwise(F.raise_error(F.lit("blank identifier")))


def ios_identifier(asset_id: Column) -> Column:
    rest = F.substring(asset_id, len(IOS_PREFIX) + 1, 1 << 30)
    return F.when(asset_id.startswith(IOS_PREFIX) & (F.trim(rest) != ""), rest).otherwise(F.raise_error(F.concat(F.lit("not an ios asset id: "), asset_id)))


def enumerate_android(rows: DataFrame, access: str = "Full") -> DataFrame:
    """Descriptors of MediaStore rows (_id, width, height, _size, datetaken, date_modified, orientation, is_favorite,
    media_type): images with a size, newest first, unknown dates last, then by id. No readable access gives no rows."""
    if access not in READABLE:
        return rows.sparkSession.createDataFrame([], DESCRIPTORS)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing {c}"))).otherwise(F.col(c))
    images = rows.where("media_type = 1").select(need("_id").alias("_id"), need("width").cast("int").alias("width"), need("height").cast("int").alias("height"), "_size", "datetaken", "date_modified", "orientation", "is_favorite")
    images = images.where("width > 0 AND height > 0").orderBy(F.desc_nulls_last("datetaken"), F.asc("_id"))
    size = F.when(F.col("_size") >= 0, F.col("_size"))
    turned = F.pmod(F.coalesce("orientation", F.lit(0)), F.lit(360))
    favorite = F.coalesce(F.col("is_favorite").cast("boolean"), F.lit(False))
    taken, modified = _positive(F.col("datetaken")), _positive(F.col("date_modified"))
    parts = (("w", F.col("width")), ("h", F.col("height")), ("s", size), ("taken", taken), ("modified", modified), ("orientation", turned), ("favorite", favorite))
    signature = F.concat(F.lit("android-v1"), *(F.concat(F.lit(f"|{k}="), _text(v)) for k, v in parts))
    return images.select(android_asset_id(F.col("_id")).alias("asset_id"), signature.alias("content_signature"), "width", "height", size.cast("long").alias("byte_count"), taken.cast("long").alias("captured_at_ms"), favorite.alias("is_favorite"), F.lit(False).alias("is_edited"))


def enumerate_ios(rows: DataFrame, access: str = "Full") -> DataFrame:
    """Descriptors of PhotoKit rows (localIdentifier, width, height, createdSeconds, modifiedSeconds, isFavorite,
    hasAdjustments): images with a size, newest first, unknown dates last, then by id. Sizes are never known, and dates
    before 1970 stay."""
    if access not in READABLE:
        return rows.sparkSession.createDataFrame([], DESCRIPTORS)
    ms = lambda c: F.floor(F.col(c) * 1000.0 + 0.5).cast("long")
    edited = F.coalesce(F.col("hasAdjustments"), F.lit(False))
    parts = (("w", F.col("width")), ("h", F.col("height")), ("created", ms("createdSeconds")), ("modified", ms("modifiedSeconds")), ("favorite", F.col("isFavorite")), ("edited", edited))
    signature = F.concat(F.lit("ios-v1"), *(F.concat(F.lit(f"|{k}="), _text(v)) for k, v in parts))
    out = rows.where("width > 0 AND height > 0").select(ios_asset_id(F.col("localIdentifier")).alias("asset_id"), signature.alias("content_signature"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.lit(None).cast("long").alias("byte_count"), ms("createdSeconds").alias("captured_at_ms"), F.col("isFavorite").alias("is_favorite"), edited.alias("is_edited"))
    return out.orderBy(F.desc_nulls_last("captured_at_ms"), F.asc("asset_id"))


def original_bytes(spark: SparkSession, path: str, wanted: DataFrame | None = None, most: int = MOST_BYTES) -> DataFrame:
    """(asset_id, content): files named by asset. With `wanted`, contents are read only for those assets: paths are
    listed first, and the content column is pruned until then. A file of more than `most` bytes is not read: its content
    is null, as of one that cannot be read, and a scan skips it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract(F.col("path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("asset_id"), "path")
    if wanted is not None:
        named = named.join(wanted.select("asset_id"), "asset_id", "left_semi")
    contents = files.where(F.col("length") <= most).select("path", "content")
    return named.join(contents, "path", "left").select("asset_id", "content")


def preferred_resource(resources: DataFrame) -> DataFrame:
    """Of each asset's resources (asset_id, resource_type, content): the full-size photo, else the photo."""
    rank = F.when(F.col("resource_type") == "FullSizePhoto", 0).when(F.col("resource_type") == "Photo", 1)
    best = resources.where(rank.isNotNull()).groupBy("asset_id").agg(F.min_by("content", rank).alias("content"))
    return best


def image_luma(images: DataFrame, id_column: str = "asset_id") -> DataFrame:
    """Luma frames of Spark's image source rows (image: height, width, nChannels, data as BGR, BGRA or grey bytes). A
    null image, or one whose bytes don't fit its size, has null pixels."""
    kind = images.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = []
            for w, h, n, raw in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), batch.column(4), strict=True):
                data = np.frombuffer(raw.as_buffer(), np.uint8) if raw.is_valid else None
                if data is None or not w or not h or n not in (1, 3, 4) or len(data) != w * h * n:
                    pixels.append(None)
                elif n == 1:
                    pixels.append(data.tobytes())
                else:
                    blue, green, red = (data[k::n].astype(np.uint32) for k in range(3))
                    pixels.append(((LUMA[0] * red + LUMA[1] * green + LUMA[2] * blue + 128) >> 8).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(pixels, pa.binary())], names=[id_column, "width", "height", "pixels"])

    parts = images.select(id_column, *(F.col(f"image.{c}") for c in ("width", "height", "nChannels", "data")))
    return parts.mapInArrow(run, f"`{id_column}` {kind}, width int, height int, pixels binary")


def bytes_of(values: Column) -> Column:
    """A binary of an array of numbers 0..255."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def text_luma(spark: SparkSession, path: str, asset_id: str, width: int, height: int) -> DataFrame:
    """One luma frame from text files of white-space separated numbers, in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("v"))
    values = F.transform("v", lambda x: x.cast("int"))
    return lines.select(F.lit(asset_id).alias("asset_id"), F.lit(width).alias("width"), F.lit(height).alias("height"), bytes_of(values).alias("pixels")).to(FRAMES)
