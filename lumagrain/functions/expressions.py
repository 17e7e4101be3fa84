"""Column expressions of the analysis. All stay in the JVM and are safe under ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumagrain.policy import MAX_LONG, AnalysisPolicy, BlurPolicy

# The least texture of a verdict, and the weights of red, green and blue.
MIN_TEXTURE = 0.01
LUMA = (77, 150, 29)
MIN_LONG = -MAX_LONG - 1


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def band_layout(distance: int) -> list[tuple[int, int]]:
    """(start bit, bits) of distance + 1 contiguous bands from the lowest bit: two hashes within the distance agree on
    at least one band. None at distance 64."""
    if not 0 <= distance <= 64:
        raise ValueError("perceptual distance must be within 0..64")
    if distance == 64:
        return []
    n = distance + 1
    sizes = [64 // n + (k < 64 % n) for k in range(n)]
    return [(sum(sizes[:k]), sizes[k]) for k in range(n)]


def hash_bands(h: Column, distance: int) -> Column:
    """array<struct<start_bit, bit_count, value>> of a hash's bands."""
    each = []
    for start, bits in band_layout(distance):
        value = h if bits == 64 else F.shiftrightunsigned(h, start).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        each.append(F.struct(F.lit(start).alias("start_bit"), F.lit(bits).alias("bit_count"), value.alias("value")))
    return F.array(*each) if each else F.array().cast("array<struct<start_bit:int,bit_count:int,value:bigint>>")


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.least(width, height).cast("double") / F.greatest(width, height).cast("double")


def capture_compatible(a: Column, b: Column, gap_ms: int) -> Column:
    """At most gap_ms apart, or either unknown; no subtraction that could overflow."""
    low, high = F.least(a, b), F.greatest(a, b)
    near = F.when(high < F.lit(min(MIN_LONG + gap_ms, MAX_LONG)), F.lit(True)).otherwise(low >= high - F.lit(gap_ms))
    return F.when(a.isNull() | b.isNull(), F.lit(True)).otherwise(near)


def metadata_compatible(a: str, b: str, policy: AnalysisPolicy) -> Column:
    """Aspect ratio and capture time of two aliased frames are within the policy."""
    c = lambda side, name: F.col(f"{side}.{name}")
    delta = F.abs(aspect_ratio(c(a, "width"), c(a, "height")) - aspect_ratio(c(b, "width"), c(b, "height")))
    return (delta <= F.lit(float(policy.max_aspect_ratio_delta))) & capture_compatible(c(a, "captured_at_ms"), c(b, "captured_at_ms"), policy.max_capture_gap_ms)


def pixel_count(width: Column, height: Column) -> Column:
    return width.cast("long") * height.cast("long")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def blur_verdict(laplacian: Column, edge: Column, texture: Column, policy: BlurPolicy) -> Column:
    """PossiblyBlurred if there is texture and both signals are at or below their ceilings; else Inconclusive."""
    low = (texture >= MIN_TEXTURE) & (laplacian <= F.lit(float(policy.laplacian_variance_ceiling))) & (edge <= F.lit(float(policy.edge_density_ceiling)))
    return F.when(low, F.lit("PossiblyBlurred")).otherwise(F.lit("Inconclusive"))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def stable_finding_id(prefix: str, ids: Column) -> Column:
    """prefix: and then length:id of each id, in the array's order."""
    return F.concat(F.lit(prefix + ":"), F.array_join(F.transform(ids, lambda x: F.concat(utf16_length(x).cast("string"), F.lit(":"), x)), ""))


def saturating_sum(x: Column) -> Column:
    """Sum of longs that are not negative, at most the largest long; 0 over nothing."""
    whole = F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return F.least(whole, F.lit(MAX_LONG).cast("decimal(38,0)")).cast("long")


def ratio_or_one(part: Column, whole: Column) -> Column:
    """part / whole, and 1 for nothing out of nothing."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)).cast("double"))


def luma(red: Column, green: Column, blue: Column) -> Column:
    """8-bit luminance by integer weights."""
    return F.shiftright(red.cast("int") * LUMA[0] + green.cast("int") * LUMA[1] + blue.cast("int") * LUMA[2] + 128, 8)


def can_read(access: Column) -> Column:
    return access.isin("Full", "Partial")
