"""Row-level expressions over asset columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions import fixed

LONG = "bigint"


def pixel_count() -> Column:
    return F.col("pixel_width").cast(LONG) * F.col("pixel_height").cast(LONG)


def aspect() -> Column:
    return F.when(F.col("pixel_height") == 0, F.lit(1.0)).otherwise(
        F.col("pixel_width").cast("double") / F.col("pixel_height")
    )


def has_subtype(mask: int) -> Column:
    return F.col("subtypes").bitwiseAND(F.lit(mask)) != 0


def is_screenshot() -> Column:
    return has_subtype(fixed.SUBTYPE_SCREENSHOT)


def is_live() -> Column:
    return has_subtype(fixed.SUBTYPE_LIVE)


def is_panorama() -> Column:
    return has_subtype(fixed.SUBTYPE_PANORAMA)


def is_portrait() -> Column:
    return has_subtype(fixed.SUBTYPE_DEPTH)


def is_screen_recording() -> Column:
    name = F.upper("filename")
    marked = name.startswith(fixed.RECORDING_PREFIX)
    for mark in fixed.RECORDING_MARKS:
        marked = marked | name.contains(mark)
    return F.col("is_video") & F.coalesce(marked, F.lit(False))


def short_side() -> Column:
    return F.least("pixel_width", "pixel_height")


def long_side() -> Column:
    return F.greatest("pixel_width", "pixel_height")


def is_screen_like(low: float = 1.9, high: float = 2.3) -> Column:
    """A screenshot by flag, or a side ratio strictly between ``low`` and ``high``."""
    ratio = F.when(short_side() > 0, long_side().cast("double") / short_side())
    return is_screenshot() | F.coalesce((ratio > low) & (ratio < high), F.lit(False))


def hamming(a: str | Column, b: str | Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def same_shape(aw: str, ah: str, bw: str, bh: str) -> Column:
    return F.col(aw).cast(LONG) * F.col(bh).cast(LONG) == F.col(bw).cast(LONG) * F.col(ah).cast(LONG)


def shape_key() -> Column:
    """Equal for two assets exactly when their aspect ratios are equal.

    IEEE division is correctly rounded, so equal ratios give equal doubles; two different
    ratios of integers below 2^26 never round to the same double.
    """
    return F.when(
        F.col("pixel_height") != 0, F.col("pixel_width").cast("double") / F.col("pixel_height").cast("double")
    ).otherwise(F.lit(-1.0))


def estimated_bytes() -> Column:
    video = F.col("duration") * F.lit(float(fixed.VIDEO_BITS_PER_SECOND)) / F.lit(8.0)
    image = pixel_count().cast("double") * F.lit(fixed.IMAGE_BYTES_PER_PIXEL)
    return F.when(F.col("is_video"), video).otherwise(image).cast(LONG)


def looks_like_clock(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    t = F.upper(F.regexp_replace(F.trim(t), "：", ":"))
    t = F.regexp_replace(t, " [AP]M", "")
    return F.coalesce(t.rlike(r"^([0-9]|[01][0-9]|2[0-3]):[0-5][0-9]$"), F.lit(False))


def device_match(df: DataFrame) -> DataFrame:
    """Adds ``device_match``: phone, ambiguous or none, whatever the orientation.

    The lookup has 25 rows by construction, so it is compiled into the plan as a
    set test rather than joined.
    """
    # both sides fit 31 bits: one packed long stands for the pair
    packed = short_side().cast(LONG) * F.lit(1 << 31) + long_side().cast(LONG)
    phones = [s * (1 << 31) + l for s, l in fixed.PHONE_SCREENS]
    others = [s * (1 << 31) + l for s, l in fixed.AMBIGUOUS_SCREENS]
    match = (
        F.when(short_side() <= 0, "none")
        .when(packed.isin(phones), "phone")
        .when(packed.isin(others), "ambiguous")
        .otherwise("none")
    )
    return df.withColumn("device_match", match)


def moment_window(strictness: float) -> float:
    """Seconds between two shots of one moment: 5 when strict, 40 when loose."""
    return 5.0 + (1.0 - strictness) * 35.0


def with_derived(df: DataFrame) -> DataFrame:
    """Derived asset columns used by several operators."""
    return df.select(
        "*",
        pixel_count().alias("pixel_count"),
        is_screenshot().alias("is_screenshot"),
        is_live().alias("is_live"),
        is_portrait().alias("is_portrait"),
        is_panorama().alias("is_panorama"),
        is_screen_recording().alias("is_screen_recording"),
        is_screen_like().alias("is_screen_like"),
    )
