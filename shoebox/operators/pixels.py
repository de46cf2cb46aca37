"""Fingerprints of decoded pixel grids, in Arrow batches.

Grid rows: gray (1024 values, 32 x 32 row by row, 0..1), gray9x8 (72 values, 8 rows of 9),
rgb (3072 bytes as ints). Decoding and resampling happen upstream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.fixed import FINGERPRINT_VERSION

SIDE, LOW = 32, 8
CHUNK = 100  # rows handled at once: bounds the grids and colour histograms in memory

# FNV-1a 64-bit offset and prime.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3

# Cut-offs of the statistics.
SHARP_SD, STRONG_EDGE, TOP_COLOURS = 0.15, 0.12, 8
LUMA = np.array([0.299, 0.587, 0.114])

SCHEMA = (
    "asset_id bigint, dhash bigint, phash bigint, content_hash bigint, sharpness double, saturation double, "
    "flatness double, edge_density double, brightness double, version int"
)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 booleans to signed longs, first element in the lowest bit."""
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0].astype(np.int64)


def dhash(small: np.ndarray) -> np.ndarray:
    grid = small.reshape(-1, 8, 9)
    return pack((grid[:, :, :-1] > grid[:, :, 1:]).reshape(-1, 64))


def dct_block(gray: np.ndarray) -> np.ndarray:
    """The 8 x 8 low-frequency block of the 2-D DCT-II, row by row."""
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    basis = np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE))
    return (basis @ gray.reshape(-1, SIDE, SIDE) @ basis.T).reshape(-1, LOW * LOW)


def phash_of_block(block: np.ndarray) -> np.ndarray:
    """Bits above the median of the 63 coefficients after the first."""
    median = np.sort(block[:, 1:], axis=1)[:, 31:32]
    return pack(block > median)


def content_hash(gray: np.ndarray, rgb: np.ndarray) -> np.ndarray:
    quantised = np.clip(gray * 255, 0, 255).astype(np.uint8)
    data = np.concatenate([quantised, rgb.astype(np.uint8)], axis=1).astype(np.uint64)
    h = np.full(len(data), FNV_OFFSET, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(data.shape[1]):
            h = (h ^ data[:, i]) * np.uint64(FNV_PRIME)
    return h.view(np.int64)


def sharpness(gray: np.ndarray) -> np.ndarray:
    g = gray.reshape(-1, SIDE, SIDE)
    around = g[:, 1:-1, :-2] + g[:, 1:-1, 2:] + g[:, :-2, 1:-1] + g[:, 2:, 1:-1]
    laplacian = (4 * g[:, 1:-1, 1:-1] - around).reshape(len(g), -1)
    return np.minimum(1, laplacian.std(axis=1) / SHARP_SD)


def edge_density(gray: np.ndarray) -> np.ndarray:
    g = gray.reshape(-1, SIDE, SIDE)
    centre = g[:, :-1, :-1]
    strength = np.abs(g[:, :-1, 1:] - centre) + np.abs(g[:, 1:, :-1] - centre)
    return (strength > STRONG_EDGE).reshape(len(g), -1).mean(axis=1)


def colour_statistics(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(saturation, brightness, flatness)."""
    pixels = rgb.reshape(len(rgb), -1, 3) / 255
    high, low = pixels.max(axis=2), pixels.min(axis=2)
    saturation = np.where(high > 0, (high - low) / np.where(high > 0, high, 1), 0).mean(axis=1)
    level = (pixels * 15).astype(np.int64)
    bucket = (level[:, :, 0] << 8) | (level[:, :, 1] << 4) | level[:, :, 2]
    offset = np.arange(len(rgb))[:, None] * 4096
    counts = np.bincount((bucket + offset).ravel(), minlength=4096 * len(rgb)).reshape(len(rgb), 4096)
    top = np.partition(counts, 4096 - TOP_COLOURS, axis=1)[:, -TOP_COLOURS:].sum(axis=1)
    return saturation, (pixels @ LUMA).mean(axis=1), top / bucket.shape[1]


def fingerprint(grids: DataFrame) -> DataFrame:
    """Every statistic of every image in one pass over its grid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                pdf = batch.iloc[start : start + CHUNK]
                gray, small, rgb = (np.stack(pdf[c].to_numpy()).astype(np.float64) for c in ("gray", "gray9x8", "rgb"))
                saturation, brightness, flatness = colour_statistics(rgb)
                yield pd.DataFrame({
                    "asset_id": pdf["asset_id"].to_numpy(), "dhash": dhash(small), "phash": phash_of_block(dct_block(gray)),
                    "content_hash": content_hash(gray, rgb), "sharpness": sharpness(gray), "saturation": saturation,
                    "flatness": flatness, "edge_density": edge_density(gray), "brightness": brightness, "version": FINGERPRINT_VERSION,
                })

    return grids.select("asset_id", "gray", "gray9x8", "rgb").mapInPandas(run, SCHEMA)


# --- the steps that are plain column expressions --------------------------------------------------


def pack_flags(flags: Column) -> Column:
    """64 booleans to a signed long, first element in the lowest bit."""
    placed = F.transform(flags, lambda on, i: F.when(on, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(placed, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def above_tail_median(values: str) -> Column:
    """Threshold step of the pHash over 64 coefficients."""
    # the array in the lambda's place keeps the median one evaluation per row
    median = F.array_sort(F.slice(values, 2, 63))[31]
    return pack_flags(F.zip_with(values, F.array_repeat(median, 64), lambda v, m: v > m))


def quantised_digest(gray: Column, rgb: Column) -> Column:
    """MD5 over the bytes the content hash reads: the same equality without 64-bit multiplication."""
    level = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), (v * 255).cast("int")))
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    return F.md5(F.concat_ws(";", text(F.transform(gray, level)), text(rgb)))
