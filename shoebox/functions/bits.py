"""Bands of 64-bit hashes.

Two hashes within distance t agree on at least ``bands - t`` of their ``bands`` pieces, so they share the value
of some combination of that many pieces. One piece (bands = t + 1) gives few, short keys;
three of t + 3 give more keys of more bits, for places where short keys crowd.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band_widths(bands: int) -> list[int]:
    """64 bits cut into ``bands`` nearly equal pieces, the wider ones first."""
    return [64 // bands + (1 if i < 64 % bands else 0) for i in range(bands)]


def band_values(hash_col: str, bands: int) -> list[Column]:
    out, offset = [], 0
    for width in band_widths(bands):
        piece = F.shiftrightunsigned(hash_col, offset)
        out.append(piece if width == 64 else piece.bitwiseAND(F.lit((1 << width) - 1)))
        offset += width
    return out


def first_equal(left: list[Column], right: list[Column]) -> Column:
    """Index of the first equal band, null if none is."""
    test = F.lit(None).cast("int")
    for i in reversed(range(len(left))):
        test = F.when(left[i] == right[i], F.lit(i)).otherwise(test)
    return test


def choices(bands: int, agreeing: int) -> list[tuple[int, ...]]:
    return list(combinations(range(bands), agreeing))


def choice_keys(hash_col: str, bands: int, agreeing: int) -> Column:
    """Array of struct(choice, bits): the bits of each choice of bands, the other bits cleared."""
    offsets, at = [], 0
    for width in band_widths(bands):
        offsets.append((at, width))
        at += width
    masks = [sum(((1 << w) - 1) << o for o, w in (offsets[i] for i in choice)) for choice in choices(bands, agreeing)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(n).alias("choice"), F.col(hash_col).bitwiseAND(F.lit(m)).alias("bits")) for n, m in enumerate(signed)])


def first_choice(left: str, right: str, bands: int, agreeing: int) -> Column:
    """Number of the choice made of the first ``agreeing`` equal bands: the one a pair is kept on."""
    a, b = band_values(left, bands), band_values(right, bands)
    equal = F.array_compact(F.array(*[F.when(a[i] == b[i], F.lit(i)) for i in range(bands)]))
    listed = F.array(*[F.array(*map(F.lit, c)) for c in choices(bands, agreeing)])
    return (F.array_position(listed, F.slice(equal, 1, agreeing)) - 1).cast("int")
