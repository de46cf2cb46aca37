"""Vector expressions over ARRAY columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_double(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(_as_double(a), _as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 for empty vectors, unequal lengths or a zero norm."""
    x, y = _as_double(a), _as_double(b)
    scale = norm(x) * norm(y)
    return F.when((F.size(x) == F.size(y)) & (scale > 0), dot(x, y) / scale).otherwise(F.lit(0.0))


def normalise(a: str | Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    v = _as_double(a)
    # the repeated array makes the norm one evaluation per row instead of one per element
    return F.when(norm(v) > 0, F.zip_with(v, F.array_repeat(norm(v), F.size(v)), lambda x, n: x / n)).otherwise(v)
