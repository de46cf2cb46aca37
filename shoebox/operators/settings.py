"""Settings of each library, as columns of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.fixed import GRACE_DAYS
from shoebox.operators.distributed import attach


def with_settings(rows: DataFrame, settings: DataFrame, **defaults) -> DataFrame:
    """``rows`` with the settings named in ``defaults``; a library without a row in ``settings`` (library_id, ...), or with a null there, has
    the default. On a stream the settings are those at the start of each micro-batch.
    """
    given = settings.select("library_id", *[F.col(c).alias(f"_{c}") for c in defaults])
    filled = [F.coalesce(F.col(f"_{c}"), F.lit(value)).alias(c) for c, value in defaults.items()]
    if rows.isStreaming:
        return rows.join(given, "library_id", "left").select(*[c for c in rows.columns if c not in defaults], *filled)
    sizes = rows.groupBy("library_id").agg(F.count(F.lit(1)).alias("_size"))
    per_library = sizes.join(given, "library_id", "left").select("library_id", "_size", *filled)
    return attach(rows.drop(*defaults), per_library, ["library_id"], "_size")


def moment_window(strictness: str = "strictness") -> Column:
    """Seconds between two shots of one moment: 5 when strict, 40 when loose."""
    return F.lit(5.0) + (F.lit(1.0) - F.col(strictness)) * F.lit(35.0)


def grace_days(grace: str = "grace") -> Column:
    """Days of a grace setting; a name that is none counts as a week."""
    days = F.create_map(*[F.lit(x) for pair in GRACE_DAYS.items() for x in pair])
    return F.coalesce(F.element_at(days, F.col(grace)), F.lit(GRACE_DAYS["oneWeek"]))
