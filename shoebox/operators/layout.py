"""Text-layout features: recognised lines (boxes with origin bottom-left) to one row per asset.

``placed`` gives every line its neighbours: one shuffle on the asset serves all orders, and
an asset with very many lines is sliced instead. ``layout_of`` then aggregates on that same
partitioning, first per column of text, then per asset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.scalars import looks_like_clock
from shoebox.operators.distributed import Sequence, dealt, hot_keys

KEY = "asset_id"
COLUMN_GAP = 0.06


def placed(lines: DataFrame, bound: int = 20_000) -> DataFrame:
    """Lines with their surroundings: ``gap`` to the line below (by mid height), ``chain`` (left edges
    chained until a gap above 0.06), ``nth`` of ``n`` by box height, ``covered``, the area of the lines up to
    this one, and ``reach``, the rightmost start of any line at about the same height.
    """
    rows = dealt(lines, [KEY]).withColumn("mid", F.col("y") + F.col("h") / 2).withColumn("_one", F.lit(1).cast("bigint"))
    hot = hot_keys(lines.select(KEY), [KEY], "lines", bound)
    at = lambda df, by: Sequence(df, [KEY], [F.col(by), F.col("line_no")], f"lines-{by}", bound, hot)
    by_height = at(rows, "h").running_sum("_one", "nth").size("n").key_max(F.when(F.expr("nth = n div 2 + 1"), F.col("h")), "median_height")
    # covered by the lines so far, in their order: whole areas lie on the rules' bounds, and the last bit hangs on the order of the sum
    summed = at(by_height.result().withColumn("_area", F.col("w") * F.col("h")), "line_no").running_sum("_area", "covered")
    rows = summed.derive("_level", F.col("mid") / F.greatest(F.lit(0.004), F.col("median_height") * 0.45)).result()
    # heights exactly a tolerance apart are not level: the margin keeps rounding out of that decision
    level = at(rows, "mid").previous("mid").derive("gap", F.col("mid") - F.col("prev_mid")).nearby_max("_level", "x", 1 - 1e-9, "reach")
    starts = F.coalesce(F.col("x") - F.col("prev_x") > COLUMN_GAP, F.lit(True)).cast("bigint")
    rows = at(level.result(), "x").previous("x").derive("_start", starts).running_sum("_start", "chain").result()
    return rows.drop("prev_mid", "prev_x", "_start", "_one", "_level", "_area")


def _spread(name: str) -> Column:
    """Population deviation from a count, a sum and a sum of squares."""
    n, total, squares = F.col(f"{name}_n"), F.col(name), F.col(f"{name}_sq")
    mean = total / n
    return F.sqrt(F.greatest(F.lit(0.0), squares / n - mean * mean))


def _moments(name: str, value: Column) -> dict[str, Column]:
    return {f"{name}_n": F.count(value), name: F.sum(value), f"{name}_sq": F.sum(value * value)}


def _even_columns(centres: str) -> Column:
    """Three or more column centres whose gaps differ little."""
    ordered = F.array_sort(centres)
    gaps = F.zip_with(F.slice(ordered, 2, F.size(centres)), ordered, lambda b, a: b - a)
    known = F.filter(gaps, lambda g: g.isNotNull())
    # mean and deviation as SQL adds them up (Welford): even gaps are hundredths, and ratios of exactly 0.35 hang on the last bit
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(s: Column, g: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (g - s["mean"]) / n
        squares = s["squares"] + (g - mean) * (g - s["mean"])
        return F.struct(n.alias("n"), (s["total"] + g).alias("total"), mean.alias("mean"), squares.alias("squares"))

    ratio = F.aggregate(known, zero, step, lambda s: F.when(s["total"] > 0, F.sqrt(s["squares"] / s["n"]) / (s["total"] / s["n"])))
    return F.when(F.size(centres) >= 3, F.coalesce(ratio < 0.35, F.lit(False))).otherwise(False)


def _line_sums() -> dict[str, Column]:
    """What adds up over lines, whatever they are first grouped by."""
    digits = F.length(F.regexp_replace("text", r"[^\p{N}]", ""))
    return {
        "line_count": F.count(F.lit(1)), "area": F.sum(F.col("w") * F.col("h")), "confidence": F.sum("confidence"),
        "short": F.count_if(F.col("w") < 0.45), "digits": F.sum(digits), "chars": F.sum(F.length("text")),
        "left": F.count_if(F.col("x") < 0.22), "right": F.count_if(F.col("x") > 0.38), "hugging": F.count_if(F.col("x") + F.col("w") > 0.90),
        **_moments("mx", F.col("x") + F.col("w") / 2), **_moments("my", F.col("y") + F.col("h") / 2),
    }


def _line_flags() -> dict[str, Column]:
    top = F.col("y") + F.col("h")
    clock_zone = (top > 0.955) & (F.col("x") < 0.38)
    return {
        "has_top_bar": F.bool_or(F.col("y") > 0.955), "has_bottom_bar": F.bool_or(top < 0.075),
        "has_clock": F.bool_or(clock_zone & looks_like_clock("text")),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [value.alias(name) for name, value in columns.items()]


def _from_lines(least: int, value: Column) -> Column:
    return F.when(F.col("line_count") >= least, value).otherwise(0.0)


def _summed_features() -> list[Column]:
    count = F.col("line_count")
    return _named({
        "line_count": count, "text_area": F.least(F.col("area"), F.lit(1.0)), "mean_confidence": F.col("confidence") / count,
        "short_share": F.col("short") / count, "digit_share": F.when(F.col("chars") > 0, F.col("digits") / F.col("chars")).otherwise(0.0),
        "bimodality": _from_lines(4, F.least(F.least("left", "right") / count * 2.4, F.lit(1.0))),
        "right_hugging": _from_lines(4, F.col("hugging") / count),
        "scatter": _from_lines(5, F.least(_spread("mx") / 0.29 * (_spread("my") / 0.29), F.lit(1.0))),
    }) + [F.col(c) for c in _line_flags()]


def aggregates(lines: DataFrame) -> DataFrame:
    """The features that need no neighbours: one aggregation, combined map-side."""
    return lines.groupBy(KEY).agg(*_named(_line_sums()), *_named(_line_flags())).select(KEY, *_summed_features())


def layout_of(rows: DataFrame) -> DataFrame:
    """The features of ``placed`` lines."""
    flags, gaps = _line_flags(), _moments("gap", F.col("gap"))
    sums = {**_line_sums(), "paired": F.count_if(F.col("reach") - (F.col("x") + F.col("w")) > 0.02)}
    per_chain = rows.groupBy(KEY, "chain").agg(
        *_named(sums), *_named(flags), *_named(gaps), F.avg("x").alias("centre"),
        F.max("median_height").alias("median_height"), F.max(F.struct("line_no", "covered")).alias("last"),
    )
    per_asset = per_chain.groupBy(KEY).agg(
        *[F.sum(c).alias(c) for c in (*sums, *gaps) if c != "area"], F.max("last")["covered"].alias("area"), *[F.bool_or(c).alias(c) for c in flags], F.max("median_height").alias("median_height"),
        # chains lie more than 0.06 of the width apart: a handful per asset
        F.array_compact(F.collect_list(F.when(F.col("line_count") >= 2, F.col("centre")))).alias("centres"),
    )
    mean_gap = F.col("gap") / F.col("gap_n")
    even_gaps = F.when(mean_gap > 0, F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), _spread("gap") / mean_gap))).otherwise(0.0)
    return per_asset.select(
        KEY, *_summed_features(), "median_height", _from_lines(4, F.col("paired") / F.col("line_count")).alias("paired_rows"), _from_lines(4, even_gaps).alias("gap_regularity"),
        F.when(F.col("line_count") >= 4, F.size("centres")).otherwise(0).cast("bigint").alias("column_count"),
        ((F.col("line_count") >= 4) & _even_columns("centres")).alias("columns_even"),
    )


def features(lines: DataFrame, bound: int = 20_000) -> DataFrame:
    """All layout features, one row per asset with at least one line."""
    return layout_of(placed(lines, bound))
