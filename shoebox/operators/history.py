"""Freed space and library size over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.fixed import CATEGORIES
from shoebox.operators.asof import as_of
from shoebox.operators.distributed import latest, top_k


def runs(items: DataFrame) -> DataFrame:
    """One row per executed cleanup (library, day): totals and per-category maps.

    Two aggregation levels: a run's map collects at most one entry per category.
    """
    per_category = items.groupBy("library_id", "run_date", "category").agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")
    )
    entries = lambda value: F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", value))))
    return per_category.groupBy("library_id", "run_date").agg(
        F.sum("n").alias("items"), F.sum("bytes").alias("bytes"),
        entries("bytes").alias("bytes_by_category"), entries("n").alias("count_by_category"),
    )


def override_bytes(run_rows: DataFrame, actual: DataFrame) -> DataFrame:
    """Measured bytes (library_id, run_date, actual_bytes) replace the sum of item sizes."""
    return (
        run_rows.join(actual, ["library_id", "run_date"], "left")
        .withColumn("bytes", F.coalesce("actual_bytes", "bytes")).drop("actual_bytes")
    )


def with_lifetime(run_rows: DataFrame) -> DataFrame:
    """Running totals per library. A library has at most one run a day, so the window stays small."""
    w = Window.partitionBy("library_id").orderBy("run_date").rowsBetween(Window.unboundedPreceding, 0)
    return run_rows.withColumn("lifetime_bytes", F.sum("bytes").over(w)).withColumn("lifetime_items", F.sum("items").over(w))


def daily_readings(readings: DataFrame, keep: int = 400) -> DataFrame:
    """The last reading of each calendar day, for the latest ``keep`` days; empty libraries are skipped."""
    days = readings.filter("asset_count > 0").withColumn("day", F.to_date("ts"))
    last = latest(days, ["library_id", "day"], ["ts", "reading_id"])
    return top_k(last, ["library_id"], [F.desc("day")], keep).drop("rank")


def freed_by_category(run_rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bytes and items per category, over all libraries or per ``keys``."""
    exploded = run_rows.select(*keys, F.explode(F.map_zip_with("bytes_by_category", "count_by_category", lambda k, b, n: F.struct(b.alias("bytes"), n.alias("n")))).alias("category", "v"))
    return (
        exploded.filter(F.col("category").isin(*CATEGORIES)).groupBy(*keys, "category")
        .agg(F.sum("v.bytes").alias("bytes"), F.sum("v.n").alias("items"))
    )


def category_share(freed: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Whole percents of the whole or of each of ``keys``, truncated. At most one row per category and key enters a window."""
    total = F.greatest(F.sum("bytes").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))), F.lit(1))
    return freed.withColumn("percent", (F.col("bytes").cast("double") / total * 100).cast("bigint"))


def run_log(run_rows: DataFrame) -> DataFrame:
    """Runs with the category that freed most (ties: the later name), for newest-first display."""
    best = F.array_max(F.transform(F.map_entries("bytes_by_category"), lambda e: F.struct(e["value"].alias("b"), e["key"].alias("c"))))
    top = best["c"]
    return run_rows.select("library_id", "run_date", "items", "bytes", F.when(top.isin(*CATEGORIES), top).alias("top_category"))


def daily_totals(run_rows: DataFrame, today: str, days: int | None = 30, keys: tuple[str, ...] = ()) -> DataFrame:
    """Freed bytes per day from ``days`` before ``today`` on, with the busiest day marked, over all libraries or per ``keys``."""
    rows = run_rows
    if days is not None:
        rows = rows.filter(F.col("run_date") >= F.date_sub(F.lit(today).cast("date"), days))
    per_day = rows.groupBy(*keys, "run_date").agg(F.sum("bytes").alias("bytes"), F.sum("items").alias("items"))
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # one row per day: small
    busiest = F.max_by("run_date", F.struct(F.col("bytes"), (-F.unix_date("run_date")).alias("d"))).over(every)
    return per_day.select(
        *keys, "run_date", "bytes", "items", F.count(F.lit(1)).over(every).alias("active_days"), (F.col("run_date") == busiest).alias("busiest")
    )


def nearest_reading(moments: DataFrame, readings: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds the reading closest in time (ties: the earlier one; of readings at one time, the least bytes), nulls where there is none."""
    once = readings.groupBy("library_id", "ts").agg(F.min("bytes").alias("bytes"))
    found = moments
    for name, forward in (("before", False), ("after", True)):
        known = once.select("library_id", "ts", F.struct(F.col("ts").alias("ts"), "bytes").alias(f"_{name}"))
        found = as_of(found, known.withColumnRenamed("ts", "_at"), ["library_id"], ts, "_at", [f"_{name}"], forward, f"reading-{name}")
    gap = lambda side: F.abs(F.unix_micros(f"_{side}.ts") - F.unix_micros(ts))
    near = F.when(F.col("_after").isNull() | (gap("before") <= gap("after")), F.col("_before")).otherwise(F.col("_after"))
    return found.withColumn("_near", near).select(*moments.columns, F.col("_near.ts").alias("reading_ts"), F.col("_near.bytes").alias("reading_bytes"))


def net_change(readings: DataFrame) -> DataFrame:
    ends = readings.groupBy("library_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("bytes", "ts").alias("from_bytes"), F.max_by("bytes", "ts").alias("to_bytes"),
    )
    return ends.filter("first_ts <> last_ts").withColumn("delta", F.col("to_bytes") - F.col("from_bytes"))


def hero(run_rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lifetime totals and the mean of a run, over all libraries or per ``keys``."""
    totals = run_rows.groupBy(*keys).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("lifetime_bytes"), F.coalesce(F.sum("items"), F.lit(0)).alias("lifetime_items"), F.count(F.lit(1)).alias("runs"))
    return totals.withColumn("mean_bytes", F.expr("lifetime_bytes div greatest(runs, 1)"))
