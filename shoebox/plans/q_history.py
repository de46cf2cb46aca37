"""Queries: deletion history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.operators import history
from shoebox.plans.duck_views import view
from shoebox.plans.registry import query
from shoebox.sources.derived import Library

view("run_categories", """
select library_id, run_date, category, sum(bytes)::bigint as bytes, count(*) as n from deletion_items group by 1, 2, 3
""", ("deletion_items",))
view("run_totals", """
select library_id, run_date, sum(n)::bigint as items, sum(bytes)::bigint as bytes,
 string_agg(category || '=' || bytes || '/' || n, ',' order by category) as categories from run_categories group by 1, 2
""", ("run_categories",))
view("day_readings", """
select * from (select *, row_number() over (partition by library_id order by day desc) as nth from
 (select *, ts::date as day from readings where asset_count > 0 qualify row_number() over (partition by library_id, ts::date order by ts desc, reading_id desc) = 1)) where nth <= 400
""", ("readings",))


def runs(lib: Library) -> DataFrame:
    return history.runs(lib.deletion_items())


def day_readings(lib: Library) -> DataFrame:
    return history.daily_readings(lib.readings())


@query("his1", """
select library_id, run_date, items, bytes, categories, (sum(bytes) over w)::bigint as lifetime_bytes, (sum(items) over w)::bigint as lifetime_items
from run_totals window w as (partition by library_id order by run_date rows unbounded preceding)
""", ("run_totals",))
def record(lib: Library) -> DataFrame:
    entry = F.transform(F.map_entries("bytes_by_category"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"), F.lit("/"), F.col("count_by_category")[e["key"]].cast("string")))
    rows = history.with_lifetime(runs(lib))
    return rows.select("library_id", "run_date", "items", "bytes", F.array_join(F.array_sort(entry), ",").alias("categories"), "lifetime_bytes", "lifetime_items")


@query("his1_actual", """
select library_id, run_date, case when library_id % 2 = 0 then bytes + 1000 else bytes end as bytes from run_totals
""", ("run_totals",))
def record_actual(lib: Library) -> DataFrame:
    rows = runs(lib)
    actual = rows.filter("library_id % 2 = 0").select("library_id", "run_date", (F.col("bytes") + 1000).alias("actual_bytes"))
    return history.override_bytes(rows, actual).select("library_id", "run_date", "bytes")


@query("his2", "select day, reading_id, asset_count, bytes from day_readings", ("day_readings",))
def readings(lib: Library) -> DataFrame:
    return day_readings(lib).select("day", "reading_id", "asset_count", "bytes")


@query("his3", "select category, sum(bytes)::bigint as bytes, sum(n)::bigint as items from run_categories group by category", ("run_categories",))
def freed(lib: Library) -> DataFrame:
    return history.freed_by_category(runs(lib)).orderBy(F.desc("bytes"))


@query("his4", """
select category, trunc(bytes::double / greatest(sum(bytes) over (), 1) * 100)::bigint as percent
from (select category, sum(bytes)::bigint as bytes from run_categories group by category)
""", ("run_categories",))
def share(lib: Library) -> DataFrame:
    return history.category_share(history.freed_by_category(runs(lib))).select("category", "percent")


@query("his5", """
select t.library_id, t.run_date, t.items, t.bytes, arg_max(c.category, (c.bytes, c.category)) as top_category
from run_totals t join run_categories c using (library_id, run_date) group by all
""", ("run_totals", "run_categories"))
def log(lib: Library) -> DataFrame:
    return history.run_log(runs(lib)).orderBy(F.desc("run_date"), "library_id")


@query("his6", """
select run_date, bytes, items, count(*) over () as active_days, run_date = first_value(run_date) over (order by bytes desc, run_date) as busiest
from (select run_date, sum(bytes)::bigint as bytes, sum(items)::bigint as items from run_totals where run_date >= date '2024-02-15' - 30 group by run_date)
""", ("run_totals",))
def daily(lib: Library) -> DataFrame:
    return history.daily_totals(runs(lib), "2024-02-15", 30)


# run days are moved into the years the readings cover
@query("his7", """
, moved as (select library_id as run_library, run_date, run_date::timestamp - interval 8600 day + interval 7 hour as ts from run_totals),
near as (select m.*, r.ts as reading_ts, r.bytes as reading_bytes, row_number() over (partition by run_library, run_date order by abs(epoch_us(m.ts) - epoch_us(r.ts)), r.ts) as k
 from moved m cross join day_readings r)
select run_library, run_date, reading_ts, reading_bytes from near where k = 1
""", ("run_totals", "day_readings"))
def nearest(lib: Library) -> DataFrame:
    moved = runs(lib).select(
        F.lit(0).cast("bigint").alias("library_id"), F.col("library_id").alias("run_library"), "run_date",
        (F.col("run_date").cast("timestamp") - F.expr("interval 8600 days") + F.expr("interval 7 hours")).alias("ts"),
    )
    return history.nearest_reading(moved, day_readings(lib)).select("run_library", "run_date", "reading_ts", "reading_bytes")


@query("his8", """
select library_id, arg_min(bytes, ts) as from_bytes, arg_max(bytes, ts) as to_bytes, arg_max(bytes, ts) - arg_min(bytes, ts) as delta
from day_readings group by library_id having min(ts) <> max(ts)
""", ("day_readings",))
def change(lib: Library) -> DataFrame:
    return history.net_change(day_readings(lib)).select("library_id", "from_bytes", "to_bytes", "delta")


@query("his9", """
select sum(bytes)::bigint as lifetime_bytes, sum(items)::bigint as lifetime_items, count(*) as runs, (sum(bytes) // greatest(count(*), 1))::bigint as mean_bytes from run_totals
""", ("run_totals",))
def hero(lib: Library) -> DataFrame:
    return history.hero(runs(lib))


OWN = ("library_id",)


@query("his3_libraries", "select library_id, category, sum(bytes)::bigint as bytes, sum(n)::bigint as items from run_categories group by library_id, category", ("run_categories",))
def freed_per_library(lib: Library) -> DataFrame:
    return history.freed_by_category(runs(lib), OWN)


@query("his4_libraries", """
select library_id, category, trunc(bytes::double / greatest(sum(bytes) over (partition by library_id), 1) * 100)::bigint as percent
from (select library_id, category, sum(bytes)::bigint as bytes from run_categories group by library_id, category)
""", ("run_categories",))
def share_per_library(lib: Library) -> DataFrame:
    return history.category_share(history.freed_by_category(runs(lib), OWN), OWN).select("library_id", "category", "percent")


@query("his6_libraries", """
select library_id, run_date, bytes, items, count(*) over (partition by library_id) as active_days, run_date = first_value(run_date) over (partition by library_id order by bytes desc, run_date) as busiest
from (select library_id, run_date, sum(bytes)::bigint as bytes, sum(items)::bigint as items from run_totals where run_date >= date '2024-02-15' - 30 group by library_id, run_date)
""", ("run_totals",))
def daily_per_library(lib: Library) -> DataFrame:
    return history.daily_totals(runs(lib), "2024-02-15", 30, OWN)


@query("his9_libraries", """
select library_id, sum(bytes)::bigint as lifetime_bytes, sum(items)::bigint as lifetime_items, count(*) as runs, (sum(bytes) // greatest(count(*), 1))::bigint as mean_bytes from run_totals group by library_id
""", ("run_totals",))
def hero_per_library(lib: Library) -> DataFrame:
    return history.hero(runs(lib), OWN)
