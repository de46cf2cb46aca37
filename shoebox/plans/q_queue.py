"""Queries: decisions, pending items and decks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions.fixed import LEARNABLE
from shoebox.operators import queue, settings
from shoebox.plans import scan
from shoebox.plans.duck_views import view
from shoebox.plans.registry import query
from shoebox.sources.derived import Library

NOW = "2024-01-25 00:00:00"
ITEM = ["library_id", "asset_id"]

view("keep_always", "select vec_id as asset_id from vectors where label % 4 = 1", ("vectors",))
view("open_candidates", """
select * from candidates where asset_id not in (select asset_id from pending_ids) and asset_id not in (select asset_id from protected)
 and asset_id not in (select asset_id from keep_always)
""", ("candidates", "pending_ids", "protected", "keep_always"))
view("ranked", """
select *, row_number() over (partition by category order by priority desc, asset_id) as position from
 (select *, confidence * (0.55 + log2(greatest(byte_size, 65536) / 65536.0::double) / 10) as priority from open_candidates)
""", ("open_candidates",))


def pending(lib: Library) -> DataFrame:
    return queue.pending_items(scan.decision_state(lib), ITEM)


def pending_ids(lib: Library) -> DataFrame:
    return pending(lib).select("asset_id").distinct()


def keep_always(lib: Library) -> DataFrame:
    return lib.vectors().filter("label % 4 = 1").select(F.col("vec_id").alias("asset_id"))


def open_candidates(lib: Library) -> DataFrame:
    return queue.open_candidates(lib.candidates(), pending_ids(lib), scan.protected(lib), keep_always(lib))


def graces(lib: Library) -> DataFrame:
    """Grace settings of two thirds of the libraries."""
    ids = lib.decisions().select("library_id").distinct()
    return ids.filter("library_id % 3 < 2").select("library_id", F.when(F.col("library_id") % 3 == 0, "oneMonth").otherwise("immediate").alias("grace"))


def with_priority(rows: DataFrame) -> DataFrame:
    return rows.withColumn("priority", queue.priority(F.col("confidence"), F.col("byte_size")))


@query("dec1", """
select library_id, asset_id, pending, protected, marked_at, bytes from states
""", ("states",))
def states(lib: Library) -> DataFrame:
    return scan.decision_state(lib)


@query("dec1_newest", """
select library_id, asset_id, row_number() over (partition by library_id order by marked_at desc, asset_id) as position from pending
""", ("pending",))
def newest(lib: Library) -> DataFrame:
    return queue.newest_first(pending(lib), ["asset_id"]).select("library_id", "asset_id", "position")


@query("dec2", "select library_id, event_id, action, undone, undo_event_id from resolved", ("resolved",))
def undo(lib: Library) -> DataFrame:
    return scan.resolved(lib).select("library_id", "event_id", "action", "undone", "undo_event_id")


@query("dec2_state", """
, effects as (select library_id, asset_id, ts as at_ts, event_id as seq, action = 'delete' as marks, case when action = 'whitelist' then true end as protects from resolved
 union all select library_id, asset_id, undone_at, undo_event_id, case when action = 'delete' then false end, case when action = 'whitelist' then false end
 from resolved where undone and action <> 'keepOnce')
select library_id, asset_id, coalesce(arg_max(marks, (at_ts, seq)) filter (where marks is not null), false) as pending,
 coalesce(arg_max(protects, (at_ts, seq)) filter (where protects is not null), false) as protected from effects group by 1, 2
""", ("resolved",))
def undo_state(lib: Library) -> DataFrame:
    return queue.current_state(scan.resolved(lib), ITEM).select(*ITEM, "pending", "protected")


@query("dec3", """
select library_id, count_if(action = 'delete')::bigint as marked, sum(case when action = 'delete' then bytes else 0 end)::bigint as marked_bytes,
 count_if(action = 'keepOnce')::bigint as kept, count_if(action = 'whitelist')::bigint as whitelisted from resolved where not undone group by library_id
""", ("resolved",))
def counters(lib: Library) -> DataFrame:
    return queue.session_counters(scan.resolved(lib), ["library_id"])


@query("dec4", """
select library_id, asset_id, bytes, marked_at + interval 7 day as week, marked_at + interval 30 day as month from pending
""", ("pending",))
def deadlines(lib: Library) -> DataFrame:
    month = queue.with_deadline(pending(lib), "oneMonth").withColumnRenamed("execute_after", "month")
    return queue.with_deadline(month, "oneWeek").select("library_id", "asset_id", "bytes", F.col("execute_after").alias("week"), "month")


@query("dec4_settings", """
select library_id, asset_id, bytes, marked_at + case library_id % 3 when 0 then interval 30 day when 1 then interval 0 day else interval 7 day end as execute_after from pending
""", ("pending",))
def deadlines_by_settings(lib: Library) -> DataFrame:
    """A month for some libraries, none for others, the default for those without settings."""
    rows = settings.with_settings(pending(lib), graces(lib), grace="oneWeek")
    return queue.with_deadline(rows, "grace").select("library_id", "asset_id", "bytes", "execute_after")


@query("dec5", """
select library_id, asset_id, bytes, row_number() over (order by marked_at, library_id, asset_id) as position
from pending where marked_at + interval 7 day <= timestamp '2024-01-25 00:00:00'
""", ("pending",))
def due(lib: Library) -> DataFrame:
    return queue.due_items(queue.with_deadline(pending(lib)), NOW, ITEM).select("library_id", "asset_id", "bytes", "position")


@query("dec5_totals", """
select marked_at + interval 7 day <= timestamp '2024-01-25 00:00:00' as due, count(*) as items, sum(bytes)::bigint as bytes from pending group by 1
""", ("pending",))
def due_totals(lib: Library) -> DataFrame:
    is_due = F.col("execute_after") <= F.lit(NOW).cast("timestamp")
    return queue.with_deadline(pending(lib)).groupBy(is_due.alias("due")).agg(F.count(F.lit(1)).alias("items"), F.sum("bytes").alias("bytes"))


@query("dec6", "select library_id, asset_id, bytes from pending where asset_id % 10 <> 0", ("pending",))
def restored(lib: Library) -> DataFrame:
    rows = pending(lib)
    return queue.restore(rows, rows.filter("asset_id % 10 = 0"), ITEM).select("library_id", "asset_id", "bytes")


# what an item was when it was marked: the last correction by then, else what the scan had made of it
DUE_ITEMS = """
due as (select p.library_id, p.asset_id, p.bytes, coalesce((select arg_max(l.name, (d.ts, d.event_id)) from decisions d join learnable l on l.c = d.event_id % 8
  where d.action = 'relabel' and d.library_id = p.library_id and d.asset_id = p.asset_id and d.ts <= p.marked_at), c.category, 'other') as category
 from pending p left join candidates c using (asset_id) where p.marked_at + interval 7 day <= timestamp '2024-01-25 00:00:00')
"""


def _named(lib: Library, marked: DataFrame) -> DataFrame:
    """The categories of marked items over time: the scan's verdict from the start, then each correction."""
    names = F.array(*map(F.lit, LEARNABLE))
    start = marked.select(*ITEM).join(lib.candidates().select("asset_id", "category"), "asset_id").select(*ITEM, F.lit("1970-01-01").cast("timestamp").alias("named_at"), F.lit(-1).cast("bigint").alias("seq"), "category")
    fixes = lib.decisions().filter("action = 'relabel'").select(*ITEM, F.col("ts").alias("named_at"), F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") % len(LEARNABLE) + 1).cast("int")).alias("category"))
    return start.unionByName(fixes)


def _due(lib: Library) -> DataFrame:
    rows = queue.category_at_mark(pending(lib), _named(lib, pending(lib)), ITEM)
    due_rows = queue.with_deadline(rows).filter(F.col("execute_after") <= F.lit(NOW).cast("timestamp"))
    return due_rows.select("library_id", "asset_id", "bytes", "category")


@query("dec7", f""", {DUE_ITEMS}, c as (select library_id, category, sum(bytes) as b, count(*) as n from due group by 1, 2)
select library_id, sum(n)::bigint as items, sum(b)::bigint as bytes, string_agg(category || '=' || b || '/' || n, ',' order by category) as categories from c group by 1
""", ("pending", "candidates", "decisions", "learnable"))
def executed(lib: Library) -> DataFrame:
    from shoebox.operators import history

    items = _due(lib).withColumn("run_date", F.lit(NOW).cast("date"))
    entry = F.transform(F.map_entries("bytes_by_category"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"), F.lit("/"), F.col("count_by_category")[e["key"]].cast("string")))
    return history.runs(items).select("library_id", "items", "bytes", F.array_join(F.array_sort(entry), ",").alias("categories"))


@query("dec7_remaining", f""", {DUE_ITEMS}
select 'pending' as what, count(*) as n from pending p where not exists (select 1 from due d where d.library_id = p.library_id and d.asset_id = p.asset_id)
union all select 'candidates', count(*) from candidates where asset_id not in (select asset_id from due)
union all select 'assets', count(*) from assets where asset_id not in (select asset_id from due)
""", ("pending", "candidates", "assets", "decisions", "learnable"))
def remaining(lib: Library) -> DataFrame:
    due_rows = _due(lib)
    left = queue.without(pending(lib), due_rows, ITEM).select(F.lit("pending").alias("what"))
    for name, rows in (("candidates", lib.candidates()), ("assets", lib.assets())):
        left = left.union(queue.without(rows, due_rows, ["asset_id"]).select(F.lit(name)))
    return left.groupBy("what").agg(F.count(F.lit(1)).alias("n"))


@query("dec8", "select category, asset_id, position from ranked where position <= 60", ("ranked",))
def deck(lib: Library) -> DataFrame:
    return queue.decks(with_priority(open_candidates(lib))).select("category", "asset_id", F.col("position").cast("bigint").alias("position"))


@query("dec9", """
, deck as (select * from ranked where position <= case when category = 'chatScreenshot' then 180 else 60 end),
fresh as (select *, row_number() over (partition by category order by asset_id) as k from open_candidates where asset_id not in (select asset_id from deck)
 and category not in (select category from deck group by category having count(*) >= 180))
select category, asset_id from fresh where k <= 60
""", ("ranked", "open_candidates"))
def topped_up(lib: Library) -> DataFrame:
    rows = with_priority(open_candidates(lib))
    cards = queue.decks(rows, 180).filter(F.col("position") <= F.when(F.col("category") == "chatScreenshot", 180).otherwise(60))
    arrivals = rows.withColumn("arrival", F.col("asset_id"))
    return queue.top_up(cards.drop("position"), arrivals).select("category", "asset_id")


@query("dec10", """
select asset_id, case when asset_id % 2 = 0 then category else 'other' end as category from candidates
""", ("candidates",))
def first_wins(lib: Library) -> DataFrame:
    base = lib.candidates().select("asset_id", "category")
    early = base.filter("asset_id % 2 = 1").withColumn("category", F.lit("other")).withColumn("arrival", F.lit(1))
    return queue.first_wins(early.union(base.withColumn("arrival", F.lit(2)))).select("asset_id", "category")


@query("dec11", """
select category, count(*) as n, sum(byte_size)::bigint as bytes from open_candidates group by category
union all select 'duplicate', count(*), sum(byte_size)::bigint from selected where tier < 2 and not kept having count(*) > 0
""", ("open_candidates", "selected"))
def counts(lib: Library) -> DataFrame:
    return queue.category_counts(open_candidates(lib), scan.selected(lib)).drop("library_id")


@query("dec12", """
select (select sum(byte_size) from candidates where asset_id not in (select asset_id from pending_ids))::bigint
 + (select coalesce(sum(byte_size), 0) from selected where not kept)::bigint as bytes
""", ("candidates", "pending_ids", "selected"))
def savings(lib: Library) -> DataFrame:
    return queue.potential_savings(lib.candidates(), pending_ids(lib), scan.selected(lib)).drop("library_id")


@query("dec13", """
select category from (values ('mapScreenshot'), ('webShot'), ('other')) v(category) where category not in (select category from open_candidates)
""", ("open_candidates",))
def untaught(lib: Library) -> DataFrame:
    return queue.untaught(open_candidates(lib)).drop("library_id")
