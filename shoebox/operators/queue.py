"""Decisions, the pending queue and decks, from an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.fixed import GRACE_DAYS, HEAD_ONLY, TIERS
from shoebox.operators.asof import as_of
from shoebox.operators.distributed import Sequence, numbered, owned, shared, top_k
from shoebox.operators.keepers import discardable
from shoebox.operators.settings import grace_days

DECISIONS = ("delete", "keepOnce", "whitelist")


def with_undo(decisions: DataFrame, session: list[str], bound: int = 1_000_000) -> DataFrame:
    """Decisions with ``undone`` and the undo event that takes them back.

    Undo is last-in first-out within a session. The stack depth is a prefix sum reflected at zero
    (an undo on an empty stack does nothing); at one depth, decisions and the undos that
    pop them alternate, so a decision is undone when the next event at its depth is an undo.
    """
    steps = decisions.filter(F.col("action").isin(*DECISIONS, "undo")).select(
        *session, "event_id", "asset_id", "ts", "action", "bytes",
        F.when(F.col("action") == "undo", -1).otherwise(1).cast("bigint").alias("step"),
    )
    walk = Sequence(steps, session, [F.col("ts"), F.col("event_id")], "undo", bound)
    walk = walk.running_sum("step", "total").running_min("total", "low").previous("low").result()
    floor = F.least(F.col("low"), F.lit(0))
    floor_before = F.least(F.coalesce("prev_low", F.lit(0)), F.lit(0))
    # an undo on an empty stack is the one that makes a new negative minimum
    on_empty = (F.col("action") == "undo") & (floor < floor_before)
    depth = F.col("total") - floor
    level = F.when(F.col("action") == "undo", depth + 1).otherwise(depth)
    effective = walk.filter(~on_empty).withColumn("level", level)
    backwards = Sequence(effective, [*session, "level"], [F.desc("ts"), F.desc("event_id")], "undo-levels", bound)
    paired = backwards.previous("action", "event_id", "ts").result()
    undone = F.coalesce(F.col("prev_action") == "undo", F.lit(False))
    return paired.filter("action <> 'undo'").select(
        *session, "event_id", "asset_id", "ts", "action", "bytes",
        undone.alias("undone"), F.when(undone, F.col("prev_ts")).alias("undone_at"), F.when(undone, F.col("prev_event_id")).alias("undo_event_id"),
    )


def current_state(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Per asset: whether it is pending, since when and with how many bytes, and whether it is protected.

    ``resolved`` comes from ``with_undo``. A delete marks, any other decision and the undo of a delete unmark; a whitelist protects until
    it is undone, whatever is decided later. Undoing a keep never marks again.
    """
    effects = resolved.select(
        *keys, F.col("ts").alias("at"), F.col("event_id").alias("seq"), "bytes",
        (F.col("action") == "delete").alias("marks"), F.when(F.col("action") == "whitelist", True).alias("protects"),
    ).union(
        resolved.filter("undone and action <> 'keepOnce'").select(
            *keys, "undone_at", "undo_event_id", "bytes",
            F.when(F.col("action") == "delete", False), F.when(F.col("action") == "whitelist", False),
        )
    )
    last = lambda c: F.max_by(F.struct(c, "at", "bytes"), F.when(F.col(c).isNotNull(), F.struct("at", "seq"))).alias(f"last_{c}")
    state = effects.groupBy(*keys).agg(last("marks"), last("protects"))
    pending = F.coalesce("last_marks.marks", F.lit(False))
    return state.select(
        *keys, pending.alias("pending"), F.coalesce("last_protects.protects", F.lit(False)).alias("protected"),
        F.when(pending, F.col("last_marks.at")).alias("marked_at"), F.when(pending, F.col("last_marks.bytes")).alias("bytes"),
    )


def pending_items(state: DataFrame, keys: list[str]) -> DataFrame:
    return state.filter("pending").select(*keys, "marked_at", "bytes")


def protected_items(state: DataFrame, keys: list[str]) -> DataFrame:
    return state.filter("protected").select(*keys)


def newest_first(pending: DataFrame, keys: list[str]) -> DataFrame:
    """All pending items of each library, the newest mark first."""
    order = [F.desc("marked_at"), *[F.col(k) for k in keys]]
    return numbered(pending, ["library_id"], order, "position", "pending-items")


def session_counters(resolved: DataFrame, session: list[str]) -> DataFrame:
    """Marked, kept and whitelisted per session, net of undos."""
    standing = resolved.filter(~F.col("undone"))
    is_ = lambda a: F.col("action") == a
    return standing.groupBy(*session).agg(
        F.count_if(is_("delete")).alias("marked"),
        F.sum(F.when(is_("delete"), F.col("bytes")).otherwise(0)).cast("bigint").alias("marked_bytes"),
        F.count_if(is_("keepOnce")).alias("kept"), F.count_if(is_("whitelist")).alias("whitelisted"),
    )


def with_deadline(pending: DataFrame, grace: str = "oneWeek") -> DataFrame:
    """Adds ``execute_after``. ``grace`` is the setting for all, or the name of a column that holds each library's."""
    days = grace_days(grace) if grace in pending.columns else F.lit(GRACE_DAYS[grace])
    return pending.withColumn("execute_after", F.col("marked_at") + F.make_interval(days=days.cast("int")))


def category_at_mark(pending: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """``pending`` with the ``category`` each item had when it was marked: the last of ``named`` (keys, named_at, seq, category) at or before
    the mark, "other" if there is none. What an item is called later does not change it.
    """
    known = named.select(*keys, "named_at", F.struct("seq", "category").alias("_named"))
    found = as_of(pending, known, keys, "marked_at", "named_at", ["_named"], name="category-at-mark")
    return found.select(*pending.columns, F.coalesce("_named.category", F.lit("other")).alias("category"))


def due_items(pending: DataFrame, now: str, keys: list[str]) -> DataFrame:
    """Items whose grace ended by ``now``, numbered oldest mark first."""
    due = pending.filter(F.col("execute_after") <= F.lit(now).cast("timestamp"))
    order = [F.col("marked_at"), *[F.col(k) for k in keys]]
    return numbered(due, [], order, "position", "due-items")


def restore(pending: DataFrame, restored: DataFrame, keys: list[str]) -> DataFrame:
    return pending.join(restored.select(*keys), keys, "left_anti")


def without(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(ids.select(*keys), keys, "left_anti")


def priority(confidence: Column, size: Column, score: Column | None = None, influence: Column | None = None) -> Column:
    """Confidence, blended with the learned score, times a logarithmic size weight."""
    p = confidence
    if score is not None:
        p = F.when((influence > 0) & score.isNotNull(), confidence * (1 - influence) + score * influence).otherwise(confidence)
    weight = F.log2(F.greatest(size, F.lit(65536)) / F.lit(65536.0)) / 10
    return p * (0.55 + weight)


def open_candidates(candidates: DataFrame, pending: DataFrame, protected: DataFrame, prefer_keep: DataFrame) -> DataFrame:
    """Candidates neither marked, nor protected, nor under a keep-always label."""
    rows = candidates
    for gone in (pending, protected, prefer_keep):
        on = shared(rows, gone, "asset_id")
        rows = rows.join(gone.select(*on), on, "left_anti")
    return rows


def decks(open_rows: DataFrame, size: int = 60) -> DataFrame:
    """The first cards of every category of a library in queue order."""
    return top_k(open_rows, owned(open_rows, "category"), [F.desc("priority"), F.col("asset_id")], size, "position")


def top_up(deck: DataFrame, arrivals: DataFrame, size: int = 60) -> DataFrame:
    """New cards per library and category (first come first), for decks still below three times the size."""
    category, asset = shared(deck, arrivals, "category"), shared(deck, arrivals, "asset_id")
    full = deck.groupBy(*category).agg(F.count(F.lit(1)).alias("cards")).filter(F.col("cards") >= 3 * size)
    fresh = arrivals.join(deck.select(*asset), asset, "left_anti").join(full, category, "left_anti")
    return top_k(fresh, owned(fresh, "category"), [F.col("arrival"), F.col("asset_id")], size, "position")


def first_wins(arrivals: DataFrame) -> DataFrame:
    """One candidate per asset: the first to arrive."""
    keys = owned(arrivals, "asset_id")
    rest = [c for c in arrivals.columns if c not in keys]
    first = arrivals.groupBy(*keys).agg(F.min_by(F.struct(*rest), "arrival").alias("_row"))
    return first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def category_counts(open_rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """Open candidates per library and category, plus the discardables of copy groups as ``duplicate``."""
    keys = shared(open_rows, grouped)
    counts = open_rows.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"), F.sum("byte_size").alias("bytes"))
    spare = grouped.filter((F.col("tier") < TIERS["moment"]) & discardable(grouped))
    duplicate = spare.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))
    return counts.union(duplicate.filter("n > 0").select(*keys, F.lit("duplicate"), "n", "bytes"))


def potential_savings(candidates: DataFrame, pending: DataFrame, grouped: DataFrame) -> DataFrame:
    """Bytes of unmarked candidates plus bytes reclaimable from groups, per library."""
    on, keys = shared(candidates, pending, "asset_id"), shared(candidates, grouped)
    unmarked = candidates.join(pending.select(*on), on, "left_anti").select(*keys, "byte_size")
    spare = grouped.filter(discardable(grouped)).select(*keys, "byte_size")
    return unmarked.union(spare).groupBy(*keys).agg(F.sum("byte_size").alias("bytes"))


def untaught(open_rows: DataFrame) -> DataFrame:
    """Categories only the learned head can give, of which a library has no open candidate."""
    if "library_id" in open_rows.columns:
        wanted = open_rows.select("library_id").distinct().withColumn("category", F.explode(F.array(*map(F.lit, HEAD_ONLY))))
    else:
        wanted = open_rows.sparkSession.createDataFrame([(c,) for c in HEAD_ONLY], "category string")
    keys = owned(wanted, "category")
    return wanted.join(open_rows.select(*keys).distinct(), keys, "left_anti")
