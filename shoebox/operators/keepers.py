"""Which member of a group to keep, and what the groups add up to.

Group-wide facts are aggregates joined back to the members, never a window over a group: a group
may be huge. Ranks inside groups use the sliced numbering of ``distributed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions import scalars
from shoebox.functions.fixed import TIERS
from shoebox.operators.distributed import attach, numbered, owned, shared


def member_rows(members: DataFrame, assets: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Members with the asset columns that scoring reads."""
    facts = scalars.with_derived(assets).select(
        "library_id", "asset_id", "creation_ts", "pixel_width", "pixel_height", "pixel_count", "byte_size", "content_hash",
        "is_favorite", "is_live", "is_portrait", "is_screenshot", "has_location",
    )
    prints = fingerprints.select(*owned(fingerprints, "asset_id"), "sharpness", "dhash", "phash")
    return members.join(facts, shared(members, facts, "asset_id")).join(prints, shared(facts, prints, "asset_id"), "left")


# Points of a member's score; shares of the group's best are scaled by theirs.
FLAG_POINTS = {"is_favorite": 1000.0, "is_live": 60.0, "is_portrait": 50.0, "has_location": 25.0, "is_protected": 5000.0}
CAMERA_POINTS, RESOLUTION_POINTS, SIZE_POINTS, SHARPNESS_POINTS, RECENCY_POINTS = 15.0, 120, 60, 70, 40


def with_scores(rows: DataFrame, protected: DataFrame | None = None, bound: int = 1_000_000) -> DataFrame:
    """Adds ``score`` and ``reason`` to every member."""
    if protected is None:
        rows = rows.withColumn("is_protected", F.lit(False))
    else:
        marks = protected.select(*owned(protected, "asset_id"), F.lit(True).alias("is_protected")).distinct()
        rows = rows.join(marks, shared(rows, marks, "asset_id"), "left").withColumn("is_protected", F.coalesce("is_protected", F.lit(False)))
    stats = rows.groupBy(*owned(rows, "group_key")).agg(
        F.count(F.lit(1)).alias("size"), F.max("pixel_count").alias("max_px"), F.min("pixel_count").alias("min_px"),
        F.max("byte_size").alias("max_bytes"), F.min("byte_size").alias("min_bytes"),
        F.max("creation_ts").alias("newest"), F.min("creation_ts").alias("oldest"),
    )
    rows = attach(rows, stats, owned(rows, "group_key"), "size", bound)
    px = F.when(F.col("max_px") > 0, F.col("pixel_count") / F.col("max_px"))
    size = F.when(F.col("max_bytes") > 0, F.col("byte_size") / F.col("max_bytes"))
    span = F.unix_micros("newest") - F.unix_micros("oldest")
    recent = F.when(
        (F.col("tier") == TIERS["moment"]) & (span > 0), (F.unix_micros("creation_ts") - F.unix_micros("oldest")) / span
    )
    flag = lambda name: F.when(F.col(name), FLAG_POINTS[name]).otherwise(0.0)
    share = lambda value, points: F.coalesce(value * points, F.lit(0.0))
    score = (
        flag("is_favorite") + flag("is_live") + flag("is_portrait") + flag("has_location")
        + F.when(F.col("is_screenshot"), 0.0).otherwise(CAMERA_POINTS)
        + share(px, RESOLUTION_POINTS) + share(size, SIZE_POINTS)
        + share(F.col("sharpness"), SHARPNESS_POINTS) + share(recent, RECENCY_POINTS)
        + flag("is_protected")
    )
    notes = F.array_compact(F.array(
        F.when(F.col("is_favorite"), "favorite"),
        F.when(F.col("is_live"), "live photo"),
        F.when(F.col("is_portrait"), "portrait depth"),
        F.when(F.col("has_location"), "has location"),
        F.when((px >= 0.999) & (F.col("min_px") < F.col("max_px")), "top resolution"),
        F.when((size >= 0.999) & (F.col("min_bytes") < F.col("max_bytes")), "least quality loss"),
        F.when(F.col("sharpness") > 0.6, "sharpest"),
        F.when(recent >= 0.999, "newest"),
    ))
    reason = (
        F.when(F.col("is_protected"), "kept by you")
        .when(F.size(notes) > 0, F.array_join(F.slice(notes, 1, 2), " · "))
        .otherwise("best overall score")
    )
    return rows.withColumn("score", score).withColumn("reason", reason)


def keepers(scored: DataFrame) -> DataFrame:
    """(group_key, keeper_id, keeper_reason, size): best score, ties to the smallest id.

    Scores within 1e-9 count as equal by rounding to 9 places; only two scores that
    straddle a rounding edge could be ordered differently from a pairwise comparison.
    """
    best = F.min_by(F.struct("asset_id", "reason"), F.struct((-F.round("score", 9)).alias("s"), F.col("asset_id"))).alias("best")
    keys = owned(scored, "group_key")
    return scored.groupBy(*keys).agg(best, F.count(F.lit(1)).alias("size")).select(
        *keys, F.col("best.asset_id").alias("keeper_id"), F.col("best.reason").alias("keeper_reason"), "size"
    )


def with_keepers(scored: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """Members with ``group_id`` (the keeper's id) and ``is_keeper``."""
    return (
        attach(scored, keepers(scored), owned(scored, "group_key"), "size", bound)
        .withColumn("group_id", F.col("keeper_id"))
        .withColumn("is_keeper", F.col("asset_id") == F.col("keeper_id"))
    )


def member_order(grouped: DataFrame) -> DataFrame:
    """Adds ``position``: the keeper first, then newest first."""
    order = [F.col("is_keeper").desc(), F.col("creation_ts").desc(), F.col("asset_id")]
    return numbered(grouped, owned(grouped, "group_id"), order, "position", "member-order")


def group_table(grouped: DataFrame) -> DataFrame:
    """One row per group: tier, size and the bytes its non-keepers hold."""
    return grouped.groupBy(*owned(grouped, "group_id"), "tier").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum(F.when(F.col("is_keeper"), 0).otherwise(F.col("byte_size"))).cast("bigint").alias("reclaimable"),
        F.first("keeper_reason").alias("keeper_reason"),
    )


def sorted_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy("tier", F.desc("reclaimable"), "group_id")


def discardable(grouped: DataFrame) -> Column:
    """Members the user does not keep: outside the kept set where one was applied, else all but the default keeper."""
    return ~F.col("kept") if "kept" in grouped.columns else ~F.col("is_keeper")


def leads(grouped: DataFrame) -> Column:
    """The one member others are measured against."""
    return F.col("asset_id") == F.col("effective_keeper") if "effective_keeper" in grouped.columns else F.col("is_keeper")


def eligible(assets: DataFrame, protected: DataFrame, include_videos: bool = True) -> DataFrame:
    """Assets that may be grouped at all."""
    pool = assets if include_videos else assets.filter(~F.col("is_video"))
    return pool.join(protected.select(*owned(protected, "asset_id")), shared(pool, protected, "asset_id"), "left_anti")


def worthwhile(grouped: DataFrame, skip_favorites: bool = True) -> DataFrame:
    """Drops groups in which every discardable member is a favorite."""
    if not skip_favorites:
        return grouped
    keep = (
        grouped.groupBy(*owned(grouped, "group_id"))
        .agg(F.max(discardable(grouped) & ~F.col("is_favorite")).alias("offers"))
        .filter("offers").drop("offers")
    )
    return grouped.join(keep, owned(grouped, "group_id"), "left_semi")


def apply_selection(grouped: DataFrame, selection: DataFrame) -> DataFrame:
    """Replaces the default keeper of a group by the user's kept set (group_id, asset_id, kept).

    An empty choice falls back to the default keeper, so at least one member is always kept.
    ``effective_keeper`` is the default keeper if still kept, else the first kept member
    in group order (newest, then smallest id).
    """
    group = shared(grouped, selection, "group_id")
    chosen = selection.filter("kept").select(*group, "asset_id", F.lit(True).alias("chosen"))
    touched = chosen.select(*group, F.lit(True).alias("touched")).distinct()
    rows = grouped.join(touched, group, "left").join(chosen, [*group, "asset_id"], "left")
    kept = F.when(F.coalesce("touched", F.lit(False)), F.coalesce("chosen", F.lit(False))).otherwise(F.col("is_keeper"))
    rows = rows.withColumn("kept", kept).drop("touched", "chosen")
    first_kept = F.struct((~F.col("is_keeper")).alias("k"), (-F.unix_micros("creation_ts")).alias("t"), F.col("asset_id"))
    effective = rows.groupBy(*owned(rows, "group_id")).agg(
        F.min_by(F.when(F.col("kept"), F.col("asset_id")), F.when(F.col("kept"), first_kept)).alias("effective_keeper"), F.count(F.lit(1)).alias("size")
    )
    return attach(rows, effective, owned(rows, "group_id"), "size")


def tier_summary(grouped: DataFrame) -> DataFrame:
    """Groups, discardables and reclaimable bytes per tier, for copies together, and for all."""
    spare = discardable(grouped)
    per_group = grouped.groupBy(*owned(grouped, "group_id"), "tier").agg(
        F.count_if(spare).alias("discardable"),
        F.sum(F.when(spare, F.col("byte_size")).otherwise(0)).cast("bigint").alias("reclaimable"),
    )
    level = F.when(F.col("tier") == TIERS["moment"], "moments").otherwise("copies")
    name = F.when(F.col("tier") == TIERS["identical"], "identical").when(F.col("tier") == TIERS["copy"], "copy").otherwise("moment")
    rolled = (
        per_group.withColumn("level", level).withColumn("name", name)
        .rollup("level", "name")
        .agg(
            F.count(F.lit(1)).alias("groups"), F.sum("discardable").alias("discardable"), F.sum("reclaimable").alias("reclaimable"),
            F.grouping_id().alias("g"),
        )
    )
    label = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, F.concat("level", F.lit(" total"))).otherwise(F.col("name"))
    return rolled.select(label.alias("scope"), "groups", "discardable", "reclaimable").filter("scope <> 'moments total'")


def one_tap_items(grouped: DataFrame, unticked: DataFrame | None = None) -> DataFrame:
    """Discardables of identical groups, the only ones swept without a look."""
    rows = grouped.filter((F.col("tier") == TIERS["identical"]) & discardable(grouped))
    if unticked is not None:
        rows = rows.join(unticked.select(*shared(rows, unticked, "group_id")), shared(rows, unticked, "group_id"), "left_anti")
    return rows.select(*owned(rows, "asset_id"), "group_id", "byte_size", F.lit("duplicate").alias("category"))


def skip_groups(grouped: DataFrame, skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining members, newly protected ids)."""
    on = shared(grouped, skipped, "group_id")
    keys = skipped.select(*on)
    return grouped.join(keys, on, "left_anti"), grouped.join(keys, on, "left_semi").select(*owned(grouped, "asset_id"))


def mark_groups(grouped: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining members, items to put in the pending queue as duplicates)."""
    on = shared(grouped, marked, "group_id")
    keys = marked.select(*on)
    items = grouped.join(keys, on, "left_semi").filter(discardable(grouped))
    return (
        grouped.join(keys, on, "left_anti"),
        items.select(*owned(items, "asset_id"), F.col("byte_size").alias("bytes"), F.lit("duplicate").alias("category")),
    )


def quality_badges(grouped: DataFrame) -> DataFrame:
    """Up to two measurable hints per member."""
    stats = grouped.groupBy(*owned(grouped, "group_id")).agg(
        F.max("sharpness").alias("best_sharp"), F.min("sharpness").alias("worst_sharp"), F.count("sharpness").alias("scored"),
        F.count(F.lit(1)).alias("size"), F.max("creation_ts").alias("last_ts"),
        F.max(F.struct("pixel_count", "byte_size")).alias("top"),
        F.min(F.struct((-F.col("pixel_count")).alias("px"), F.col("byte_size"))).alias("low_at_top"),
        F.min("pixel_count").alias("low_px"),
    )
    rows = attach(grouped, stats.withColumn("rows", F.col("size")), owned(grouped, "group_id"), "rows")
    sharpest = (F.col("sharpness") >= F.col("best_sharp") - 0.001) & (F.col("scored") > 1) & (F.col("worst_sharp") < F.col("best_sharp") - 0.03)
    at_top = F.col("pixel_count") == F.col("top.pixel_count")
    # several members at top resolution with unequal sizes: low and high differ there
    best_quality = at_top & (F.col("byte_size") == F.col("top.byte_size")) & (F.col("low_at_top.byte_size") < F.col("top.byte_size"))
    badges = F.array_compact(F.array(
        F.when(sharpest, "sharpest"),
        F.when(at_top & (F.col("low_px") < F.col("top.pixel_count")), "top resolution"),
        F.when(best_quality, "best quality"),
        F.when((F.col("creation_ts") == F.col("last_ts")) & (F.col("size") > 1), "last shot"),
        F.when(F.col("is_favorite"), "favorite"),
    ))
    return rows.select(*owned(rows, "group_id"), "asset_id", F.slice(badges, 1, 2).alias("badges"))


def difference_summary(grouped: DataFrame) -> DataFrame:
    """What differs between a group's versions, one row per group."""
    by_px = lambda pick: pick(F.struct("pixel_width", "pixel_height"), F.struct("pixel_count", "asset_id"))
    positive = F.when(F.col("byte_size") > 0, F.col("byte_size"))
    stats = grouped.groupBy(*owned(grouped, "group_id"), "tier").agg(
        F.count(F.lit(1)).alias("size"), F.min("pixel_count").alias("low_px"), F.max("pixel_count").alias("high_px"),
        by_px(F.max_by).alias("hi"), by_px(F.min_by).alias("lo"),
        F.max(positive).alias("max_bytes"), F.min(positive).alias("min_bytes"),
    )
    ratio = F.col("max_bytes") / F.col("min_bytes")
    resolution = F.when(
        F.col("low_px") < F.col("high_px"),
        F.format_string("resolution differs: %dx%d to %dx%d", "hi.pixel_width", "hi.pixel_height", "lo.pixel_width", "lo.pixel_height"),
    )
    quality = F.when(ratio > 1.6, F.format_string("quality differs: largest file is %d times the smallest", F.round(ratio).cast("bigint")))
    lines = F.array_compact(F.array(resolution, quality))
    summary = (
        F.when(F.col("tier") == TIERS["identical"], F.array(F.format_string("the same picture stored %d times", "size")))
        .when(F.size(lines) == 0, F.array(F.lit("looks the same, details differ slightly")))
        .otherwise(F.concat(F.array(F.lit("versions of one picture")), lines))
    )
    return stats.select(*owned(stats, "group_id"), F.array_join(summary, "; ").alias("summary"))


def with_keeper_hashes(grouped: DataFrame) -> DataFrame:
    """Members with their keeper's hashes as ``kd`` and ``kp``."""
    kept = lambda c: F.max(F.when(leads(grouped), F.col(c)))
    keeper = grouped.groupBy(*owned(grouped, "group_id")).agg(kept("dhash").alias("kd"), kept("phash").alias("kp"), F.count(F.lit(1)).alias("size"))
    return attach(grouped, keeper, owned(grouped, "group_id"), "size")


def safety_evidence(grouped: DataFrame) -> DataFrame:
    """Checkable facts per group: equal contents, sizes, dimensions, and the farthest member."""
    other = ~leads(grouped)
    dims = F.format_string("%dx%d", "pixel_width", "pixel_height")
    # distinct dimensions first, so that the list collected per group has one entry per screen size, not per member
    rows = with_keeper_hashes(grouped)
    per_dims = rows.withColumn("dims", dims).groupBy(*owned(rows, "group_id"), "dims").agg(
        F.count(F.lit(1)).alias("size"), F.count("dhash").alias("printed"),
        F.min("content_hash").alias("low"), F.max("content_hash").alias("high"),
        F.min("byte_size").alias("low_bytes"), F.max("byte_size").alias("high_bytes"),
        F.max(F.when(other, scalars.hamming("dhash", "kd"))).alias("d"), F.max(F.when(other, scalars.hamming("phash", "kp"))).alias("p"),
    )
    return per_dims.groupBy(*owned(per_dims, "group_id")).agg(
        ((F.sum("size") == F.sum("printed")) & (F.min("low") == F.max("high"))).alias("contents_match"),
        F.array_join(F.array_sort(F.collect_set("dims")), " / ").alias("dimensions"),
        (F.min("low_bytes") == F.max("high_bytes")).alias("sizes_match"),
        F.max("d").alias("max_dhash_distance"), F.max("p").alias("max_phash_distance"),
    )
