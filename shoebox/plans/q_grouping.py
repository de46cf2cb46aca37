"""Queries: duplicate copies, moments, keepers and group assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions import scalars
from shoebox.operators import copies, keepers, moments, settings
from shoebox.operators.distributed import attach
from shoebox.plans import scan
from shoebox.plans.registry import query
from shoebox.sources.derived import Library


HASH_NODES = """
hash_nodes as (select min(asset_id) as node, dhash, phash, pixel_width::double / pixel_height as shape
  from images where not is_screen_like group by dhash, phash, pixel_width::double / pixel_height)
"""

PAIRS_ORACLE = f"""
select a.node as a, b.node as b, bit_count(xor(a.dhash, b.dhash))::int as d, bit_count(xor(a.phash, b.phash))::int as p
from hash_nodes a join hash_nodes b on a.node < b.node and a.shape = b.shape
where bit_count(xor(a.dhash, b.dhash)) <= 2 and bit_count(xor(a.phash, b.phash)) <= 4
"""


@query("dup1", f", {HASH_NODES} {PAIRS_ORACLE}", ("images",))
def candidates(lib: Library) -> DataFrame:
    return copies.candidate_pairs(scan.signature_rows(lib)).select("a", "b", "d", "p")


@query("dup2", f"""
select band, value, count(*) as members, count(*) > 4000 as over_reference_cap from (
 select band, case band {' '.join(f'when {i} then ((dhash >> {8 * i}) & 255)' for i in range(8))} end as value
 from (select distinct dhash from images) cross join range(8) r(band))
group by band, value
""", ("images",))
def buckets(lib: Library) -> DataFrame:
    sizes = copies.bucket_sizes(scan.signature_rows(lib))
    return sizes.select(F.col("band").cast("bigint").alias("band"), "value", "members", (F.col("members") > 4000).alias("over_reference_cap"))


@query("dup3", f", {HASH_NODES}, pairs as ({PAIRS_ORACLE}) select d, p, count(*) as pairs from pairs group by d, p", ("images",))
def pair_distances(lib: Library) -> DataFrame:
    return copies.candidate_pairs(scan.signature_rows(lib)).groupBy("d", "p").agg(F.count(F.lit(1)).alias("pairs"))


@query("dup4", """
select g.tier, count(*) as components, sum(n)::bigint as members from copy_groups g
join (select group_key, count(*) as n from copy_members group by group_key) using (group_key) group by g.tier
""", ("copy_groups", "copy_members"))
def tiers(lib: Library) -> DataFrame:
    sizes = scan.copy_members(lib).groupBy("group_key", "tier").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("tier").agg(F.count(F.lit(1)).alias("components"), F.sum("n").alias("members"))


@query("dup5", """
select asset_id, min(asset_id) over w as star from images
window w as (partition by content_hash, pixel_width, pixel_height) qualify count(*) over w > 1
""", ("images",))
def identical_sets(lib: Library) -> DataFrame:
    keys = ["library_id", "content_hash", "pixel_width", "pixel_height"]
    stars = scan.signature_rows(lib).groupBy(*keys).agg(F.min("node").alias("star"), F.sum("copies").alias("n")).filter("n > 1")
    return attach(scan.image_rows(lib), stars, keys, "n").select("asset_id", "star")


@query("dup6", "select asset_id, group_key as label from copy_members", ("copy_members",))
def components(lib: Library) -> DataFrame:
    return scan.copy_members(lib).select("asset_id", F.col("group_key").alias("label"))


@query("dup7", "select group_key, tier from copy_groups", ("copy_groups",))
def component_tiers(lib: Library) -> DataFrame:
    return scan.copy_labels(lib).groupBy(F.col("label").alias("group_key")).agg(F.max("tier").alias("tier"))


@query("dup8", """
select asset_id from images where not is_screen_like and asset_id not in (select asset_id from copy_members)
""", ("images", "copy_members"))
def unclaimed(lib: Library) -> DataFrame:
    return moments.unclaimed_photos(scan.image_rows(lib), scan.copy_members(lib)).select("asset_id")


@query("dup9", "select group_key, asset_id from video_members", ("video_members",))
def videos(lib: Library) -> DataFrame:
    return copies.video_members(lib.assets()).select("group_key", "asset_id")


@query("mom1", "select asset_id, min(asset_id) over (partition by run) as run_start, count(*) over (partition by run) as members from photo_runs", ("photo_runs",))
def runs(lib: Library) -> DataFrame:
    rows = scan.runs(lib)
    sizes = rows.groupBy("library_id", "run").agg(F.min("asset_id").alias("run_start"), F.count(F.lit(1)).alias("members"))
    return attach(rows, sizes.withColumn("n", F.col("members")), ["library_id", "run"], "n").select("asset_id", "run_start", "members")


@query("mom2", """
select strictness, moment_window, count_if(starts)::bigint as runs from (
 select s.strictness, 5 + (1 - s.strictness) * 35 as moment_window,
  not (coalesce((epoch_us(creation_ts) - epoch_us(lag(creation_ts) over o)) / 1e6 <= 5 + (1 - s.strictness) * 35, false)
   or coalesce(burst_id = lag(burst_id) over o, false)) as starts
 from images cross join (values (0.0::double), (0.5::double), (1.0::double)) s(strictness)
 where not is_screen_like and asset_id not in (select asset_id from copy_members)
 window o as (partition by s.strictness order by creation_ts, asset_id))
group by all
""", ("images", "copy_members"))
def strictness(lib: Library) -> DataFrame:
    photos = moments.unclaimed_photos(scan.image_rows(lib), scan.copy_members(lib))
    out = None
    for s in (0.0, 0.5, 1.0):
        window = scalars.moment_window(s)
        counts = moments.time_runs(photos, window).agg(F.max("run").alias("runs")).select(
            F.lit(s).alias("strictness"), F.lit(window).alias("moment_window"), "runs"
        )
        out = counts if out is None else out.union(counts)
    return out


@query("mom2_settings", """
, p as (select *, (asset_id // 20) % 3 as lib, case (asset_id // 20) % 3 when 0 then 40.0::double when 1 then 22.5::double else 10.0::double end as win
 from images where not is_screen_like and asset_id not in (select asset_id from copy_members)),
r as (select *, sum(case when keep then 0 else 1 end) over (partition by lib order by creation_ts, asset_id rows unbounded preceding)::bigint as run from
 (select *, coalesce((epoch_us(creation_ts) - epoch_us(lag(creation_ts) over o)) / 1e6 <= win, false) or coalesce(burst_id = lag(burst_id) over o, false) as keep
  from p window o as (partition by lib order by creation_ts, asset_id)))
select lib::bigint as library_id, first_id, members, case when bursts = members and n_bursts = 1 then 'vouched' when span > win * 6 then 'span' when members > 12 then 'size'
 when members >= 3 and same_stamp::double / members > 0.6 then 'batch' else 'ok' end as verdict
from (select lib, run, max(win) as win, count(*) as members, count(burst_id) as bursts, count(distinct burst_id) as n_bursts, min(asset_id) as first_id,
  (epoch_us(max(creation_ts)) - epoch_us(min(creation_ts))) / 1e6 as span from r group by lib, run having count(*) > 1)
join (select lib, run, max(n) as same_stamp from (select lib, run, creation_ts, count(*) as n from r group by all) group by all) using (lib, run)
""", ("images", "copy_members"))
def moments_by_settings(lib: Library) -> DataFrame:
    """Three libraries in one job, one loose, one between, one without settings."""
    photos = moments.unclaimed_photos(scan.image_rows(lib), scan.copy_members(lib)).withColumn("library_id", F.floor(F.col("asset_id") / 20) % 3)
    given = lib.spark.createDataFrame([(0, 0.0), (1, 0.5), (2, None)], "library_id bigint, strictness double")
    photos = settings.with_settings(photos, given, strictness=6 / 7).withColumn("moment_window", settings.moment_window())
    return moments.run_verdicts(moments.time_runs(photos, "moment_window"), "moment_window").select("library_id", "first_id", "members", "verdict")


@query("mom3", "select first_id, members from run_verdicts where verdict = 'vouched'", ("run_verdicts",))
def vouched(lib: Library) -> DataFrame:
    return scan.verdicts(lib).filter("verdict = 'vouched'").select("first_id", "members")


@query("mom4", """
select first_id, members, round(span_seconds, 6) as span_seconds, span_seconds <= 60 as span_ok, members <= 12 as size_ok from run_verdicts
""", ("run_verdicts",))
def guards(lib: Library) -> DataFrame:
    return scan.verdicts(lib).select(
        "first_id", "members", F.round("span_seconds", 6).alias("span_seconds"),
        (F.col("span_seconds") <= 60).alias("span_ok"), (F.col("members") <= 12).alias("size_ok"),
    )


@query("mom5", """
select first_id, members, same_stamp, members >= 3 and same_stamp::double / members > 0.6 as batch_write from run_verdicts
""", ("run_verdicts",))
def batch_guard(lib: Library) -> DataFrame:
    share = F.col("same_stamp") / F.col("members")
    return scan.verdicts(lib).select("first_id", "members", "same_stamp", ((F.col("members") >= 3) & (share > 0.6)).alias("batch_write"))


@query("mom6", "select verdict, count(*) as runs, sum(members)::bigint as members from run_verdicts group by verdict", ("run_verdicts",))
def dropped(lib: Library) -> DataFrame:
    return scan.verdicts(lib).groupBy("verdict").agg(F.count(F.lit(1)).alias("runs"), F.sum("members").alias("members"))


@query("mom7", """
select p.a, p.b from moment_pairs p join photo_runs r on r.asset_id = p.a join run_verdicts v on v.run = r.run
where v.verdict = 'ok' or p.a = v.first_id
""", ("moment_pairs", "photo_runs", "run_verdicts"))
def moment_pairs(lib: Library) -> DataFrame:
    return scan.moment_edges(lib).select(F.col("src").alias("a"), F.col("dst").alias("b"))


@query("mom8", "select group_key, asset_id from moment_members", ("moment_members",))
def moment_groups(lib: Library) -> DataFrame:
    return scan.moment_members(lib).select("group_key", "asset_id")


@query("kee1", "select group_key, asset_id, round(score, 6) as score from scored", ("scored",))
def scores(lib: Library) -> DataFrame:
    return scan.scored(lib).select("group_key", "asset_id", F.round("score", 6).alias("score"))


@query("kee2", "select asset_id, reason from grouped", ("grouped",))
def reasons(lib: Library) -> DataFrame:
    return scan.grouped(lib).select("asset_id", "reason")


@query("kee3", """
select asset_id, round(score + case when asset_id in (select asset_id from protected) then 5000 else 0 end, 6) as score,
 case when asset_id in (select asset_id from protected) then 'kept by you' else reason end as reason from grouped
""", ("grouped", "protected"))
def protected_scores(lib: Library) -> DataFrame:
    rows = keepers.member_rows(scan.members(lib), lib.assets(), lib.fingerprints())
    return keepers.with_scores(rows, scan.protected(lib)).select("asset_id", F.round("score", 6).alias("score"), "reason")


@query("kee4", "select group_key, asset_id as keeper_id, reason as keeper_reason from grouped where is_keeper", ("grouped",))
def keeper_choice(lib: Library) -> DataFrame:
    return keepers.keepers(scan.scored(lib)).drop("size", "library_id")


@query("kee5", """
select group_id, asset_id, row_number() over (partition by group_id order by is_keeper desc, creation_ts desc, asset_id) as position from grouped
""", ("grouped",))
def order(lib: Library) -> DataFrame:
    return keepers.member_order(scan.grouped(lib)).select("group_id", "asset_id", "position")


GROUP_TABLE = """
select group_id, tier, count(*) as members, sum(case when is_keeper then 0 else byte_size end)::bigint as reclaimable,
 max(case when is_keeper then reason end) as keeper_reason from grouped group by group_id, tier
"""


@query("kee6", GROUP_TABLE, ("grouped",))
def groups(lib: Library) -> DataFrame:
    return scan.flagship(lib).drop("library_id")


@query("kee7", "select group_key, tier, asset_id from members", ("members",))
def all_members(lib: Library) -> DataFrame:
    return scan.members(lib).select("group_key", "tier", "asset_id")


@query("kee8", """
select g.group_id, count(*) as members from grouped g where g.group_id in
 (select group_id from grouped group by group_id having bool_or(not is_keeper and not is_favorite)) group by g.group_id
""", ("grouped",))
def worthwhile(lib: Library) -> DataFrame:
    return keepers.worthwhile(scan.grouped(lib)).groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))


@query("kee8_eligible", """
select asset_id from assets where asset_id not in (select asset_id from protected)
""", ("assets", "protected"))
def eligible(lib: Library) -> DataFrame:
    return keepers.eligible(lib.assets(), scan.protected(lib)).select("asset_id")


@query("kee9", "select group_id, asset_id, kept, effective_keeper from selected", ("selected",))
def selection(lib: Library) -> DataFrame:
    return scan.selected(lib).select("group_id", "asset_id", "kept", "effective_keeper")


@query("kee10", """
, g as (select tier, group_id, count_if(not kept)::bigint as discardable, sum(case when kept then 0 else byte_size end) as bytes from selected group by 1, 2),
n as (select case tier when 0 then 'identical' when 1 then 'copy' else 'moment' end as scope, * from g
 union all select 'copies total', * from g where tier < 2 union all select 'all', * from g)
select scope, count(*) as groups, sum(discardable)::bigint as discardable, sum(bytes)::bigint as reclaimable from n group by scope
""", ("selected",))
def tier_totals(lib: Library) -> DataFrame:
    return keepers.tier_summary(scan.selected(lib))


@query("kee11", """
select asset_id, group_id, byte_size, 'duplicate' as category from selected where tier = 0 and not kept and group_id % 5 <> 0
""", ("selected",))
def one_tap(lib: Library) -> DataFrame:
    rows = scan.selected(lib)
    unticked = rows.filter("group_id % 5 = 0").select("group_id").distinct()
    return keepers.one_tap_items(rows, unticked).drop("library_id")


@query("kee12", """
select asset_id, 'protected' as outcome from grouped where group_id % 4 = 0 union all
select asset_id, 'remaining' from grouped where group_id % 4 <> 0
""", ("grouped",))
def skipped(lib: Library) -> DataFrame:
    rows = scan.grouped(lib)
    remaining, newly = keepers.skip_groups(rows, rows.filter("group_id % 4 = 0").select("group_id").distinct())
    return newly.select("asset_id", F.lit("protected").alias("outcome")).union(remaining.select("asset_id", F.lit("remaining")))


@query("kee13", """
select group_id, asset_id, array_to_string(list_filter([
 case when sharpness >= bs - 0.001 and scored > 1 and ws < bs - 0.03 then 'sharpest' end,
 case when pixel_count = max_px and min_px < max_px then 'top resolution' end,
 case when pixel_count = max_px and byte_size = top_hi and top_lo < top_hi then 'best quality' end,
 case when creation_ts = newest and members > 1 then 'last shot' end, case when is_favorite then 'favorite' end],
 lambda x: x is not null)[1:2], ' · ') as badges
from (select *, max(sharpness) over g as bs, min(sharpness) over g as ws, count(sharpness) over g as scored, count(*) over g as members,
  max(case when pixel_count = max_px then byte_size end) over g as top_hi, min(case when pixel_count = max_px then byte_size end) over g as top_lo
 from grouped window g as (partition by group_id))
""", ("grouped",))
def badges(lib: Library) -> DataFrame:
    return keepers.quality_badges(scan.grouped(lib)).select("group_id", "asset_id", F.array_join("badges", " · ").alias("badges"))


@query("kee14", """
, s as (select group_id, tier, count(*) as n, min(pixel_count) as lo_px, max(pixel_count) as hi_px,
 arg_max(pixel_width || 'x' || pixel_height, (pixel_count, asset_id)) as hi, arg_min(pixel_width || 'x' || pixel_height, (pixel_count, asset_id)) as lo,
 max(case when byte_size > 0 then byte_size end)::double / min(case when byte_size > 0 then byte_size end) as ratio from grouped group by 1, 2),
l as (select *, list_filter([case when lo_px < hi_px then 'resolution differs: ' || hi || ' to ' || lo end,
 case when ratio > 1.6 then 'quality differs: largest file is ' || round(ratio)::bigint || ' times the smallest' end], lambda x: x is not null) as lines from s)
select group_id, case when tier = 0 then 'the same picture stored ' || n || ' times' when len(lines) = 0 then 'looks the same, details differ slightly'
 else 'versions of one picture; ' || array_to_string(lines, '; ') end as summary from l
""", ("grouped",))
def differences(lib: Library) -> DataFrame:
    return keepers.difference_summary(scan.grouped(lib)).drop("library_id")


@query("kee15", """
select m.group_id, count(m.dhash) = count(*) and count(distinct m.content_hash) = 1 as contents_match,
 array_to_string(list_sort(list(distinct m.pixel_width || 'x' || m.pixel_height)), ' / ') as dimensions,
 count(distinct m.byte_size) = 1 as sizes_match,
 max(case when m.asset_id <> m.effective_keeper then bit_count(xor(m.dhash, k.dhash))::int end) as max_dhash_distance,
 max(case when m.asset_id <> m.effective_keeper then bit_count(xor(m.phash, k.phash))::int end) as max_phash_distance
from selected m join selected k on k.group_id = m.group_id and k.asset_id = m.effective_keeper group by m.group_id
""", ("selected",))
def evidence(lib: Library) -> DataFrame:
    return keepers.safety_evidence(scan.selected(lib)).drop("library_id")


@query("kee16", """
select asset_id, byte_size as bytes, 'duplicate' as category from selected where group_id % 3 = 0 and not kept
""", ("selected",))
def marked(lib: Library) -> DataFrame:
    rows = scan.selected(lib)
    return keepers.mark_groups(rows, rows.filter("group_id % 3 = 0").select("group_id").distinct())[1].drop("library_id")
