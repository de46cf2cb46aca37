"""Queries: text layout and the rule classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions import fixed
from shoebox.operators import layout, rules
from shoebox.operators import triage as triage_job
from shoebox.plans import scan
from shoebox.plans.duck_views import VIEWS, view
from shoebox.plans.registry import query
from shoebox.sources.derived import Library

NOW = "2024-02-15 00:00:00"

view("lay_agg", r"""
select asset_id, count(*) as line_count, least(1.0::double, sum(w * h)) as text_area, avg(confidence) as mean_confidence,
 count_if(w < 0.45)::bigint::double / count(*) as short_share,
 sum(length(regexp_replace(text, '[^\p{N}]', '', 'g')))::double / sum(length(text)) as digit_share,
 case when count(*) >= 4 then least(1.0::double, least(count_if(x < 0.22)::bigint, count_if(x > 0.38)::bigint)::double / count(*) * 2.4) else 0 end as bimodality,
 case when count(*) >= 4 then count_if(x + w > 0.90)::bigint::double / count(*) else 0 end as right_hugging,
 case when count(*) >= 5 then least(1.0::double, stddev_pop(x + w / 2) / 0.29 * (stddev_pop(y + h / 2) / 0.29)) else 0 end as scatter,
 bool_or(y > 0.955) as has_top_bar, bool_or(y + h < 0.075) as has_bottom_bar,
 bool_or(y + h > 0.955 and x < 0.38 and regexp_full_match(regexp_replace(upper(replace(trim(text), '：', ':')), ' [AP]M', '', 'g'), '([0-9]|[01][0-9]|2[0-3]):[0-5][0-9]')) as has_clock
from ocr_lines group by asset_id
""", ("ocr_lines",))
view("lay_median", "select asset_id, list_sort(list(h))[count(*) // 2 + 1] as median_height from ocr_lines group by asset_id", ("ocr_lines",))
view("lay_gap", """
select asset_id, case when count(*) >= 4 and avg(gap) > 0 then greatest(0.0::double, 1 - least(1.0::double, stddev_pop(gap) / avg(gap))) else 0 end as gap_regularity
from (select asset_id, y + h / 2 - lag(y + h / 2) over (partition by asset_id order by y + h / 2, line_no) as gap from ocr_lines) group by asset_id
""", ("ocr_lines",))
view("lay_paired", """
select asset_id, case when count(*) >= 4 then count_if(paired)::bigint::double / count(*) else 0 end as paired_rows from
 (select a.asset_id, exists (select 1 from ocr_lines b where b.asset_id = a.asset_id and b.line_no <> a.line_no
    and abs((a.y + a.h / 2) - (b.y + b.h / 2)) / greatest(0.004::double, m.median_height * 0.45) < 1 - 1e-9 and b.x - (a.x + a.w) > 0.02) as paired
  from ocr_lines a join lay_median m using (asset_id)) group by asset_id
""", ("ocr_lines", "lay_median"))
view("lay_chains", """
select asset_id, chain, count(*) as n, avg(x) as centre from
 (select *, sum(case when x - px > 0.06 or px is null then 1 else 0 end) over (partition by asset_id order by x, line_no rows unbounded preceding) as chain from
  (select *, lag(x) over (partition by asset_id order by x, line_no) as px from ocr_lines)) group by asset_id, chain
""", ("ocr_lines",))
view("lay_columns", """
select asset_id, case when sum(n) >= 4 then count_if(n >= 2)::bigint else 0 end as column_count,
 coalesce(sum(n) >= 4 and count_if(n >= 2)::bigint >= 3 and avg(gap) > 0 and stddev_pop(gap) / avg(gap) < 0.35, false) as columns_even from
 (select *, case when n >= 2 then centre - lag(centre) over (partition by asset_id, n >= 2 order by centre) end as gap from lay_chains) group by asset_id
""", ("lay_chains",))
view("layout", """
select * from lay_agg join lay_median using (asset_id) join lay_gap using (asset_id) join lay_paired using (asset_id) join lay_columns using (asset_id)
""", ("lay_agg", "lay_median", "lay_gap", "lay_paired", "lay_columns"))

SIX = ("text_area", "mean_confidence", "short_share", "digit_share", "bimodality", "right_hugging", "scatter", "median_height", "gap_regularity", "paired_rows")


def _duck(names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" if n in SIX else n for n in names.split())


def _spark(df: DataFrame, names: str) -> DataFrame:
    return df.select(*[F.round(n, 6).alias(n) if n in SIX else F.col(n) for n in names.split()])


def _register(name: str, columns: str, source: str) -> None:
    @query(name, f"select {_duck('asset_id ' + columns)} from {source}", (source,))
    def run(lib: Library) -> DataFrame:
        summed = source == "lay_agg"
        return _spark(layout.aggregates(lib.text_lines()) if summed else layout.features(lib.ocr_lines()), "asset_id " + columns)


_register("lay1", "line_count text_area mean_confidence short_share", "lay_agg")
_register("lay2", "median_height", "lay_median")
_register("lay3", "digit_share", "lay_agg")
_register("lay4", "bimodality", "lay_agg")
_register("lay5", "gap_regularity", "lay_gap")
_register("lay7", "right_hugging", "lay_agg")
_register("lay8", "scatter", "lay_agg")
_register("lay9", "column_count", "lay_columns")
_register("lay10", "columns_even", "lay_columns")
_register("lay11", "has_top_bar has_bottom_bar", "lay_agg")
_register("lay12", "has_clock", "lay_agg")


_register("lay6", "paired_rows", "lay_paired")


# every tenth asset was never analysed, so it has no layout
view("analysed", """
select s.*, f.sharpness, f.saturation, f.flatness, f.edge_density, f.brightness, s.pixel_width::double / s.pixel_height as aspect,
 case when s.asset_id % 5 = 0 then ['receipt', 'sky'] when s.asset_id % 5 = 1 then ['toy'] else [] end as labels,
 l.* exclude (asset_id), 1 - least(1.0::double, l.paired_rows * 1.5) as nt, coalesce(f.edge_density, 0) as edge, coalesce(f.saturation, 0) as sat,
 coalesce(f.flatness, 0) as flat, coalesce(l.line_count >= 4 and l.text_area > 0.015, false) or coalesce(l.has_clock, false) as has_text,
 coalesce(l.line_count >= 8 and l.text_area > 0.04, false) as heavy,
 case when (least(s.pixel_width, s.pixel_height), greatest(s.pixel_width, s.pixel_height)) in (PHONES) then 'phone'
      when (least(s.pixel_width, s.pixel_height), greatest(s.pixel_width, s.pixel_height)) in (OTHERS) then 'ambiguous' else 'none' end as device_match
from (select * replace (case when asset_id % 9 = 2 then 2048 else pixel_width end as pixel_width, case when asset_id % 9 = 2 then 1536 else pixel_height end as pixel_height,
        case when asset_id % 9 = 2 then 2048::bigint * 1536 else pixel_count end as pixel_count) from screens) s
left join fingerprints f using (asset_id) left join (select * from layout where asset_id % 10 <> 9) l using (asset_id)
""".replace("PHONES", ", ".join(map(str, fixed.PHONE_SCREENS))).replace("OTHERS", ", ".join(map(str, fixed.AMBIGUOUS_SCREENS))), ("screens", "fingerprints", "layout"))

view("rule_scores", """
select *, is_screenshot or device_match = 'phone' or amb or crop as looks, busy, settings, home,
 bimodality * least(1.0::double, right_hugging * 2.5) * 1.9 * nt + bimodality * 0.25 * nt + short_share * 0.5 + if(has_clock, 0.22, 0) + if(line_count >= 8, 0.35, 0)
  + if(has_top_bar and has_bottom_bar, 0.45, 0) + if(flatness > 0.55, 0.35, 0) + if(saturation < 0.22, 0.25, 0) as chat,
 sat * 1.3 + edge * 0.9 + if(flatness < 0.28, 0.4, 0) + if(has_clock, -0.85, if(aspect > 1.2, 0.35, 0)) + if(busy, 0.5, if(text_area < 0.06, 0.2, 0)) + if(aspect > 1.2, 0.45, 0)
  + if(list_has_any(labels, GAMES), 0.3, 0) as game,
 paired_rows * 1.1 + if(digits_ok, digit_share * 1.5, 0) + if(text_area > 0.06, gap_regularity * 0.6, 0) + if(text_area > 0.06 and nt < 0.5, 0.5, 0)
  + if(brightness > 0.75 and saturation < 0.15 and digit_share > 0.15, 0.4, 0) + if(list_has_any(labels, DOCS), 0.45, 0) + if(has_clock, 0.18, 0) as doc,
 if(line_count >= 12 and short_share < 0.5, 0.7, 0) + if(text_area > 0.14 and bimodality < 0.25, 0.5, 0) + if(has_top_bar and not has_bottom_bar, 0.25, 0)
  + if(flatness > 0.5 and saturation < 0.3, 0.2, 0) as web,
 if(settings, 0.85 + if(text_area < 0.06, 0.35, 0) + if(flatness > 0.55 and saturation < 0.18, 0.45, 0) + if(paired_rows < 0.25, 0.20, 0), 0)
  + if(home, 1.05 + if(paired_rows > 0.5, 0.40, 0), 0) as sys
from (select *, device_match = 'ambiguous' and (flat > 0.35 or has_text) as amb,
  device_match = 'none' and pixel_count < 4000000 and heavy and flat > 0.40 and not has_location as crop,
  text_area < 0.03 and edge > 0.25 as busy, line_count >= 6 and text_area > 0.012 as digits_ok,
  has_clock and column_count <= 1 and gap_regularity > 0.55 and line_count >= 6 as settings,
  has_clock and column_count >= 3 and columns_even and short_share > 0.7 as home from analysed)
""".replace("GAMES", str(list(fixed.GAME_LABELS))).replace("DOCS", str(list(fixed.DOCUMENT_LABELS))), ("analysed",))

view("classified", """
select *, case stage when 'recording' then 'screenRecording' when 'video' then 'largeVideo' when 'blurry' then 'blurry' when 'scored' then best.name else 'screenshot' end as category,
 case stage when 'recording' then 0.95 when 'video' then 0.5 when 'blurry' then 0.55 + (0.16 - sharpness) when 'photo' then 0 when 'unseen' then 0.45 when 'unclear' then 0.5
  else greatest(0.4::double, case when best.score + second.score <= 0 then 0.4 else least(0.97::double, best.score / (best.score + second.score)) end) end as confidence,
 case stage when 'recording' then 'screen recording' when 'video' then 'video' when 'blurry' then 'out of focus, little detail' when 'photo' then ''
  else array_to_string(list_filter([case when is_screenshot then 'flagged as a screenshot' end, case when not is_screenshot and device_match = 'phone' then 'exact phone screen size' end,
   case when not is_screenshot and amb then 'screen size with interface elements' end, case when not is_screenshot and crop then 'small, flat and full of text: a cropped screenshot' end,
   case when has_top_bar and has_bottom_bar then 'top bar and input field' end, case when bimodality > 0.45 and nt > 0.6 then 'bubbles on both sides' end,
   case when has_clock then 'status bar clock: an app, not a full-screen game' end, case when not has_clock and aspect > 1.2 then 'landscape without status bar: like a full-screen game' end,
   case when busy then 'busy picture, almost no text' end, case when line_count is not null and aspect > 1.2 then 'landscape capture' end,
   case when digits_ok and digit_share > 0.22 then 'dense digits: maybe a receipt or ticket' end, case when paired_rows > 0.4 then 'field and value in two columns' end,
   case when settings then 'one column of even rows under a status bar' end, case when home then 'labels on a regular grid: like a home screen' end], lambda x: x is not null), '; ') end as reasons
from (select *, case when is_screen_recording then 'recording' when is_video then 'video' when not is_screenshot and sharpness < 0.16 and edge_density < 0.12 then 'blurry'
  when not looks then 'photo' when line_count is null then 'unseen' when best.score < 0.55 then 'unclear' else 'scored' end as stage
 from (select *, ranked[1] as best, ranked[2] as second from (select *, list_reverse_sort([{'score': chat::double, 'name': 'chatScreenshot'}, {'score': game::double, 'name': 'gameScreenshot'},
   {'score': doc::double, 'name': 'documentShot'}, {'score': web::double, 'name': 'webShot'}, {'score': sys::double, 'name': 'systemScreenshot'},
   {'score': 0::double, 'name': 'mapScreenshot'}, {'score': 0.20::double, 'name': 'screenshot'}]) as ranked from rule_scores)))
""", ("rule_scores",))


def analysed(lib: Library) -> DataFrame:
    """Classifier inputs: a few assets get tablet dimensions, and every tenth has no layout."""
    d = F.col("asset_id")
    assets = lib.assets().withColumns({
        "pixel_width": F.when(d % 9 == 2, 2048).otherwise(F.col("pixel_width")),
        "pixel_height": F.when(d % 9 == 2, 1536).otherwise(F.col("pixel_height")),
    })
    seen = lib.keep("layout", lambda: layout.features(lib.ocr_lines())).filter(d % 10 != 9)
    names = F.when(d % 5 == 0, F.array(F.lit("receipt"), F.lit("sky"))).when(d % 5 == 1, F.array(F.lit("toy"))).otherwise(F.array().cast("array<string>"))
    return rules.inputs(assets, lib.fingerprints(), seen, assets.select("asset_id", names.alias("labels")))


def classified(lib: Library) -> DataFrame:
    return lib.keep("classified", lambda: rules.classify(analysed(lib)))


@query("layout", f"select {_duck('asset_id line_count text_area median_height digit_share bimodality gap_regularity paired_rows right_hugging scatter column_count columns_even has_clock')} from layout", ("layout",))
def all_features(lib: Library) -> DataFrame:
    names = "asset_id line_count text_area median_height digit_share bimodality gap_regularity paired_rows right_hugging scatter column_count columns_even has_clock"
    return _spark(layout.features(lib.ocr_lines()), names)


@query("cls1", """
select asset_id, category, round(confidence, 6) as confidence from classified where stage in ('recording', 'video', 'blurry')
""", ("classified",))
def early(lib: Library) -> DataFrame:
    early_exit = F.col("category").isin("screenRecording", "largeVideo", "blurry")
    return classified(lib).filter(early_exit).select("asset_id", "category", F.round("confidence", 6).alias("confidence"))


@query("cls2", "select asset_id, looks as looks_like_screen from rule_scores", ("rule_scores",))
def gate(lib: Library) -> DataFrame:
    return analysed(lib).select("asset_id", rules.looks_like_screen().alias("looks_like_screen"))


@query("cls3", "select asset_id, category, round(confidence, 6) as confidence from classified where line_count is null", ("classified",))
def unseen(lib: Library) -> DataFrame:
    return classified(lib).filter("line_count is null").select("asset_id", "category", F.round("confidence", 6).alias("confidence"))


def _register_score(name: str, column: str, make) -> None:
    @query(name, f"select asset_id, round(({column})::double, 6) as score from rule_scores where line_count is not null", ("rule_scores",))
    def run(lib: Library) -> DataFrame:
        return analysed(lib).filter("line_count is not null").select("asset_id", F.round(make(), 6).alias("score"))


_register_score("cls4", "chat", rules.chat_score)
_register_score("cls5", "game", rules.game_score)
_register_score("cls6", "doc", rules.document_score)
_register_score("cls7", "web", rules.web_score)
_register_score("cls8", "sys", rules.system_score)
_register_score("cls9", "0::double", rules.SCORES["mapScreenshot"])


@query("cls10", "select asset_id, category, round(confidence, 6) as confidence from classified", ("classified",))
def verdict(lib: Library) -> DataFrame:
    return classified(lib).select("asset_id", "category", F.round("confidence", 6).alias("confidence"))


@query("cls11", "select asset_id, reasons from classified", ("classified",))
def reasons(lib: Library) -> DataFrame:
    return classified(lib).select("asset_id", F.array_join("reasons", "; ").alias("reasons"))


@query("cls12", """
select asset_id from screens where asset_id not in (select asset_id from protected) and asset_id not in (select asset_id from grouped where not is_keeper)
 and not is_favorite and asset_id % 17 <> 5 and creation_ts <= timestamp '2024-02-15 00:00:00' - interval 3 day
 and (is_screen_recording or not (is_video or is_panorama or is_portrait))
""", ("screens", "protected", "grouped"))
def triage(lib: Library) -> DataFrame:
    assets = lib.assets().withColumn("has_adjustments", F.col("asset_id") % 17 == 5)
    queued = scan.grouped(lib).filter(~F.col("is_keeper"))
    return rules.eligible_for_triage(assets, scan.protected(lib), queued, NOW).select("asset_id")


@query("cls13", "select asset_id, category from classified where confidence >= 0.35 and category <> 'documentShot'", ("classified",))
def proposed(lib: Library) -> DataFrame:
    return rules.candidates(classified(lib)).select("asset_id", "category")


# the whole scan: what was protected takes no part from the start
view("all_assets", VIEWS["assets"][1])
ELIGIBLE = {"assets": (("all_assets", "protected"), "select * from all_assets where asset_id not in (select asset_id from protected)")}
SHOWN = """
, offers as (select group_id from grouped group by group_id having bool_or(not is_keeper and not is_favorite)),
shown as (select g.* from grouped g join offers using (group_id)),
exact as (select l_orderkey as asset_id, sum(floor(l_extendedprice)::bigint)::bigint as bytes from lineitem group by l_orderkey having sum(floor(l_extendedprice)) > 0)
"""


def resources(lib: Library) -> DataFrame:
    return lib.table("lineitem").select(F.col("l_orderkey").alias("asset_id"), F.floor("l_extendedprice").cast("bigint").alias("bytes"))


def scan_groups(lib: Library) -> DataFrame:
    return lib.keep("whole-scan", lambda: triage_job.find_groups(lib.assets(), lib.fingerprints(), scan.protected(lib), resources(lib)))


@query("scan_groups", SHOWN + """
select group_id, tier, asset_id, is_keeper, coalesce(bytes, byte_size)::bigint as byte_size from shown left join exact using (asset_id)
""", ("grouped",), ELIGIBLE)
def whole_scan_groups(lib: Library) -> DataFrame:
    return scan_groups(lib).select("group_id", "tier", "asset_id", "is_keeper", "byte_size")


@query("scan_candidates", SHOWN + """
, targets as (select asset_id, byte_size from screens where asset_id not in (select asset_id from shown where not is_keeper)
 and not is_favorite and asset_id % 17 <> 5 and creation_ts <= timestamp '2024-02-15 00:00:00' - interval 3 day and (is_screen_recording or not (is_video or is_panorama or is_portrait)))
select t.asset_id, c.category, round(c.confidence, 6) as confidence, c.reasons, coalesce(bytes, t.byte_size)::bigint as byte_size
from targets t join classified c using (asset_id) left join exact using (asset_id) where c.confidence >= 0.35 and c.category <> 'documentShot'
""", ("grouped", "screens", "classified"), ELIGIBLE)
def whole_scan_candidates(lib: Library) -> DataFrame:
    assets = lib.assets().withColumn("has_adjustments", F.col("asset_id") % 17 == 5)
    found = triage_job.find_candidates(analysed(lib), assets, scan_groups(lib), scan.protected(lib), NOW, resources(lib))
    return found.select("asset_id", "category", F.round("confidence", 6).alias("confidence"), F.array_join("reasons", "; ").alias("reasons"), "byte_size")
