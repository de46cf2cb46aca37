"""DuckDB SQL of the derived tables: the other half of ``sources/derived.py``.

``with_views(sql, names)`` puts the named views, and those they need, in front of a query.
"""

from __future__ import annotations


def _bits(quarter: str, out: str) -> str:
    terms = " + ".join(f"(case when s{quarter}{i} > 0 then {1 << i} else 0 end)" for i in range(32))
    return f"cast({terms} as bigint) as {out}"


def _sums(quarter: str) -> str:
    return ", ".join(
        f"sum(case when ({quarter} & {1 << i}) <> 0 then 1 else -1 end) as s{quarter}{i}" for i in range(32)
    )


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    VIEWS[name] = (needs, sql)


view("assets", """
select cast(0 as bigint) as library_id, d as asset_id,
 timestamp '2024-01-01 00:00:00' + to_seconds(cast((d // 20)*100000 + case (d // 20)%6 when 0 then (d%20)*2 when 1 then ((d%20) // 8)*1000 when 2 then (d%20)*60 when 3 then ((d%20) // 4)*300+((d%20)%4)*3 when 4 then (d%20)*3600 else (case when d%20<14 then (d%20)*5 else (d%20)*3600 end) end as int)) as creation_ts,
 cast(case d%4 when 0 then 4032 when 1 then 3024 when 2 then 1512 else 1179 end as int) as pixel_width,
 cast(case d%4 when 0 then 3024 when 1 then 4032 when 2 then 2016 else 2556 end as int) as pixel_height,
 n_chars*10 as byte_size, d%97=0 as is_favorite, d%3=0 as has_location, n_chars%13=0 as is_video,
 cast((n_chars%5)*1.25 as double) as duration,
 case when (d // 20)%6=2 then concat('b',cast(d // 20 as varchar)) end as burst_id,
 cast(case when d%11=0 then 4 when d%7=0 then 8 when d%17=0 then 16 when d%19=0 then 1 else 0 end as int) as subtypes,
 case when d%26=0 then concat('RPReplay_',cast(d as varchar)) else concat('IMG_',cast(d as varchar)) end as filename,
 md5(text) as content_hash, source
from (select doc_id as d, text, n_chars, source from documents)
""")

view("word_bits", f"""
select doc_id, {_sums('h1')}, {_sums('h2')}, {_sums('h3')}, {_sums('h4')}
from (select doc_id, cast(('0x'||substr(m,1,8)) as bigint) h1, cast(('0x'||substr(m,9,8)) as bigint) h2,
             cast(('0x'||substr(m,17,8)) as bigint) h3, cast(('0x'||substr(m,25,8)) as bigint) h4
      from (select doc_id, md5(word) m
            from (select doc_id, unnest(string_split(text,' ')) as word from documents) where word <> ''))
group by doc_id
""")

view("fingerprints", f"""
select doc_id as asset_id,
 cast((case when a>=2147483648 then a-4294967296 else a end)*4294967296+b as bigint) as dhash,
 cast((case when c>=2147483648 then c-4294967296 else c end)*4294967296+d as bigint) as phash,
 cast((doc_id%100)/100.0 as double) as sharpness, cast((doc_id%10)/10.0 as double) as flatness,
 cast((doc_id%7)/10.0 as double) as saturation, cast((doc_id%9)/10.0 as double) as edge_density,
 cast((doc_id%11)/10.0 as double) as brightness, 8 as version
from (select doc_id, {_bits('h1', 'a')}, {_bits('h2', 'b')}, {_bits('h3', 'c')}, {_bits('h4', 'd')} from word_bits)
""", ("word_bits",))

view("ocr_lines", """
select l_orderkey as asset_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as line_no,
 cast((l_partkey%100)/100.0 as double) as x, cast(((l_suppkey*7+l_linenumber*13)%100)/100.0 as double) as y,
 least(0.9, l_quantity/100.0) as w, 0.01+l_tax/4 as h,
 case when l_linenumber=1 then '9:41' else concat(l_returnflag, cast(l_partkey as varchar), l_linestatus) end as text,
 1-l_discount as confidence from lineitem
""")

view("decisions", """
select event_id, ts, user_id as library_id, event_id % (select greatest(1, count(*) * 2 // 5) from documents) as asset_id,
 case event_type when 'click' then 'delete' when 'view' then 'keepOnce' when 'purchase' then 'whitelist' when 'signup' then 'undo' else 'relabel' end as action,
 cast(floor(value*10000) as bigint) as bytes from events
""")

view("deletion_items", """
select event_id, cast(ts as date) as run_date, user_id as library_id,
 case event_id%5 when 0 then 'duplicate' when 1 then 'chatScreenshot' when 2 then 'gameScreenshot' when 3 then 'screenshot' else 'blurry' end as category,
 cast(floor(value*10000) as bigint) as bytes from events where event_type='purchase'
""")

view("readings", """
select cast(0 as bigint) as library_id, o_orderkey as reading_id, o_orderdate as ts, o_orderkey%50000+1 as asset_count,
 cast(floor(o_totalprice*100) as bigint) as bytes from orders
""")

view("vectors", """
select cast(0 as bigint) as library_id, vec_id, embedding, 2 as revision, concat('app',cast(label as varchar)) as app, label,
 vec_id%50=0 as is_centroid from embeddings
""")

view("candidates", """
select cast(0 as bigint) as library_id, doc_id as asset_id, case doc_id%6 when 0 then 'chatScreenshot' when 1 then 'gameScreenshot' when 2 then 'documentShot' when 3 then 'webShot' when 4 then 'blurry' else 'screenshot' end as category,
 cast((doc_id%100)/100.0 as double) as confidence, n_chars*10 as byte_size from documents
""")


def with_views(sql: str, names: tuple[str, ...], instead: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """``instead`` puts other SQL in the place of views, for this query only."""
    ordered: list[str] = []
    views = VIEWS | (instead or {})

    def add(name: str) -> None:
        if name in ordered:
            return
        needs, _ = views[name]
        for n in needs:
            add(n)
        ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return sql
    parts = ",\n".join(f"{n} as ({views[n][1].strip()})" for n in ordered)
    return f"with recursive {parts}\n{sql.strip()}"


# --- grouping, step by step -------------------------------------------------------------------

view("screens", """
select *, pixel_width::bigint * pixel_height as pixel_count, (subtypes & 4) <> 0 as is_screenshot, (subtypes & 8) <> 0 as is_live,
 (subtypes & 16) <> 0 as is_portrait, (subtypes & 1) <> 0 as is_panorama,
 (is_video and (upper(filename) like 'RPREPLAY%' or upper(filename) like '%SCREENRECORD%' or filename like '%屏幕录制%')) as is_screen_recording,
 ((subtypes & 4) <> 0 or (greatest(pixel_width, pixel_height)::double / least(pixel_width, pixel_height) > 1.9
   and greatest(pixel_width, pixel_height)::double / least(pixel_width, pixel_height) < 2.3)) as is_screen_like
from assets
""", ("assets",))

view("images", """
select s.*, f.dhash, f.phash, f.sharpness from screens s join fingerprints f using (asset_id) where not s.is_video
""", ("screens", "fingerprints"))

view("copy_pairs", """
select * from (
 select a.asset_id as a, b.asset_id as b, bit_count(xor(a.dhash, b.dhash))::int as d, bit_count(xor(a.phash, b.phash))::int as p,
  case when a.content_hash = b.content_hash and a.pixel_width = b.pixel_width and a.pixel_height = b.pixel_height then 0
       when not a.is_screen_like and not b.is_screen_like
        and a.pixel_width::bigint * b.pixel_height = b.pixel_width::bigint * a.pixel_height
        and bit_count(xor(a.dhash, b.dhash)) <= 2 and bit_count(xor(a.phash, b.phash)) <= 4 then 1 end as tier
 from images a join images b on a.asset_id < b.asset_id) where tier is not null
""", ("images",))

view("copy_reach", """
select a as id, a as root from copy_pairs union select b, b from copy_pairs
union
select e.b, r.root from copy_reach r join (select a, b from copy_pairs union all select b, a from copy_pairs) e on r.id = e.a
""", ("copy_pairs",))

view("copy_groups", """
select l.label as group_key, max(p.tier)::int as tier from (select id, min(root) as label from copy_reach group by id) l
join copy_pairs p on p.a = l.id group by l.label
""", ("copy_reach", "copy_pairs"))

view("copy_members", """
select l.label as group_key, g.tier, l.id as asset_id from (select id, min(root) as label from copy_reach group by id) l
join copy_groups g on g.group_key = l.label
""", ("copy_reach", "copy_groups"))

view("photo_runs", """
select *, sum(case when keep then 0 else 1 end) over (order by creation_ts, asset_id rows unbounded preceding)::bigint as run from (
 select *, coalesce(epoch_us(creation_ts) - epoch_us(lag(creation_ts) over o) <= 10000000, false)
   or coalesce(burst_id = lag(burst_id) over o, false) as keep
 from images where not is_screen_like and asset_id not in (select asset_id from copy_members)
 window o as (order by creation_ts, asset_id))
""", ("images", "copy_members"))

view("run_verdicts", """
select run, members, first_id, same_stamp, span_seconds,
 case when bursts = members and n_bursts = 1 then 'vouched' when span_seconds > 60 then 'span' when members > 12 then 'size'
      when members >= 3 and same_stamp::double / members > 0.6 then 'batch' else 'ok' end as verdict
from (select run, count(*) as members, count(burst_id) as bursts, count(distinct burst_id) as n_bursts, min(asset_id) as first_id,
        (epoch_us(max(creation_ts)) - epoch_us(min(creation_ts))) / 1e6 as span_seconds from photo_runs group by run having count(*) > 1)
join (select run, max(n) as same_stamp from (select run, creation_ts, count(*) as n from photo_runs group by run, creation_ts) group by run) using (run)
""", ("photo_runs",))

view("moment_pairs", """
select a.asset_id as a, b.asset_id as b from photo_runs a join photo_runs b on a.run = b.run and a.asset_id < b.asset_id
join run_verdicts v on v.run = a.run
where v.verdict in ('vouched', 'ok') and (coalesce(a.burst_id = b.burst_id, false)
 or (bit_count(xor(a.phash, b.phash)) <= 12 and bit_count(xor(a.dhash, b.dhash)) <= 12))
""", ("photo_runs", "run_verdicts"))

view("moment_reach", """
select a as id, a as root from moment_pairs union select b, b from moment_pairs
union
select e.b, r.root from moment_reach r join (select a, b from moment_pairs union all select b, a from moment_pairs) e on r.id = e.a
""", ("moment_pairs",))

view("moment_members", """
select min(root) as group_key, 2 as tier, id as asset_id from moment_reach group by id
""", ("moment_reach",))

view("video_members", """
select min(asset_id) over w as group_key, 0 as tier, asset_id from assets where is_video and byte_size > 0
window w as (partition by byte_size, trunc(duration * 10), pixel_width, pixel_height) qualify count(*) over w > 1
""", ("assets",))

view("members", """
select * from copy_members union all select * from moment_members union all select * from video_members
""", ("copy_members", "moment_members", "video_members"))

view("scored", """
select *,
 case when is_favorite then 1000 else 0 end + case when is_live then 60 else 0 end + case when is_portrait then 50 else 0 end
 + case when has_location then 25 else 0 end + case when is_screenshot then 0 else 15 end
 + coalesce(px * 120, 0) + coalesce(size_ratio * 60, 0) + coalesce(sharpness * 70, 0) + coalesce(recent * 40, 0) as score,
 list_filter([case when is_favorite then 'favorite' end, case when is_live then 'live photo' end, case when is_portrait then 'portrait depth' end,
  case when has_location then 'has location' end, case when px >= 0.999 and min_px < max_px then 'top resolution' end,
  case when size_ratio >= 0.999 and min_bytes < max_bytes then 'least quality loss' end,
  case when sharpness > 0.6 then 'sharpest' end, case when recent >= 0.999 then 'newest' end], lambda x: x is not null) as notes
from (select *, pixel_count::double / nullif(max_px, 0) as px, byte_size::double / nullif(max_bytes, 0) as size_ratio,
  case when tier = 2 and newest > oldest then (epoch_us(creation_ts) - epoch_us(oldest))::double / (epoch_us(newest) - epoch_us(oldest)) end as recent
 from (select m.group_key, m.tier, s.*, f.sharpness, f.dhash, f.phash,
   max(pixel_count) over g as max_px, min(pixel_count) over g as min_px, max(byte_size) over g as max_bytes, min(byte_size) over g as min_bytes,
   max(creation_ts) over g as newest, min(creation_ts) over g as oldest
  from members m join screens s using (asset_id) left join fingerprints f using (asset_id) window g as (partition by m.group_key)))
""", ("members", "screens", "fingerprints"))

view("grouped", """
select *, first_value(asset_id) over k as group_id, asset_id = first_value(asset_id) over k as is_keeper,
 case when len(notes) > 0 then array_to_string(notes[1:2], ' · ') else 'best overall score' end as reason
from scored window k as (partition by group_key order by round(score, 9) desc, asset_id)
""", ("scored",))

# decisions, with undo
view("undo_steps", """
select *, s - least(low, 0) as after_depth, coalesce(lag(low) over (partition by library_id order by ts, event_id), 0) as low_before from
 (select *, min(s) over (partition by library_id order by ts, event_id rows unbounded preceding) as low from
  (select *, sum(case when action = 'undo' then -1 else 1 end) over (partition by library_id order by ts, event_id rows unbounded preceding) as s
   from decisions where action <> 'relabel'))
""", ("decisions",))
view("resolved", """
select library_id, event_id, asset_id, ts, action, bytes, coalesce(nxt = 'undo', false) as undone, case when nxt = 'undo' then nxt_ts end as undone_at, case when nxt = 'undo' then nxt_id end as undo_event_id from
 (select *, lead(action) over l as nxt, lead(ts) over l as nxt_ts, lead(event_id) over l as nxt_id from
  (select *, case when action = 'undo' then after_depth + 1 else after_depth end as level from undo_steps where not (action = 'undo' and low < least(low_before, 0)))
  window l as (partition by library_id, level order by ts, event_id))
where action <> 'undo'
""", ("undo_steps",))
view("states", """
select library_id, asset_id, coalesce(mark.marks, false) as pending, coalesce(protects, false) as protected,
 case when mark.marks then mark.at_ts end as marked_at, case when mark.marks then mark.bytes end as bytes from
 (select library_id, asset_id, arg_max({'marks': marks, 'at_ts': at_ts, 'bytes': bytes}, (at_ts, seq)) filter (where marks is not null) as mark,
   arg_max(protects, (at_ts, seq)) filter (where protects is not null) as protects from
  (select library_id, asset_id, bytes, ts as at_ts, event_id as seq, action = 'delete' as marks, case when action = 'whitelist' then true end as protects from resolved
   union all select library_id, asset_id, bytes, undone_at, undo_event_id, case when action = 'delete' then false end, case when action = 'whitelist' then false end
   from resolved where undone and action <> 'keepOnce')
  group by library_id, asset_id)
""", ("resolved",))
view("pending", "select library_id, asset_id, marked_at, bytes from states where pending", ("states",))
view("pending_ids", "select distinct asset_id from pending", ("pending",))
view("protected", "select distinct asset_id from states where protected", ("states",))

# the user's picks in these checks: in groups with an even id, members with id % 3 = 1 are kept
view("selected", """
select *, first_value(asset_id) over (partition by group_id order by kept desc, is_keeper desc, creation_ts desc, asset_id) as effective_keeper from
 (select *, case when touched then asset_id % 3 = 1 else is_keeper end as kept from
  (select *, group_id % 2 = 0 and bool_or(asset_id % 3 = 1) over (partition by group_id) as touched from grouped))
""", ("grouped",))
