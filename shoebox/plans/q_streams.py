"""Queries: streaming jobs, each driven over the given tables to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions import fixed
from shoebox.operators import copies, moments, settings
from shoebox.plans import q_queue, scan
from shoebox.plans.registry import query
from shoebox.session import fresh_path
from shoebox.sources import catalog, derived
from shoebox.sources.derived import Library
from shoebox.streaming import jobs, metrics


def _run(lib: Library, stream: DataFrame, name: str) -> DataFrame:
    path = fresh_path(lib.spark, f"{name}-sink")
    jobs.run_to_end(stream, path, fresh_path(lib.spark, f"{name}-state"))
    return lib.spark.read.schema(stream.schema).parquet(path)


def _stream(lib: Library, name: str) -> DataFrame:
    return jobs.read_table(lib.spark, lib.folder, name)


def _decisions(lib: Library) -> DataFrame:
    return lib.spark.sql(derived.DECISIONS, events=_stream(lib, "events"), modulus=lib.decided_assets())


@query("str1", "select distinct library_id, asset_id from decisions where action in ('delete', 'keepOnce', 'whitelist')", ("decisions",))
def candidates(lib: Library) -> DataFrame:
    arrivals = _decisions(lib).filter(F.col("action").isin("delete", "keepOnce", "whitelist")).select("library_id", "asset_id", "ts")
    return _run(lib, jobs.first_candidates(arrivals, "60 days"), "candidates").select("library_id", "asset_id")


def _library_candidates(lib: Library) -> DataFrame:
    """Candidates dealt to twenty libraries, with the asset's vector where it has one."""
    vectors = lib.vectors().select(F.col("vec_id").alias("asset_id"), "embedding")
    return lib.candidates().withColumn("library_id", F.col("asset_id") % 20).join(vectors, "asset_id", "left")


@query("str2", """
, twenty as (select asset_id % 20 as library_id, asset_id, category, confidence, byte_size, e.embedding::double[] as x from candidates left join embeddings e on e.vec_id = asset_id),
scored as (select t.*, case when w is not null and x is not null then 1 / (1 + exp(-(list_dot_product(w, x) + b))) end as score,
  coalesce(case when pos >= 8 and neg >= 8 then least(0.6::double, (pos + neg) / 250.0::double) end, 0) as power
 from twenty t left join twenty_models m using (library_id) where t.library_id in (select library_id % 20 from decisions))
select library_id, asset_id, category, round(if(power > 0 and score is not null, confidence * (1 - power) + score * power, confidence) * (0.55 + log2(greatest(byte_size, 65536) / 65536.0::double) / 10), 6) as priority
from scored
""", ("candidates", "decisions", "twenty_models"))
def reranked(lib: Library) -> DataFrame:
    """Swipes teach one stream; a second stream ranks the libraries that decisions touch with the weights in the first one's checkpoint."""
    path, learned = fresh_path(lib.spark, "ranked-sink"), fresh_path(lib.spark, "taught-state")
    vectors = lib.vectors().select(F.col("vec_id").alias("asset_id"), "embedding")
    twenty = _decisions(lib).withColumn("library_id", F.col("library_id") % 20)
    jobs.run_to_end(jobs.online_model(_swipes(twenty, vectors)), fresh_path(lib.spark, "taught-sink"), learned)
    jobs.rerank_on_change(twenty, _library_candidates(lib), lambda: jobs.learned_models(lib.spark, learned), path, fresh_path(lib.spark, "ranked-state"))
    return jobs.current_ranks(lib.spark, path).select("library_id", "asset_id", "category", F.round("priority", 6).alias("priority"))


def _swipes(decisions: DataFrame, vectors: DataFrame) -> DataFrame:
    made = decisions.filter(F.col("action").isin("delete", "keepOnce", "whitelist"))
    examples = made.withColumn("target", (F.col("action") == "delete").cast("int")).join(vectors, "asset_id")
    return examples.select("library_id", "event_id", "ts", "embedding", "target")


@query("str3", """
select library_id, event_id, round(score, 6) as score, pos as positives, neg as negatives, round(sqrt(list_dot_product(w, w)), 6) as weight_norm, 0::bigint as late
from swipe_fold where k > 0
""", ("swipe_fold",))
def online(lib: Library) -> DataFrame:
    """Each swipe's score before it was learned; the last row of a library holds the batch fold's counts."""
    vectors = lib.vectors().select(F.col("vec_id").alias("asset_id"), "embedding")
    out = _run(lib, jobs.online_model(_swipes(_decisions(lib), vectors)), "online")
    return out.select("library_id", "event_id", F.round("score", 6).alias("score"), "positives", "negatives", F.round("weight_norm", 6).alias("weight_norm"), "late")


@query("str4", """
, effects as (select library_id, asset_id, ts as at_ts, event_id as seq, action = 'delete' as marks, bytes from resolved
 union all select library_id, asset_id, undone_at, undo_event_id, false, bytes from resolved where undone and action = 'delete'),
d as (select *, lead(at_ts) over (partition by library_id, asset_id order by at_ts, seq) as next_ts from effects),
mark as (select max(ts) - interval 1 hour as w from decisions where action in ('delete', 'keepOnce', 'whitelist', 'undo'))
select library_id, asset_id, at_ts as marked_at, bytes, at_ts + interval 7 day as execute_after from d cross join mark
where marks and at_ts + interval 7 day <= w and (next_ts is null or at_ts + interval 7 day < next_ts)
""", ("resolved", "decisions"))
def deadlines(lib: Library) -> DataFrame:
    return _run(lib, jobs.pending_deadlines(_decisions(lib)), "deadlines")


DUE_BY_LIBRARY = "case library_id % 3 when 0 then interval 30 day when 1 then interval 0 day else interval 7 day end"


@query("str4_settings", f"""
, effects as (select library_id, asset_id, ts as at_ts, event_id as seq, action = 'delete' as marks, bytes, ts + {DUE_BY_LIBRARY} as due from resolved
 union all select library_id, asset_id, undone_at, undo_event_id, false, bytes, null from resolved where undone and action = 'delete'),
d as (select *, lead(at_ts) over (partition by library_id, asset_id order by at_ts, seq) as next_ts from effects),
mark as (select max(ts) - interval 1 hour as w from decisions where action in ('delete', 'keepOnce', 'whitelist', 'undo'))
select library_id, asset_id, at_ts as marked_at, bytes, due as execute_after from d cross join mark where marks and due <= w and (next_ts is null or due < next_ts)
""", ("resolved", "decisions"))
def deadlines_by_settings(lib: Library) -> DataFrame:
    """The grace is each library's own; the settings are a table beside the stream."""
    return _run(lib, jobs.pending_deadlines(settings.with_settings(_decisions(lib), q_queue.graces(lib), grace="oneWeek"), "grace"), "own-deadlines")


@query("str5", "select asset_id, dhash, phash from fingerprints", ("fingerprints",))
def resumable(lib: Library) -> DataFrame:
    """The fingerprint scan as a stream, started twice on one checkpoint: the second run finds nothing to do."""
    stream = _stream(lib, "documents").select("doc_id", "text").mapInPandas(derived._simhash_batches, "doc_id bigint, dhash bigint, phash bigint")
    path, checkpoint = fresh_path(lib.spark, "scan-sink"), fresh_path(lib.spark, "scan-state")
    for _ in range(2):
        jobs.run_to_end(stream, path, checkpoint)
    return lib.spark.read.schema(stream.schema).parquet(path).select(F.col("doc_id").alias("asset_id"), "dhash", "phash")


@query("str6", """
select 'runs' as metric, count(*) as value from run_verdicts union all select 'dropped_runs', count_if(verdict not in ('vouched', 'ok'))::bigint from run_verdicts
union all select 'cache_hits', count(*) from fingerprints f join assets a using (asset_id) where f.asset_id % 3 <> 0 and not a.is_video
union all select 'cache_misses', count(*) from assets where asset_id % 3 = 0 and not is_video
union all select 'buckets_over_4000', 0
""", ("run_verdicts", "fingerprints", "assets"))
def quality(lib: Library) -> DataFrame:
    cache = lib.fingerprints().filter("asset_id % 3 <> 0")
    images = lib.assets().filter(~F.col("is_video"))
    missing = catalog.missing_fingerprints(images, cache, fixed.FINGERPRINT_VERSION).agg(F.count(F.lit(1)).alias("cache_misses"))
    hits = images.join(cache.select("asset_id"), "asset_id", "left_semi").agg(F.count(F.lit(1)).alias("cache_hits"))
    crowded = copies.bucket_sizes(scan.signature_rows(lib)).agg(F.count_if(F.col("members") > 4000).alias("buckets_over_4000"))
    runs = moments.run_metrics(scan.verdicts(lib)).select("runs", "dropped_runs")
    return metrics.long_form(runs, hits, missing, crowded)


@query("str7", """
, s as (select *, case when ts - lag(ts) over w <= interval 6 hour then 0 else 1 end as starts from decisions window w as (partition by library_id order by ts, event_id)),
r as (select library_id, ts, sum(starts) over (partition by library_id order by ts, event_id rows unbounded preceding) as run from s)
select library_id, min(ts) as started, max(ts) + interval 6 hour as ended, count(*) as members from r group by library_id, run
having max(ts) + interval 6 hour <= (select max(ts) - interval 1 hour from decisions)
""", ("decisions",))
def sessions(lib: Library) -> DataFrame:
    return _run(lib, jobs.burst_sessions(_decisions(lib).select("library_id", "ts"), "6 hours"), "sessions")


@query("str7_settings", """
, s as (select *, 2 + library_id % 5 as hours from decisions),
g as (select *, case when ts - lag(ts) over w <= to_hours(hours::int) then 0 else 1 end as starts from s window w as (partition by library_id order by ts, event_id)),
r as (select library_id, ts, hours, sum(starts) over (partition by library_id order by ts, event_id rows unbounded preceding) as run from g)
select library_id, min(ts) as started, max(ts) + to_hours(max(hours)::int) as ended, count(*) as members from r group by library_id, run
having max(ts) + to_hours(max(hours)::int) <= (select max(ts) - interval 1 hour from decisions)
""", ("decisions",))
def sessions_by_settings(lib: Library) -> DataFrame:
    """Every library with a gap of its own."""
    given = lib.decisions().select("library_id").distinct().select("library_id", ((F.col("library_id") % 5 + 2) * 3600).alias("gap"))
    arrivals = settings.with_settings(_decisions(lib).select("library_id", "ts"), given, gap=10)
    return _run(lib, jobs.burst_sessions(arrivals, "gap"), "own-sessions")


@query("str8", """
select run_date, count(*) as items, sum(bytes)::bigint as bytes from deletion_items where run_date < (select (max(ts) - interval 1 hour)::date from events where event_type = 'purchase') group by run_date
""", ("deletion_items",))
def daily(lib: Library) -> DataFrame:
    items = _decisions(lib).filter("action = 'whitelist'").select("ts", "bytes")
    return _run(lib, jobs.daily_totals(items), "daily")
