"""Queries: catalog sources, caches and row-level expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions import fixed, scalars, vectors
from shoebox.plans.registry import query
from shoebox.session import fresh_path
from shoebox.sources import catalog
from shoebox.sources import snapshots as versions
from shoebox.sources.derived import Library, fingerprints


def _catalog(lib: Library) -> DataFrame:
    """Assets with the columns only a raw catalog has."""
    d = F.col("asset_id")
    kind = F.element_at(F.array(*[F.lit(s) for s in (*fixed.SCANNED_SOURCES, "shared_album")]), (d % 4 + 1).cast("int"))
    return lib.assets().select("*", (d % 23 == 0).alias("is_hidden"), kind.alias("source_type"))


@query("src1", """
select asset_id, creation_ts from assets where asset_id % 23 <> 0 and asset_id % 4 <> 3
""", ("assets",))
def scan(lib: Library) -> DataFrame:
    return catalog.newest_first(catalog.scan(_catalog(lib)).select("asset_id", "creation_ts"))


@query("src2", """
select asset_id, case when asset_id % 10 <> 0 then creation_ts when asset_id % 20 <> 0 then creation_ts + interval 1 hour
 else timestamp '1900-01-01 00:00:00' end as creation_ts,
 (is_video or asset_id % 2 = 0) and asset_id % 5 = 0 as has_adjustments from assets
""", ("assets",))
def snapshots(lib: Library) -> DataFrame:
    d = F.col("asset_id")
    raw = lib.assets().withColumn("modification_ts", F.when(d % 20 != 0, F.col("creation_ts") + F.expr("interval 1 hour")))
    raw = raw.withColumn("creation_ts", F.when(d % 10 != 0, F.col("creation_ts")))
    raw = raw.withColumn("resources_read", F.col("is_video") | (d % 2 == 0)).withColumn("adjusted", d % 5 == 0)
    # a later stand-in date: Python cannot show year 1 in every time zone
    return catalog.snapshot(raw, "1900-01-01 00:00:00").select("asset_id", "creation_ts", "has_adjustments")


@query("src3")
def folder(lib: Library) -> DataFrame:
    """The scan applied to the data folder's own files; names, sizes and times only."""
    return catalog.folder_scan(lib.spark, lib.folder, ("parquet",)).orderBy("filename")


@query("src4", """
select asset_id, trunc(case when is_video then duration * 9000000 / 8 else pixel_width::bigint * pixel_height * 0.35::double end)::bigint as estimate from assets
""", ("assets",))
def estimates(lib: Library) -> DataFrame:
    return lib.assets().select("asset_id", scalars.estimated_bytes().alias("estimate"))


@query("src5", """
select a.asset_id, coalesce(r.bytes, a.byte_size) as byte_size from assets a left join
 (select l_orderkey as asset_id, sum(floor(l_extendedprice)::bigint)::bigint as bytes from lineitem
  where l_orderkey in (select asset_id from candidates where confidence >= 0.35) group by l_orderkey having sum(floor(l_extendedprice)) > 0) r using (asset_id)
""", ("assets", "candidates"))
def refined(lib: Library) -> DataFrame:
    resources = lib.table("lineitem").select(F.col("l_orderkey").alias("asset_id"), F.floor("l_extendedprice").cast("bigint").alias("bytes"))
    sizes = catalog.exact_sizes(resources, lib.candidates().filter("confidence >= 0.35"))
    return catalog.refine_sizes(lib.assets(), sizes).select("asset_id", "byte_size")


def _cache(lib: Library) -> DataFrame:
    """A cache with gaps and rows of an older version."""
    d = F.col("asset_id")
    old = F.when(d % 7 == 0, fixed.FINGERPRINT_VERSION - 1).otherwise(fixed.FINGERPRINT_VERSION)
    return lib.fingerprints().filter(d % 3 != 0).withColumn("version", old)


@query("snk1", """
select f.asset_id, f.dhash, case when f.asset_id % 3 <> 0 and (f.asset_id % 7 <> 0 or a.is_video) then 'cached' else 'fresh' end as origin,
 case when f.asset_id % 3 <> 0 and f.asset_id % 7 = 0 and a.is_video then 7 else 8 end as version
from fingerprints f join assets a using (asset_id) where f.asset_id % 3 <> 0 or not a.is_video
""", ("fingerprints", "assets"))
def incremental(lib: Library) -> DataFrame:
    cache = _cache(lib).withColumn("origin", F.lit("cached"))
    missing = catalog.missing_fingerprints(lib.assets(), cache)
    todo = lib.table("documents").join(missing.withColumnRenamed("asset_id", "doc_id"), "doc_id", "left_semi")
    fresh = fingerprints(todo).withColumn("origin", F.lit("fresh"))
    return catalog.merge_fingerprints(cache, fresh).select("asset_id", "dhash", "origin", "version")


@query("snk1_snapshots", """
select f.asset_id, f.dhash, f.version from fingerprints f join assets a using (asset_id) where a.asset_id % 6 <> 0 and (not a.is_video or (f.asset_id % 3 <> 0 and f.asset_id % 7 <> 0))
""", ("fingerprints", "assets"))
def snapshots_of_the_cache(lib: Library) -> DataFrame:
    """An old cache as the first version; a scan of a library that lost every sixth asset makes the second, a third scan finds nothing to do."""
    root, living = fresh_path(lib.spark, "fingerprint-cache"), lib.assets().filter("asset_id % 6 <> 0")
    versions.write(_cache(lib), root)

    def compute(missing: DataFrame) -> DataFrame:
        return fingerprints(lib.table("documents").join(missing.withColumnRenamed("asset_id", "doc_id"), "doc_id", "left_semi"))

    for _ in range(2):
        rows = versions.update_fingerprints(root, living, compute, fixed.FINGERPRINT_VERSION)
    return rows.select("asset_id", "dhash", "version")


@query("snk2", """
select asset_id from fingerprints where asset_id in (select asset_id from assets where asset_id % 6 <> 0)
""", ("fingerprints", "assets"))
def pruned(lib: Library) -> DataFrame:
    return catalog.prune(lib.fingerprints(), lib.assets().filter("asset_id % 6 <> 0")).select("asset_id")


@query("snk3", """
select 'fingerprint' as kind, asset_id as id from fingerprints where asset_id % 3 <> 0 and asset_id % 7 <> 0
union all select 'vector', vec_id from vectors where vec_id % 5 <> 0
""", ("fingerprints", "vectors"))
def gates(lib: Library) -> DataFrame:
    kept = catalog.current_version(_cache(lib), fixed.FINGERPRINT_VERSION)
    mixed = lib.vectors().withColumn("revision", F.when(F.col("vec_id") % 5 == 0, 1).otherwise(F.col("revision")))
    return kept.select(F.lit("fingerprint").alias("kind"), F.col("asset_id").alias("id")).union(
        catalog.same_revision(mixed).select(F.lit("vector"), "vec_id")
    )


def _entries(lib: Library) -> DataFrame:
    """The vectors marked as centroids, under their app's name."""
    sizes = lib.vectors().groupBy("app").agg(F.count(F.lit(1)).alias("sample_count"))
    marked = lib.vectors().filter("is_centroid").join(sizes, "app")
    return marked.select(F.col("app").alias("name"), F.lit(None).cast("string").alias("category"), "sample_count", "revision", F.col("embedding").alias("centroid"))


@query("snk4", """
select app as name, count(*) as sample_count, count_if(is_centroid)::bigint as centroids, 64 as dimension from vectors group by app having count_if(is_centroid)::bigint > 0
""", ("vectors",))
def round_trip(lib: Library) -> DataFrame:
    path = fresh_path(lib.spark, "centroid-library")
    catalog.write_centroids(_entries(lib), path)
    back = catalog.read_centroids(lib.spark, path)
    per_label = back.groupBy("name", "sample_count")
    return per_label.agg(F.count(F.lit(1)).alias("centroids"), F.max(F.size("centroid")).alias("dimension"))


@query("snk5", """
select app as name, case when label % 2 = 0 then 'own' else 'library' end as origin, count(*) as sample_count from vectors group by app, label
""", ("vectors",))
def seeded(lib: Library) -> DataFrame:
    per_app = lib.vectors().groupBy(F.col("app").alias("name"), "label").agg(F.count(F.lit(1)).alias("sample_count"))
    own = per_app.filter("label % 2 = 0").select("name", F.lit("own").alias("origin"), "sample_count")
    return catalog.seed_labels(own, per_app.select("name", F.lit("library").alias("origin"), "sample_count"))


@query("sca1", "select asset_id, pixel_count, round(pixel_width::double / pixel_height, 6) as aspect from screens", ("screens",))
def shapes(lib: Library) -> DataFrame:
    return lib.assets().select("asset_id", scalars.pixel_count().alias("pixel_count"), F.round(scalars.aspect(), 6).alias("aspect"))


@query("sca2", "select asset_id, is_screenshot, is_live, is_panorama, is_portrait from screens", ("screens",))
def flags(lib: Library) -> DataFrame:
    return scalars.with_derived(lib.assets()).select("asset_id", "is_screenshot", "is_live", "is_panorama", "is_portrait")


@query("sca3", "select asset_id, is_screen_recording from screens", ("screens",))
def recordings(lib: Library) -> DataFrame:
    return lib.assets().select("asset_id", scalars.is_screen_recording().alias("is_screen_recording"))


@query("sca4", "select asset_id, is_screen_like from screens", ("screens",))
def screen_like(lib: Library) -> DataFrame:
    return lib.assets().select("asset_id", scalars.is_screen_like().alias("is_screen_like"))


@query("sca5", "select asset_id, bit_count(xor(dhash, phash))::int as distance from fingerprints", ("fingerprints",))
def distances(lib: Library) -> DataFrame:
    return lib.fingerprints().select("asset_id", scalars.hamming("dhash", "phash").alias("distance"))


@query("sca6", """
select a.asset_id, a.pixel_width::bigint * b.pixel_height = b.pixel_width::bigint * a.pixel_height as same_shape
from assets a join assets b on b.asset_id = a.asset_id + 1
""", ("assets",))
def same_shape(lib: Library) -> DataFrame:
    a = lib.assets().select("asset_id", F.col("pixel_width").alias("aw"), F.col("pixel_height").alias("ah"))
    b = lib.assets().select((F.col("asset_id") - 1).alias("asset_id"), F.col("pixel_width").alias("bw"), F.col("pixel_height").alias("bh"))
    return a.join(b, "asset_id").select("asset_id", scalars.same_shape("aw", "ah", "bw", "bh").alias("same_shape"))


def _values(pairs) -> str:
    return ", ".join(f"({s}, {l})" for s, l in pairs)


@query("sca7", f"""
select asset_id, case when (lo, hi) in ({_values(fixed.PHONE_SCREENS)}) then 'phone' when (lo, hi) in ({_values(fixed.AMBIGUOUS_SCREENS)}) then 'ambiguous' else 'none' end as device_match
from (select asset_id, least(w, h) as lo, greatest(w, h) as hi from
 (select asset_id, case when asset_id % 9 = 0 then 2048 else pixel_width end as w, case when asset_id % 9 = 0 then 1536 else pixel_height end as h from assets))
""", ("assets",))
def devices(lib: Library) -> DataFrame:
    resized = lib.assets().withColumns({
        "pixel_width": F.when(F.col("asset_id") % 9 == 0, 2048).otherwise(F.col("pixel_width")),
        "pixel_height": F.when(F.col("asset_id") % 9 == 0, 1536).otherwise(F.col("pixel_height")),
    })
    return scalars.device_match(resized).select("asset_id", "device_match")


@query("sca8", r"""
select asset_id, line_no, regexp_full_match(regexp_replace(upper(replace(trim(text), '：', ':')), ' [AP]M', '', 'g'), '([0-9]|[01][0-9]|2[0-3]):[0-5][0-9]') as clock from ocr_lines
""", ("ocr_lines",))
def clocks(lib: Library) -> DataFrame:
    return lib.ocr_lines().select("asset_id", F.col("line_no").cast("bigint").alias("line_no"), scalars.looks_like_clock("text").alias("clock"))


@query("sca9", """
select v.vec_id, round(list_cosine_similarity(v.embedding::double[], n.embedding::double[]), 6) as similarity,
 round(sqrt(list_dot_product(n.embedding::double[], n.embedding::double[])), 6) as next_norm
from vectors v join vectors n on n.vec_id = v.vec_id + 1
""", ("vectors",))
def cosines(lib: Library) -> DataFrame:
    v = lib.vectors().select("vec_id", "embedding")
    n = lib.vectors().select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(n, "vec_id").select(
        "vec_id", F.round(vectors.cosine("embedding", vectors.normalise("next")), 6).alias("similarity"), F.round(vectors.norm("next"), 6).alias("next_norm")
    )
