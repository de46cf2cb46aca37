"""Queries: evaluation, calibration and pixel fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions import scalars
from shoebox.operators import embeddings as emb
from shoebox.operators import evaluate, keepers, pixels
from shoebox.plans import q_learning as learning
from shoebox.plans import scan
from shoebox.plans.duck_views import view
from shoebox.plans.q_layout import classified
from shoebox.plans.registry import query
from shoebox.sources.derived import Library

# file names with known relations: every three assets are versions of one capture
view("named", """
select *, case when (asset_id // 3) % 5 = 0 then 'burst_' else 'photo_' end || (asset_id // 3) || case asset_id % 3 when 0 then '' when 1 then '_copy' else '_resized' end || '.jpg' as name from images
""", ("images",))
view("stems", "select *, regexp_replace(regexp_replace(name, '\\.(jpg|png)', ''), '(_copy|_recompressed|_resized|_burst)$', '') as stem, name like 'burst%' as is_burst from named", ("named",))
view("all_pairs", """
select a.asset_id as a, b.asset_id as b, bit_count(xor(a.dhash, b.dhash))::bigint as d, bit_count(xor(a.phash, b.phash))::bigint as p,
 case when a.content_hash = b.content_hash then 'same content' when a.stem = b.stem then 'same capture' else 'different' end as kind,
 case when a.is_screen_like or b.is_screen_like then null when a.is_burst and b.is_burst then 'burst frames' when a.stem <> b.stem then 'different photographs' end as photo_kind
from stems a join stems b on a.asset_id < b.asset_id
""", ("stems",))
view("kinds", "select a, b, d, p, kind from all_pairs union all select a, b, d, p, photo_kind from all_pairs where photo_kind is not null", ("all_pairs",))


def distances(lib: Library) -> DataFrame:
    d = F.col("asset_id")
    prefix = F.when(F.floor(d / 3) % 5 == 0, "burst_").otherwise("photo_")
    suffix = F.when(d % 3 == 0, "").when(d % 3 == 1, "_copy").otherwise("_resized")
    name = F.concat(prefix, F.floor(d / 3).cast("string"), suffix, F.lit(".jpg"))
    rows = scan.image_rows(lib).withColumn("name", name)
    prepared = rows.select(d.alias("item_id"), "content_hash", evaluate.stem("name").alias("stem"), F.col("name").startswith("burst").alias("is_burst"), "is_screen_like", "dhash", "phash")
    return lib.keep("pair-distances", lambda: evaluate.pair_distances(prepared))


@query("eva1", "select kind, d, p, count(*) as pairs from kinds where kind in ('same content', 'same capture', 'different') group by all", ("kinds",))
def pair_classes(lib: Library) -> DataFrame:
    return evaluate.histogram(distances(lib)).filter(F.col("kind").isin("same content", "same capture", "different"))


DISTRIBUTION = """
select kind, m as measure, count(*) as n, min(v) as min, list_sort(list(v))[floor((count(*) - 1) * 0.5)::bigint + 1] as median,
 list_sort(list(v))[floor((count(*) - 1) * 0.9::double)::bigint + 1] as p90, max(v) as max
from (select kind, 'dhash' as m, d as v from kinds union all select kind, 'phash', p from kinds) where kind in KINDS group by kind, m
"""


@query("eva2", DISTRIBUTION.replace("KINDS", "('same content', 'same capture', 'different')"), ("kinds",))
def distributions(lib: Library) -> DataFrame:
    return evaluate.distribution(pair_classes(lib))


@query("eva3", DISTRIBUTION.replace("KINDS", "('burst frames', 'different photographs')"), ("kinds",))
def photo_distributions(lib: Library) -> DataFrame:
    return evaluate.distribution(evaluate.histogram(distances(lib)).filter(F.col("kind").isin("burst frames", "different photographs")))


@query("eva4", """
select t::int as t, count_if(d <= t and p <= t + 2)::bigint as false_pairs from kinds cross join (values (2), (3), (4), (6), (8), (10), (12)) v(t) where kind = 'different' group by t
""", ("kinds",))
def sweep(lib: Library) -> DataFrame:
    return evaluate.threshold_sweep(pair_classes(lib))


@query("eva5", "select * from (select kind, row_number() over (partition by kind order by d, p, a, b)::int as nth, a, b, d, p from kinds) where nth <= 12", ("kinds",))
def closest(lib: Library) -> DataFrame:
    return evaluate.closest_pairs(distances(lib))


def _judged(lib: Library) -> DataFrame:
    truth = lib.candidates().select("asset_id", F.col("category").alias("truth"))
    return classified(lib).select("asset_id", F.col("category").alias("predicted")).join(truth, "asset_id")


@query("eva6", """
, j as (select c.category as truth, r.category as predicted from classified r join candidates c using (asset_id))
select truth, count(*) as n, count_if(truth = predicted)::bigint as right from j group by truth union all select 'all', count(*), count_if(truth = predicted)::bigint from j
""".replace(" as right", ' as "right"'), ("classified", "candidates"))
def accuracy(lib: Library) -> DataFrame:
    return evaluate.accuracy(_judged(lib))


@query("eva7", "select c.category as truth, r.category as predicted, count(*) as n from classified r join candidates c using (asset_id) group by 1, 2", ("classified", "candidates"))
def confusion(lib: Library) -> DataFrame:
    return evaluate.confusion(_judged(lib))


def _examples(lib: Library) -> DataFrame:
    return learning.items(lib).withColumn("target", (F.col("app_no") % 8).cast("int"))


# leave-one-out as a recursion: fold p learns from every other place, those that differ in a higher bit first
view("left_out", "select item_id, label % 8 as target, (label < 4)::int as low, e as x, row_number() over (order by md5(item_id::varchar), item_id) - 1 as p from items", ("items",))
view("left_out_order", """
select a.p as fold, list(b.p order by floor(log2(xor(a.p, b.p))) desc, b.p) as seq from left_out a join left_out b on a.p <> b.p group by a.p
""", ("left_out",))
view("softmax_left_out", """
select fold, seq, 0::bigint as k, list_transform(range(8), lambda c: list_transform(range(64), lambda i: 0.0::double)) as w, list_transform(range(8), lambda c: 0.0::double) as b from left_out_order
 union all select fold, seq, k + 1,
  list_transform(range(8), lambda c: if(abs(g[c + 1]) > 1e-6, list_transform(range(64), lambda i: w[c + 1][i + 1] - (0.35::double * g[c + 1] * x[i + 1] + 1e-4::double * w[c + 1][i + 1])), w[c + 1])),
  list_transform(range(8), lambda c: if(abs(g[c + 1]) > 1e-6, b[c + 1] - 0.35::double * g[c + 1], b[c + 1]))
 from (select *, list_transform(range(8), lambda c: e[c + 1] / list_sum(e) - (c = target)::int) as g from
  (select *, list_transform(z, lambda v: exp(v - list_max(z))) as e from
   (select f.*, r.x, r.target, list_transform(range(8), lambda c: list_dot_product(f.w[c + 1], r.x) + f.b[c + 1]) as z from softmax_left_out f join left_out r on r.p = f.seq[f.k + 1])))
""", ("left_out", "left_out_order"))
view("softmax_judged", """
select target, list_position(z, list_max(z)) - 1 as predicted from
 (select r.target, list_transform(range(8), lambda c: list_dot_product(w[c + 1], r.x) + b[c + 1]) as z from softmax_left_out f join left_out r on r.p = f.fold where f.k = len(f.seq))
""", ("left_out", "softmax_left_out"))
view("logistic_left_out", """
select fold, seq, 0::bigint as k, list_transform(range(64), lambda i: 0.0::double) as w, 0.0::double as b from left_out_order
 union all select fold, seq, k + 1, list_transform(range(64), lambda i: w[i + 1] - (0.25::double * d * x[i + 1] + 2e-4::double * w[i + 1])), b - 0.25::double * d
 from (select f.*, r.x, 1 / (1 + exp(-(list_dot_product(f.w, r.x) + f.b))) - r.low as d from logistic_left_out f join left_out r on r.p = f.seq[f.k + 1])
""", ("left_out", "left_out_order"))


def _left_out(lib: Library) -> DataFrame:
    return lib.keep("left-out", lambda: evaluate.leave_one_out(_examples(lib), "softmax"))


@query("eva8", """
select target::varchar as truth, count(*) as n, count_if(predicted = target)::bigint as r from softmax_judged group by target
union all select 'all', count(*), count_if(predicted = target)::bigint from softmax_judged
""".replace(" as r ", ' as "right" '), ("softmax_judged",))
def held_out_classes(lib: Library) -> DataFrame:
    return evaluate.accuracy(_left_out(lib).select(F.col("target").cast("string").alias("truth"), F.col("predicted").cast("string").alias("predicted")))


@query("eva8_binary", """
, s as (select r.low = 1 as positive, 1 / (1 + exp(-(list_dot_product(w, r.x) + b))) as score from logistic_left_out f join left_out r on r.p = f.fold where f.k = len(f.seq))
select round(avg(score) filter (where positive), 6) as positive_mean, round(avg(score) filter (where not positive), 6) as negative_mean,
 round(avg(score) filter (where positive) - avg(score) filter (where not positive), 6) as separation, round(avg(positive::int), 6) as base_rate from s
""", ("left_out", "logistic_left_out"))
def held_out_scores(lib: Library) -> DataFrame:
    binary = learning.items(lib).withColumn("target", (F.col("app_no") < 4).cast("int"))
    scored = evaluate.leave_one_out(binary, "logistic").select("item_id", "score", (F.col("target") == 1).alias("positive"))
    return evaluate.separation(scored).select(*[F.round(c, 6).alias(c) for c in ("positive_mean", "negative_mean", "separation", "base_rate")])


@query("eva9", """
, s as (select l.item_id, score, app_is as positive from logistic l join (select item_id, label < 4 as app_is from items) using (item_id))
select 'positive_mean' as measure, round(avg(score), 6) as value from s where positive union all select 'negative_mean', round(avg(score), 6) from s where not positive
union all select 'separation', round(avg(case when positive then score end) - avg(case when not positive then score end), 6) from s
union all select 'base_rate', round(avg(positive::int), 6) from s
union all select 'precision_at_8', count_if(positive)::bigint / count(*)::double from (select * from s order by score desc, item_id limit 8)
""", ("logistic", "items"))
def ranking_quality(lib: Library) -> DataFrame:
    scored = learning.with_literal_logistic(learning.items(lib)).select("item_id", "score", (F.col("app_no") < 4).alias("positive"))
    rounded = [F.round(c, 6).alias(c) for c in ("positive_mean", "negative_mean", "separation", "base_rate")]
    means = evaluate.separation(scored).select(*rounded).unpivot([], ["positive_mean", "negative_mean", "separation", "base_rate"], "measure", "value")
    top = evaluate.precision_at(scored, 8).select(F.lit("precision_at_8").alias("measure"), (F.col("hits") / F.col("k")).alias("value"))
    return means.union(top)


@query("eva10")
def half_hold_out(lib: Library) -> DataFrame:
    judged = evaluate.half_hold_out(_examples(lib))
    return judged.groupBy("target").agg(F.count(F.lit(1)).alias("tested"), F.count_if(F.col("predicted") == F.col("target")).alias("right"))


@query("eva10_named", """
select target, count(*) as tested, count_if(predicted = target)::bigint as r from softmax_judged group by target having count(*) >= 2
""".replace(" as r ", ' as "right" '), ("softmax_judged",))
def named_hold_out(lib: Library) -> DataFrame:
    """Every cluster named: each item is judged by a head that learned from all the others."""
    return evaluate.each_cluster_named(_left_out(lib)).select("target", "tested", "right")


@query("eva11", """
, p as (select case when a.app = b.app then a.app else 'between' end as name, list_cosine_similarity(a.e, b.e) as v from items a join items b on a.item_id < b.item_id)
select name, count(*) as n, round(min(v), 6) as min, round(list_sort(list(v))[count(*) // 2 + 1], 6) as median, round(max(v), 6) as max from p group by name
""", ("items",))
def cosine_spread(lib: Library) -> DataFrame:
    spread = lib.keep("cosine-spread", lambda: evaluate.cosine_spread(learning.items(lib)))
    return spread.select("name", "n", *[F.round(c, 6).alias(c) for c in ("min", "median", "max")])


@query("eva11_margin", """
, p as (select a.app = b.app as inside, list_cosine_similarity(a.e, b.e) as v from items a join items b on a.item_id < b.item_id)
select round(min(v) filter (where inside), 6) as worst_inside, round(max(v) filter (where not inside), 6) as best_between,
 round(min(v) filter (where inside) - max(v) filter (where not inside), 6) as margin from p
""", ("items",))
def cosine_margin(lib: Library) -> DataFrame:
    spread = lib.keep("cosine-spread", lambda: evaluate.cosine_spread(learning.items(lib)))
    return evaluate.separability(spread).select(*[F.round(c, 6).alias(c) for c in ("worst_inside", "best_between", "margin")])


@query("eva12")
def merge_sweep(lib: Library) -> DataFrame:
    return evaluate.merge_sweep(learning.items(lib), (0.25, 0.30, 0.35, 0.40, 0.45))


@query("eva13", """
select 'clusters' as measure, count(distinct matched) as n from matched
union all select 'pure', count(*) from (select matched from matched where matched is not null group by matched having count(distinct app) = 1)
union all select 'hit', count_if(matched = app)::bigint from matched union all select 'wrong', count_if(matched <> app)::bigint from matched union all select 'miss', count_if(matched is null)::bigint from matched
""", ("matched",))
def backtest(lib: Library) -> DataFrame:
    matched = emb.match_labels(learning.items(lib), learning.centroids(lib), learning.LABEL_AT, keep=("app",)).select("label", F.col("app").alias("truth"))
    pure = evaluate.purity(matched.filter("label is not null").withColumnRenamed("label", "cluster"))
    counts = evaluate.name_once(matched).unpivot([], ["hit", "wrong", "miss"], "measure", "n")
    return pure.unpivot([], ["clusters", "pure"], "measure", "n").union(counts)


@query("eva14", """
select m.group_id, m.tier, m.asset_id, m.is_keeper, bit_count(xor(m.dhash, k.dhash))::int as d, bit_count(xor(m.phash, k.phash))::int as p
from grouped m join grouped k on k.group_id = m.group_id and k.is_keeper
""", ("grouped",))
def group_report(lib: Library) -> DataFrame:
    rows = keepers.with_keeper_hashes(scan.grouped(lib))
    return rows.select("group_id", "tier", "asset_id", "is_keeper", scalars.hamming("dhash", "kd").alias("d"), scalars.hamming("phash", "kp").alias("p"))


# --- pixel fingerprints -----------------------------------------------------------------------------

view("grids", """
select vec_id as asset_id, list_transform(range(1024), lambda i: least(1.0::double, greatest(0.0::double, 0.5::double + 2 * e[i // 32 + 1] * e[33 + i % 32]))) as g
from (select vec_id, embedding::double[] as e from embeddings)
""")


def grids(lib: Library) -> DataFrame:
    """Pixel grids made from the vectors: gray from products of their halves, RGB repeating the gray."""
    e = F.col("embedding").cast("array<double>")
    rows = lib.vectors().select(F.col("vec_id").alias("asset_id"), e.alias("e"))
    gray = F.expr("transform(sequence(0, 1023), i -> least(1.0D, greatest(0.0D, 0.5D + 2 * e[i div 32] * e[32 + i % 32])))")
    rows = rows.withColumn("gray", gray)
    return rows.select(
        "asset_id", "gray", F.expr("transform(sequence(0, 71), i -> gray[(i div 9) * 32 + i % 9])").alias("gray9x8"),
        F.expr("flatten(transform(gray, v -> array_repeat(cast(v * 255 as int), 3)))").alias("rgb"),
    )


def prints(lib: Library) -> DataFrame:
    return lib.keep("pixel-prints", lambda: pixels.fingerprint(grids(lib)))


@query("fpr1", """
select vec_id as asset_id, (sum(case when e[i + 1] > e[(i + 1) % 64 + 1] then case when i = 63 then -9223372036854775808::hugeint else (1::bigint << i)::hugeint end else 0::hugeint end))::bigint as dhash
from (select vec_id, embedding::double[] as e from embeddings) cross join range(64) t(i) group by vec_id
""".replace("(1::bigint << i)::hugeint", "(1::bigint << least(i, 62))::hugeint"))
def ring_bits(lib: Library) -> DataFrame:
    """The bit step on 64 ring differences of the vectors."""
    rows = lib.vectors().select(F.col("vec_id").alias("asset_id"), F.col("embedding").cast("array<double>").alias("e"))
    flags = F.expr("transform(sequence(0, 63), i -> e[i] > e[(i + 1) % 64])")
    return rows.select("asset_id", pixels.pack_flags(flags).alias("dhash"))


@query("fpr1_grid", """
select asset_id, (sum(case when g[(i // 8) * 32 + i % 8 + 1] > g[(i // 8) * 32 + i % 8 + 2] then case when i = 63 then -9223372036854775808::hugeint else (1::bigint << least(i, 62))::hugeint end else 0::hugeint end))::bigint as dhash
from grids cross join range(64) t(i) group by asset_id
""", ("grids",))
def grid_dhash(lib: Library) -> DataFrame:
    return prints(lib).select("asset_id", "dhash")


@query("fpr2", """
, v as (select vec_id as asset_id, embedding::double[] as e, list_sort(embedding[2:64])[32]::double as m from embeddings)
select asset_id, (sum(case when e[i + 1] > m then case when i = 63 then -9223372036854775808::hugeint else (1::bigint << least(i, 62))::hugeint end else 0::hugeint end))::bigint as phash
from v cross join range(64) t(i) group by asset_id
""", ("vectors",))
def threshold_bits(lib: Library) -> DataFrame:
    rows = lib.vectors().select(F.col("vec_id").alias("asset_id"), F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("asset_id", pixels.above_tail_median("e").alias("phash"))


view("dct", """
select asset_id, list(c order by k, l) as c from
 (select asset_id, k, l, list_sum(list_transform(range(32), lambda y: cos(pi() * (2 * y + 1) * k / 64) * list_dot_product(g[y * 32 + 1:y * 32 + 32], list_transform(range(32), lambda x: cos(pi() * (2 * x + 1) * l / 64))))) as c
  from grids cross join range(8) a(k) cross join range(8) b(l)) group by asset_id
""", ("grids",))
BIT = "case when i = 63 then -9223372036854775808::hugeint else (1::bigint << least(i, 62))::hugeint end"
view("grid_phash", f"""
select asset_id, sum(case when c[i + 1] > list_sort(c[2:64])[32] then {BIT} else 0::hugeint end)::bigint as phash from dct cross join range(64) t(i) group by asset_id
""", ("dct",))


@query("fpr2_grid", "select asset_id, phash from grid_phash", ("grid_phash",))
def grid_phash(lib: Library) -> DataFrame:
    """DCT and threshold together; the tests replay it by definition."""
    return prints(lib).select("asset_id", "phash")


@query("fpr3", """
select asset_id, md5(array_to_string(list_transform(g, lambda v: greatest(0, least(255, trunc(v * 255)::int))::varchar), ',') || ';'
 || array_to_string(list_transform(range(3072), lambda i: trunc(g[i // 3 + 1] * 255)::int::varchar), ',')) as digest from grids
""", ("grids",))
def content_digest(lib: Library) -> DataFrame:
    return grids(lib).select("asset_id", pixels.quantised_digest(F.col("gray"), F.col("rgb")).alias("digest"))


@query("fpr4", """
select asset_id, round(least(1.0::double, stddev_pop(4 * g[k + 1] - g[k] - g[k + 2] - g[k - 31] - g[k + 33]) / 0.15), 6) as sharpness
from grids cross join (select y * 32 + x as k from range(1, 31) a(y) cross join range(1, 31) b(x)) group by asset_id
""", ("grids",))
def sharpness(lib: Library) -> DataFrame:
    return prints(lib).select("asset_id", F.round("sharpness", 6).alias("sharpness"))


@query("fpr5", """
select asset_id, 0.0::double as saturation, round(avg(trunc(v * 255) / 255.0::double), 6) as brightness from (select asset_id, unnest(g) as v from grids) group by asset_id
""", ("grids",))
def colour(lib: Library) -> DataFrame:
    return prints(lib).select("asset_id", F.round("saturation", 6).alias("saturation"), F.round("brightness", 6).alias("brightness"))


@query("fpr6", """
select asset_id, round(sum(n) / 1024.0::double, 6) as flatness from (select *, row_number() over (partition by asset_id order by n desc) as k from
 (select asset_id, trunc(trunc(v * 255) / 255.0::double * 15) as bucket, count(*) as n from (select asset_id, unnest(g) as v from grids) group by 1, 2)) where k <= 8 group by asset_id
""", ("grids",))
def flatness(lib: Library) -> DataFrame:
    return prints(lib).select("asset_id", F.round("flatness", 6).alias("flatness"))


@query("fpr7", """
select asset_id, round(count_if(abs(g[k + 2] - g[k + 1]) + abs(g[k + 33] - g[k + 1]) > 0.12)::bigint::double / 961, 6) as edge_density
from grids cross join (select y * 32 + x as k from range(0, 31) a(y) cross join range(0, 31) b(x)) group by asset_id
""", ("grids",))
def edges(lib: Library) -> DataFrame:
    return prints(lib).select("asset_id", F.round("edge_density", 6).alias("edge_density"))


@query("fpr8", f"""
, level as (select asset_id, g, list_transform(g, lambda v: greatest(0, least(255, trunc(v * 255)::int))) as q, list_transform(range(3072), lambda i: trunc(g[i // 3 + 1] * 255)::int) as rgb from grids),
fnv as (select asset_id, list_reduce(list_concat(q, rgb)::hugeint[], lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint, 14695981039346656037::hugeint) as h from level),
bits as (select asset_id, sum(case when g[(i // 8) * 32 + i % 8 + 1] > g[(i // 8) * 32 + i % 8 + 2] then {BIT} else 0::hugeint end)::bigint as dhash from grids cross join range(64) t(i) group by asset_id),
sharp as (select asset_id, least(1.0::double, stddev_pop(4 * g[k + 1] - g[k] - g[k + 2] - g[k - 31] - g[k + 33]) / 0.15) as v
 from grids cross join (select y * 32 + x as k from range(1, 31) a(y) cross join range(1, 31) b(x)) group by asset_id),
edge as (select asset_id, count_if(abs(g[k + 2] - g[k + 1]) + abs(g[k + 33] - g[k + 1]) > 0.12)::bigint::double / 961 as v
 from grids cross join (select y * 32 + x as k from range(0, 31) a(y) cross join range(0, 31) b(x)) group by asset_id),
flat as (select asset_id, sum(n) / 1024.0::double as v from (select *, row_number() over (partition by asset_id order by n desc) as k from
 (select asset_id, trunc(trunc(v * 255) / 255.0::double * 15) as bucket, count(*) as n from (select asset_id, unnest(g) as v from grids) group by 1, 2)) where k <= 8 group by asset_id),
light as (select asset_id, avg(trunc(v * 255) / 255.0::double) as v from (select asset_id, unnest(g) as v from grids) group by asset_id)
select asset_id, dhash, phash, (case when h >= 9223372036854775808::hugeint then h - 18446744073709551616::hugeint else h end)::bigint as content_hash, round(sharp.v, 6) as sharpness, 0.0::double as saturation,
 round(flat.v, 6) as flatness, round(edge.v, 6) as edge_density, round(light.v, 6) as brightness, 8 as version
from bits join grid_phash using (asset_id) join fnv using (asset_id) join sharp using (asset_id) join edge using (asset_id) join flat using (asset_id) join light using (asset_id)
""", ("grids", "grid_phash"))
def fingerprint_job(lib: Library) -> DataFrame:
    """The whole job over the images that have no current fingerprint yet."""
    from shoebox.sources import catalog

    cached = prints(lib).filter("asset_id % 3 <> 0")
    wanted = lib.vectors().select(F.col("vec_id").alias("asset_id"), F.lit(False).alias("is_video"))
    missing = catalog.missing_fingerprints(wanted, cached)
    merged = catalog.merge_fingerprints(cached, pixels.fingerprint(grids(lib).join(missing, "asset_id", "left_semi")))
    places = ("sharpness", "saturation", "flatness", "edge_density", "brightness")
    return merged.select(*[F.round(c, 6).alias(c) if c in places else c for c in merged.columns])
