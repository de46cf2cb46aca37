"""Queries: embeddings and learned heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions import vectors
from shoebox.functions.fixed import LEARNABLE
from shoebox.operators import embeddings as emb
from shoebox.operators import heads, queue
from shoebox.plans.duck_views import view
from shoebox.plans.q_layout import classified
from shoebox.plans.registry import query
from shoebox.sources.derived import Library

# the given vectors are random directions, so checks use low thresholds
LABEL_AT, MERGE_AT = 0.2, 0.35

view("items", "select library_id, vec_id as item_id, embedding::double[] as e, app, label, is_centroid from vectors", ("vectors",))
view("label_best", """
select item_id, arg_max(name, (sim, -rank)) as label, max(sim) as similarity from
 (select i.item_id, c.app as name, dense_rank() over (order by c.app) as rank, list_cosine_similarity(i.e, c.e) as sim from items i join items c on c.is_centroid) group by item_id
""", ("items",))
view("matched", "select i.*, if(b.similarity >= 0.2, b.label, null) as matched, if(b.similarity >= 0.2, b.similarity, null) as similarity from items i left join label_best b using (item_id)", ("items", "label_best"))

# literal weights for the scoring checks: class c, dimension d (both from 0)
view("softmax_weights", """
select c, list_transform(range(64), lambda d: sin((c * 64 + d)::double)) as w, c / 10.0::double as b from range(8) t(c)
""")
view("probabilities", f"""
select item_id, list(p order by c) as probabilities from
 (select item_id, c, exp(z - max(z) over (partition by item_id)) / sum(exp(z - mz)) over (partition by item_id) as p from
  (select *, max(z) over (partition by item_id) as mz from (select item_id, c, list_dot_product(w, e) + b as z from items cross join softmax_weights))) group by item_id
""", ("items", "softmax_weights"))
view("logistic", "select item_id, 1 / (1 + exp(-(list_dot_product(list_transform(range(64), lambda d: cos(d::double)), e) + 0.1::double))) as score from items", ("items",))
view("learnable", "select * from (values " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(LEARNABLE)) + ") v(c, name)")


def logistic_fold(name: str, library: str) -> None:
    """Views of the online logistic head as a recursion over each library's swipes: ``name``_rows, ``name``_fold and ``name``_models."""
    view(f"{name}_rows", f"""
select {library} as library_id, event_id, row_number() over (partition by {library} order by ts, event_id) as k, embedding::double[] as x, (action = 'delete')::int as target
from decisions join embeddings on vec_id = asset_id where action in ('delete', 'keepOnce', 'whitelist')
""", ("decisions",))
    view(f"{name}_fold", f"""
select distinct library_id, 0::bigint as k, null::bigint as event_id, 0.0::double as score, list_transform(range(64), lambda i: 0.0::double) as w, 0.0::double as b, 0::bigint as pos, 0::bigint as neg from {name}_rows
 union all select library_id, k, event_id, p, list_transform(range(64), lambda i: w[i + 1] - (0.25::double * (p - target) * x[i + 1] + 2e-4::double * w[i + 1])), b - 0.25::double * (p - target), pos + target, neg + 1 - target
 from (select r.*, f.w, f.b, f.pos, f.neg, 1 / (1 + exp(-(list_dot_product(f.w, r.x) + f.b))) as p from {name}_fold f join {name}_rows r on r.library_id = f.library_id and r.k = f.k + 1)
""", (f"{name}_rows",))
    view(f"{name}_models", f"select * from {name}_fold qualify row_number() over (partition by library_id order by k desc) = 1", (f"{name}_fold",))


logistic_fold("swipe", "library_id")
logistic_fold("twenty", "library_id % 20")
view("relabel_rows", """
select library_id, row_number() over (partition by library_id order by ts, event_id) as k, embedding::double[] as x, event_id % 8 as target
from decisions join embeddings on vec_id = asset_id where action = 'relabel'
""", ("decisions",))
view("relabel_fold", """
select distinct library_id, 0::bigint as k, list_transform(range(8), lambda c: list_transform(range(64), lambda i: 0.0::double)) as w, list_transform(range(8), lambda c: 0.0::double) as b,
 list_transform(range(8), lambda c: 0::bigint) as n from relabel_rows
 union all select library_id, k,
  list_transform(range(8), lambda c: if(abs(g[c + 1]) > 1e-6, list_transform(range(64), lambda i: w[c + 1][i + 1] - (0.35::double * g[c + 1] * x[i + 1] + 1e-4::double * w[c + 1][i + 1])), w[c + 1])),
  list_transform(range(8), lambda c: if(abs(g[c + 1]) > 1e-6, b[c + 1] - 0.35::double * g[c + 1], b[c + 1])), list_transform(range(8), lambda c: n[c + 1] + (c = target)::bigint)
 from (select *, list_transform(range(8), lambda c: e[c + 1] / list_sum(e) - (c = target)::int) as g from
  (select *, list_transform(z, lambda v: exp(v - list_max(z))) as e from
   (select r.*, f.w, f.b, f.n, list_transform(range(8), lambda c: list_dot_product(f.w[c + 1], r.x) + f.b[c + 1]) as z from relabel_fold f join relabel_rows r on r.library_id = f.library_id and r.k = f.k + 1)))
""", ("relabel_rows",))


def items(lib: Library) -> DataFrame:
    return lib.vectors().withColumnsRenamed({"vec_id": "item_id", "label": "app_no"})


def centroids(lib: Library) -> DataFrame:
    return lib.vectors().filter("is_centroid").select("library_id", F.col("app").alias("name"), "revision", F.col("embedding").alias("centroid"))


def with_literal_softmax(rows: DataFrame) -> DataFrame:
    weights = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda d: F.sin((c * 64 + d).cast("double"))))
    bias = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: c / F.lit(10.0))
    rows = rows.withColumn("weights", weights).withColumn("bias", bias)
    return rows.withColumn("probabilities", heads.softmax("weights", "bias", "embedding")).drop("weights", "bias")


def with_literal_logistic(rows: DataFrame) -> DataFrame:
    weights = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda d: F.cos(d.cast("double")))
    rows = rows.withColumn("w", weights).withColumn("b", F.lit(0.1))
    return rows.withColumn("score", heads.logistic_score("w", "b", "embedding")).drop("w", "b")


@query("emb1", "select item_id, matched as label, round(similarity, 6) as similarity from matched", ("matched",))
def label_match(lib: Library) -> DataFrame:
    return emb.match_labels(items(lib), centroids(lib), LABEL_AT).select("item_id", "label", F.round("similarity", 6).alias("similarity"))


@query("emb1_join", "select item_id, matched as label, round(similarity, 6) as similarity from matched", ("matched",))
def label_match_join(lib: Library) -> DataFrame:
    """The same in blocks of 50 items and 3 centroids: the rows do not depend on how the product is cut."""
    best = emb.best_labels(items(lib), centroids(lib), team=50, chunk=3)
    near = F.col("similarity") >= LABEL_AT
    return best.select("item_id", F.when(near, F.col("label")).alias("label"), F.round(F.when(near, F.col("similarity")), 6).alias("similarity"))


@query("emb2")
def projection(lib: Library) -> DataFrame:
    """Vectors widened to the full 768 dimensions, projected to 64."""
    wide = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.cos(k.cast("double")))))
    rows = emb.projected(items(lib).select("item_id", wide.alias("embedding")))
    return rows.select("item_id", F.size("projected").alias("dimension"), F.round(vectors.norm("projected"), 6).alias("norm"))


def _clusters(lib: Library) -> DataFrame:
    return lib.keep("clusters", lambda: _found(lib)[0])


_clustered: dict[Library, tuple[DataFrame, DataFrame]] = {}


def _found(lib: Library) -> tuple[DataFrame, DataFrame]:
    """(assigned, centroids) of the library's vectors."""
    if lib not in _clustered:
        _clustered[lib] = emb.clusters_and_centroids(emb.comparable(items(lib)), ["library_id"], MERGE_AT)
    return _clustered[lib]


@query("emb3")
def leaders(lib: Library) -> DataFrame:
    return _clusters(lib).select("item_id", "cluster", F.round("similarity", 6).alias("similarity"))


@query("emb3_blocks")
def leaders_in_blocks(lib: Library) -> DataFrame:
    """The same rule with blocks of 100, so that leaders are merged in levels."""
    return emb.leader_clusters(items(lib), MERGE_AT, block=100).select("item_id", "cluster", F.round("similarity", 6).alias("similarity"))


@query("emb4", """
select matched as label, count(*) as size, sum(item_id * 1000)::bigint as bytes, round(min(similarity), 6) as cohesion from matched where matched is not null group by matched having count(*) >= 2
""", ("matched",))
def summary(lib: Library) -> DataFrame:
    """Summary of given assignments: here those of the label match."""
    assigned = emb.match_labels(items(lib), centroids(lib), LABEL_AT).filter("label is not null")
    numbered = assigned.select("library_id", "item_id", "label", F.regexp_extract("label", "([0-9]+)", 1).cast("int").alias("cluster"), "similarity")
    totals = emb.cluster_summary(numbered, items(lib).select("library_id", "item_id", (F.col("item_id") * 1000).alias("bytes")))
    return totals.select(F.concat(F.lit("app"), F.col("cluster").cast("string")).alias("label"), "size", "bytes", F.round("cohesion", 6).alias("cohesion"))


@query("emb4_suggestions")
def suggestions(lib: Library) -> DataFrame:
    """Clusters found by leaders, largest first, each with the label its centroid resembles most."""
    assigned = _clusters(lib)
    totals = emb.cluster_summary(assigned, items(lib).select("library_id", "item_id", (F.col("item_id") * 1000).alias("bytes")))
    centres = _found(lib)[1].select("library_id", F.col("cluster").cast("bigint").alias("item_id"), F.col("centroid").alias("embedding"), F.lit(2).alias("revision"))
    named = emb.match_labels(centres, centroids(lib), LABEL_AT).select("library_id", F.col("item_id").cast("int").alias("cluster"), "label", "similarity")
    return totals.join(named, ["library_id", "cluster"], "left").orderBy(F.desc("size"), "cluster")


@query("emb5")
def overflow(lib: Library) -> DataFrame:
    """Against a limit of 200 clusters, so that some items fall past it."""
    return emb.overflow(_clusters(lib), 200)


@query("emb6", "select item_id, matched as label from matched where matched is not null", ("matched",))
def label_half(lib: Library) -> DataFrame:
    return emb.match_labels(items(lib), centroids(lib), LABEL_AT).filter("label is not null").select("item_id", "label")


@query("emb6_rest")
def cluster_half(lib: Library) -> DataFrame:
    return emb.label_then_cluster(items(lib), centroids(lib), LABEL_AT, MERGE_AT)[1].select("item_id", "cluster", F.round("similarity", 6).alias("similarity"))


@query("emb7", """
, rows as (select app as name, if(label % 3 = 0, 'chatScreenshot', null) as category, count(*) as n, -1 as seq, count_if(is_centroid)::bigint as cents from items where item_id % 2 = 0 and label % 2 = 0 group by app, label
 union all select trim(' ' || app || ' '), if(item_id % 4 = 1, 'webShot', null), 3, item_id, 1 from items where item_id % 2 = 1 and item_id % 5 <> 0)
select name, arg_min(category, seq) filter (where category is not null) as category, sum(n)::bigint as sample_count, sum(cents)::bigint as centroids from rows group by name
""", ("items",))
def naming(lib: Library) -> DataFrame:
    """Odd vectors act as clusters being named after their app (every fifth gets a blank name)."""
    rows = items(lib)
    own = rows.filter("item_id % 2 = 0 and app_no % 2 = 0")
    labels = own.groupBy(F.col("app").alias("name"), F.when(F.col("app_no") % 3 == 0, "chatScreenshot").alias("category")).agg(F.count(F.lit(1)).alias("sample_count"))
    held = own.filter("is_centroid").select(F.col("app").alias("name"), "revision", F.col("embedding").alias("centroid"))
    given = rows.filter("item_id % 2 = 1").select(
        F.when(F.col("item_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "app", F.lit(" "))).alias("name"),
        F.when(F.col("item_id") % 4 == 1, "webShot").alias("category"), F.lit(3).cast("bigint").alias("sample_count"), "revision",
        F.col("embedding").alias("centroid"), F.col("item_id").alias("seq"),
    )
    merged, centres = emb.name_clusters(labels, held, given)
    counts = centres.groupBy("name").agg(F.count(F.lit(1)).alias("centroids"))
    return merged.join(counts, "name", "left").select("name", "category", "sample_count", F.coalesce("centroids", F.lit(0)).cast("bigint").alias("centroids"))


@query("emb8", """
, edits as (select 'app' || (library_id % 97) as name, ts as edited, event_id as seq, action, event_id % 3 <> 0 as v from decisions where action <> 'relabel'),
sets as (select *, case when action = 'delete' then v when action = 'keepOnce' and v then false end as del, case when action = 'keepOnce' then v when action = 'delete' and v then false end as keep from edits)
select name, coalesce(arg_max(del, (edited, seq)) filter (where del is not null), false) as prefer_delete,
 coalesce(arg_max(keep, (edited, seq)) filter (where keep is not null), false) as prefer_keep from sets group by name
having not bool_or(action = 'undo' and seq % 50 = 0)
""", ("decisions",))
def policies(lib: Library) -> DataFrame:
    """An edit log made of decisions: delete and keepOnce toggle the two preferences, some undos delete the label."""
    kind = F.when(F.col("action") == "delete", "preferDelete").when(F.col("action") == "keepOnce", "preferKeep").when((F.col("action") == "undo") & (F.col("event_id") % 50 == 0), "delete").otherwise("rename")
    edits = lib.decisions().filter("action <> 'relabel'").select(
        F.concat(F.lit("app"), (F.col("library_id") % 97).cast("string")).alias("name"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("field"), (F.col("event_id") % 3 != 0).alias("value")
    )
    return emb.label_policies(edits)


def plane_sql(library: str) -> str:
    """The map by recursion: 40 power steps per axis on each library's covariance."""
    step = "list_transform(c, lambda row: list_dot_product(row, v))"
    return f"""
, rows as (select {library} as lib, item_id, app, e from items),
counts as (select lib, count(*) as n from rows group by lib),
means as (select lib, list(m order by i) as mean from (select lib, i, avg(e[i + 1]) as m from rows cross join range(64) t(i) group by lib, i) group by lib),
cov as (select lib, list(line order by i) as c from (select lib, i, list(p - mean[i + 1] * mean[j + 1] order by j) as line from
 (select lib, i, j, avg(e[i + 1] * e[j + 1]) as p from rows cross join range(64) a(i) cross join range(64) b(j) group by lib, i, j) join means using (lib) group by lib, i) group by lib),
start as (select list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) as v0 from (select list_transform(range(64), lambda i: sin(i * 0.7::double) + 0.31::double) as s)),
first as (select lib, c, v0 as v, 0 as k from cov cross join start
 union all select lib, c, list_transform(y, lambda t: t / sqrt(list_dot_product(y, y))), k + 1 from (select lib, c, k, {step} as y from first where k < 40)),
second as (select lib, c, a, v0 as v, 0 as k from (select lib, c, v as a from first where k = 40) cross join start
 union all select lib, c, a, list_transform(z, lambda t: t / sqrt(list_dot_product(z, z))), k + 1 from
  (select lib, c, a, k, list_transform(range(64), lambda i: y[i + 1] - list_dot_product(y, a) * a[i + 1]) as z from (select lib, c, a, k, {step} as y from second where k < 40)))
select lib as library_id, item_id, app, round(list_dot_product(d, a), 6) as px, round(list_dot_product(d, v), 6) as py from
 (select r.*, s.a, s.v, list_transform(range(64), lambda i: e[i + 1] - mean[i + 1]) as d from rows r join second s on s.lib = r.lib and s.k = 40 join means m on m.lib = r.lib)
"""


@query("emb9", plane_sql("library_id").replace("select lib as library_id, item_id", "select item_id"), ("items",))
def plane(lib: Library) -> DataFrame:
    return emb.pca_plane(items(lib)).select("item_id", "app", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query("emb9_libraries", plane_sql("item_id % 3"), ("items",))
def planes(lib: Library) -> DataFrame:
    """Three libraries, each with a plane of its own, their sums taken in parts of 50 items."""
    dealt = items(lib).withColumn("library_id", F.col("item_id") % 3)
    return emb.pca_plane(dealt, part=50).select("library_id", "item_id", "app", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query("emb10", """
select asset_id, nth, if(label % 4 = 0, app, null) as label from (select s.asset_id, v.app, v.label, row_number() over (order by creation_ts desc, asset_id) as nth
 from screens s join vectors v on v.vec_id = s.asset_id where is_screen_like and v.revision = 2) where nth <= 600
""", ("screens", "vectors"))
def map_sample(lib: Library) -> DataFrame:
    from shoebox.functions import scalars

    screens = lib.assets().filter(scalars.is_screen_like()).select("library_id", "asset_id", "creation_ts")
    seen = screens.join(lib.vectors().filter("revision = 2").select(F.col("vec_id").alias("asset_id"), "app", "label"), "asset_id")
    first = emb.map_sample(seen, 600)
    return first.select("asset_id", F.col("nth").cast("bigint").alias("nth"), F.when(F.col("label") % 4 == 0, F.col("app")).alias("label"))


@query("emb11", """
select app as name, count(*) as sample_count, 1::bigint as centroids from items group by app having count(*) >= 45
""", ("items",))
def library_build(lib: Library) -> DataFrame:
    built = emb.build_centroids(items(lib), min_samples=45)
    return built.groupBy("name", "sample_count").agg(F.count(F.lit(1)).alias("centroids"))


@query("emb11_mean", """
, m as (select app, i, avg(e[i + 1]) as m from items cross join range(64) t(i) group by app, i)
select app, i, round(m / sqrt(sum(m * m) over (partition by app)), 6) as value from m
""", ("items",))
def library_mean(lib: Library) -> DataFrame:
    means = emb.mean_vectors(items(lib), ["app"]).select("app", vectors.normalise("mean").alias("mean"))
    return means.select("app", F.posexplode("mean").alias("i", "v")).select("app", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("value"))


@query("emb12", """
select asset_id, category from candidates where asset_id not in (select item_id from matched where matched in ('app1', 'app5', 'app9'))
""", ("candidates", "matched"))
def policy_filter(lib: Library) -> DataFrame:
    named = emb.match_labels(items(lib), centroids(lib), LABEL_AT).select(F.col("item_id").alias("asset_id"), "label")
    keep = F.coalesce(F.col("label").isin("app1", "app5", "app9"), F.lit(False))
    return lib.candidates().join(named, "asset_id", "left").filter(~keep).select("asset_id", "category")


@query("hed1", "select item_id, c, round(probabilities[c + 1], 6) as p from probabilities cross join range(8) t(c)", ("probabilities",))
def softmax(lib: Library) -> DataFrame:
    rows = with_literal_softmax(items(lib)).select("item_id", F.posexplode("probabilities").alias("c", "p"))
    return rows.select("item_id", F.col("c").cast("bigint").alias("c"), F.round("p", 6).alias("p"))


def relabel_examples(lib: Library) -> DataFrame:
    """Corrections with the corrected picture's vector; the category index comes from the event."""
    vectors_of = lib.vectors().select(F.col("vec_id").alias("asset_id"), "embedding")
    fixes = lib.decisions().filter("action = 'relabel'").withColumn("target", (F.col("event_id") % len(LEARNABLE)).cast("int"))
    return fixes.join(vectors_of, "asset_id")


def swipe_examples(lib: Library) -> DataFrame:
    vectors_of = lib.vectors().select(F.col("vec_id").alias("asset_id"), "embedding")
    swipes = lib.decisions().filter("action in ('delete', 'keepOnce', 'whitelist')").withColumn("target", (F.col("action") == "delete").cast("int"))
    return swipes.join(vectors_of, "asset_id")


def softmax_models(lib: Library) -> DataFrame:
    return lib.keep("softmax-models", lambda: heads.train_softmax(relabel_examples(lib), ["library_id"], ["ts", "event_id"]))


def logistic_models(lib: Library) -> DataFrame:
    return lib.keep("logistic-models", lambda: heads.train_logistic(swipe_examples(lib), ["library_id"], ["ts", "event_id"]))


@query("hed2", """
select library_id, list_sum(n)::bigint as samples, round(sqrt(list_sum(list_transform(w, lambda c: list_dot_product(c, c)))), 6) as weight_norm, array_to_string(n, ',') as per_class
from relabel_fold where k > 0 qualify row_number() over (partition by library_id order by k desc) = 1
""", ("relabel_fold",))
def softmax_training(lib: Library) -> DataFrame:
    size = F.sqrt(F.aggregate(F.flatten("weights"), F.lit(0.0), lambda a, w: a + w * w))
    return softmax_models(lib).select("library_id", "samples", F.round(size, 6).alias("weight_norm"), F.array_join(F.transform("per_class", lambda n: n.cast("string")), ",").alias("per_class"))


@query("hed3", """
select library_id, count(*) as samples, count(*) >= 12 as warm, round(least(0.92::double, count(*) / 300.0::double), 6) as trust from decisions where action = 'relabel' group by library_id
""", ("decisions",))
def warmth(lib: Library) -> DataFrame:
    counts = lib.decisions().filter("action = 'relabel'").groupBy("library_id").agg(F.count(F.lit(1)).alias("samples"))
    return counts.select("library_id", "samples", heads.is_warm().alias("warm"), F.round(heads.trust(), 6).alias("trust"))


@query("hed3_margin", """
select item_id, round(s[1] / (s[1] + s[2]), 6) as margin from (select item_id, list_reverse_sort(probabilities) as s from probabilities)
""", ("probabilities",))
def margins(lib: Library) -> DataFrame:
    return with_literal_softmax(items(lib)).select("item_id", F.round(heads.margin(), 6).alias("margin"))


FUSE_ORACLE = """
, samples as (select item_id, (item_id * 3) % 400 as n, probabilities from probabilities),
rule as (select i.item_id, c.category, c.confidence, n, n >= 12 as warm, least(0.92::double, n / 300.0::double) as t, probabilities from samples i join candidates c on c.asset_id = i.item_id),
blend as (select r.*, l.name, if(l.name = r.category, r.confidence, 0) * (1 - t) + probabilities[l.c + 1] * t as v, probabilities[l.c + 1] as p from rule r cross join learnable l),
best as (select item_id, arg_max(name, (v, name)) as best, max(v) as bv, arg_max(name, (p, name)) as top from blend group by item_id)
select r.item_id, if(warm, best, category) as fused, round(if(warm, least(0.98::double, bv), confidence), 6) as fused_confidence, warm and best = top and best <> category as used_model
from rule r join best using (item_id)
"""


def fusion_input(lib: Library) -> DataFrame:
    rules = lib.candidates().select(F.col("asset_id").alias("item_id"), "category", "confidence")
    return with_literal_softmax(items(lib)).join(rules, "item_id").withColumn("samples", F.col("item_id") * 3 % 400)


@query("hed4", FUSE_ORACLE, ("probabilities", "candidates", "learnable"))
def fusion(lib: Library) -> DataFrame:
    return heads.fuse(fusion_input(lib)).select("item_id", "fused", F.round("fused_confidence", 6).alias("fused_confidence"), "used_model")


@query("hed5", "select item_id, round(score, 6) as score from logistic", ("logistic",))
def logistic(lib: Library) -> DataFrame:
    return with_literal_logistic(items(lib)).select("item_id", F.round("score", 6).alias("score"))


@query("hed6", """
select library_id, pos as positives, neg as negatives, round(b, 6) as bias, round(sqrt(list_dot_product(w, w)), 6) as weight_norm from swipe_models where k > 0
""", ("swipe_models",))
def logistic_training(lib: Library) -> DataFrame:
    size = F.sqrt(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w))
    return logistic_models(lib).select("library_id", "positives", "negatives", F.round("bias", 6).alias("bias"), F.round(size, 6).alias("weight_norm"))


@query("hed7", """
select library_id, p, n, p >= 8 and n >= 8 as warm, round(if(p >= 8 and n >= 8, least(0.6::double, (p + n) / 250.0::double), 0), 6) as influence from
 (select library_id, count_if(action = 'delete')::bigint as p, count_if(action in ('keepOnce', 'whitelist'))::bigint as n from decisions where action in ('delete', 'keepOnce', 'whitelist') group by library_id)
""", ("decisions",))
def influence(lib: Library) -> DataFrame:
    made = lib.decisions().filter("action in ('delete', 'keepOnce', 'whitelist')")
    counts = made.groupBy("library_id").agg(F.count_if(F.col("action") == "delete").alias("p"), F.count_if(F.col("action") != "delete").alias("n"))
    warm = (F.col("p") >= 8) & (F.col("n") >= 8)
    return counts.select("library_id", "p", "n", warm.alias("warm"), F.round(heads.influence(F.col("p"), F.col("n")), 6).alias("influence"))


@query("hed8", """
select asset_id, category, round(if(score is null, confidence, confidence * 0.6 + score * 0.4::double) * (0.55 + log2(greatest(byte_size, 65536) / 65536.0::double) / 10), 6) as priority
from candidates left join logistic on item_id = asset_id
""", ("candidates", "logistic"))
def ranking(lib: Library) -> DataFrame:
    scores = with_literal_logistic(items(lib)).select(F.col("item_id").alias("asset_id"), "score")
    ranked = lib.candidates().join(scores, "asset_id", "left")
    value = queue.priority(F.col("confidence"), F.col("byte_size"), F.col("score"), F.lit(0.4))
    return ranked.select("asset_id", "category", F.round(value, 6).alias("priority")).orderBy(F.desc("priority"), "asset_id")


@query("hed9")
def named_cluster_training(lib: Library) -> DataFrame:
    """Every app acts as a named cluster of the one library; six shuffled passes over its members."""
    members = items(lib).withColumn("target", (F.col("app_no") % len(LEARNABLE)).cast("int"))
    model = heads.train_on_members(members, ["library_id"])
    judged = heads.predict(members, model, ["library_id"])
    top = F.array_position("probabilities", F.array_max("probabilities")) - 1
    return judged.groupBy("target").agg(F.count(F.lit(1)).alias("members"), F.count_if(top == F.col("target")).alias("right"), F.max("samples").alias("steps"))


@query("hed10")
def reclassified(lib: Library) -> DataFrame:
    members = items(lib).withColumn("target", (F.col("app_no") % len(LEARNABLE)).cast("int"))
    model = heads.train_on_members(members, ["library_id"])
    rows = lib.candidates().join(items(lib).select(F.col("item_id").alias("asset_id"), "embedding"), "asset_id")
    return heads.reclassify(heads.predict(rows, model, ["library_id"])).select("asset_id", "category", F.round("confidence", 6).alias("confidence"), "changed")


@query("hed11", """
select library_id, p + n as samples, trunc(if(p >= 8 and n >= 8, least(0.6::double, (p + n) / 250.0::double), 0) * 100)::int as influence_percent, greatest(0, 8 - least(p, n)) as still_needed, r as corrections
from (select library_id, count_if(action = 'delete')::bigint as p, count_if(action in ('keepOnce', 'whitelist'))::bigint as n, count_if(action = 'relabel')::bigint as r from decisions where action <> 'undo' group by library_id)
""", ("decisions",))
def learning(lib: Library) -> DataFrame:
    return heads.learning_summary(lib.decisions(), ["library_id"])


@query("hed12", """
select c.asset_id, coalesce(l.name, c.category) as category from candidates c left join (select asset_id, arg_max(event_id % 8, (ts, event_id)) as k from decisions where action = 'relabel' group by asset_id) r using (asset_id)
left join learnable l on l.c = r.k
""", ("candidates", "decisions", "learnable"))
def corrected(lib: Library) -> DataFrame:
    names = F.array(*map(F.lit, LEARNABLE))
    fixes = lib.decisions().filter("action = 'relabel'").withColumn("corrected", F.element_at(names, (F.col("event_id") % len(LEARNABLE) + 1).cast("int")))
    return heads.apply_corrections(lib.candidates(), fixes.drop("library_id")).select("asset_id", "category")


@query("cls14", """
, samples as (select item_id, (item_id * 3) % 400 as n, probabilities from probabilities),
rule as (select i.item_id, c.category, c.confidence, n, n >= 12 as warm, least(0.92::double, n / 300.0::double) as t, probabilities from samples i join classified c on c.asset_id = i.item_id),
blend as (select r.*, l.name, if(l.name = r.category, r.confidence, 0) * (1 - t) + probabilities[l.c + 1] * t as v, probabilities[l.c + 1] as p from rule r cross join learnable l),
best as (select item_id, arg_max(name, (v, name)) as best, max(v) as bv, arg_max(name, (p, name)) as top from blend group by item_id),
f as (select r.*, if(warm, best, category) as fused, if(warm, least(0.98::double, bv), confidence) as fc, warm and best = top and best <> category as used from rule r join best using (item_id))
select item_id, if(used, fused, category) as category, round(if(used, fc, greatest(confidence, fc * 0.9)), 6) as confidence, used as used_model from f
""", ("probabilities", "classified", "learnable"))
def scan_fusion(lib: Library) -> DataFrame:
    rules = classified(lib).select(F.col("asset_id").alias("item_id"), "category", "confidence")
    rows = with_literal_softmax(items(lib)).join(rules, "item_id").withColumn("samples", F.col("item_id") * 3 % 400)
    return heads.fuse_in_scan(rows).select("item_id", "category", F.round("confidence", 6).alias("confidence"), "used_model")
