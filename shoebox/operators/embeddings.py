"""Embedding vectors: label matching, leader clustering, projection, naming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from shoebox.functions import fixed, vectors
from shoebox.operators.distributed import attach, owned, top_k
from shoebox.session import materialize, materialize_counted

MERGE_THRESHOLD = 0.93
LABEL_THRESHOLD = 0.90
MAX_CLUSTERS = 400  # what the app shows; more are counted as overflow
BLOCK, LEADERS, FAN = 1024, 4096, 8  # items of a block, leaders of a pass, blocks of a group
TEAM, CHUNK = 4096, 4096  # items and centroids of one block of the label match
STRIP = 256  # rows of a product held at once

MAP_PART = 50_000  # items whose products one task adds up

# Shape, generator seed and shifts of the projection matrix.
PROJECTED, FULL = 64, 768
XORSHIFT_SEED = 0x9E3779B97F4A7C15
XORSHIFT = (13, 7, 17)


_computed: dict[str, np.ndarray] = {}


def projection_matrix() -> np.ndarray:
    """The fixed-seed matrix: 64 unit rows of 768 xorshift64 draws, computed once per process."""
    if "matrix" in _computed:
        return _computed["matrix"]
    mask, state, draws = (1 << 64) - 1, XORSHIFT_SEED, np.empty(PROJECTED * FULL)
    left, right, last = XORSHIFT
    for i in range(draws.size):
        state ^= (state << left) & mask
        state ^= state >> right
        state ^= (state << last) & mask
        draws[i] = (state >> 11) / (1 << 53) - 0.5
    rows = draws.reshape(PROJECTED, FULL)
    return _computed.setdefault("matrix", rows / np.linalg.norm(rows, axis=1, keepdims=True))


def project(block: np.ndarray) -> np.ndarray:
    """Rows of 768 values to unit rows of 64; any other width passes through."""
    if block.shape[1] != FULL:
        return block
    out = block @ projection_matrix().T
    return out / np.sqrt(np.maximum((out * out).sum(axis=1, keepdims=True), 1e-9))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def _units(column: pd.Series) -> np.ndarray:
    rows = _matrix(column)
    return rows / np.where((n := np.linalg.norm(rows, axis=1)) > 0, n, 1)[:, None]


def projected(items: DataFrame, column: str = "embedding") -> DataFrame:
    """Adds ``projected``, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), STRIP):
                part = pdf.iloc[at : at + STRIP]
                yield part.assign(projected=list(project(_matrix(part[column]))))

    return items.mapInPandas(run, StructType([*items.schema.fields, StructField("projected", ArrayType(DoubleType()))]))


# --- label matching -----------------------------------------------------------------------------


def _repeated(rows: DataFrame, keys: list[str], times: str, out: str) -> DataFrame:
    """``rows`` once per number below ``times``, in two steps with a shuffle between: no task makes all copies of a row."""
    side = F.ceil(F.sqrt(F.col(times))).cast("int")
    high = rows.withColumn("_side", side).withColumn("_high", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / F.col("_side")).cast("int"))))
    low = F.sequence(F.col("_high") * F.col("_side"), F.least(F.col(times), (F.col("_high") + 1) * F.col("_side")) - 1)
    return high.repartition(*keys, "_high").withColumn(out, F.explode(low)).drop("_side", "_high")


def _places(numbers: pd.Series) -> list[np.ndarray]:
    """Where each number stands, in rising order."""
    order = np.argsort(numbers.to_numpy(), kind="stable")
    return np.split(order, np.flatnonzero(np.diff(numbers.to_numpy()[order])) + 1)


def _label_blocks(items: DataFrame, centroids: DataFrame, keep: tuple[str, ...], team: int, chunk: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Items and centroids dealt for ``best_labels``, with their team or chunk, and the keys of what meets in one task."""
    key = ["library_id", "revision", "dim"]
    mine = items.select("library_id", "item_id", *keep, "revision", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dim"), "embedding")
    theirs = centroids.select("library_id", "revision", F.coalesce(F.size("centroid"), F.lit(-1)).alias("dim"), "name", "centroid").filter("dim > 0")
    sizes = mine.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(theirs.groupBy(*key).agg(F.count(F.lit(1)).alias("c")), key, "left")
    plan = sizes.select(*key, "n", F.ceil(F.col("n") / team).cast("int").alias("teams"), F.greatest(F.lit(1), F.ceil(F.coalesce("c", F.lit(0)) / chunk)).cast("int").alias("chunks"))
    together = {"teams": max(1, TEAM // team), "chunks": max(1, CHUNK // chunk)}
    plan = materialize(plan.select("*", *[F.ceil(F.col(c) / n).cast("int").alias(f"{c}_at") for c, n in together.items()]), "label-blocks")
    left = attach(mine, plan, key, "n").withColumn("team", F.pmod(F.xxhash64("item_id"), F.col("teams")).cast("int"))
    left = left.withColumn("team_at", F.floor(F.col("team") / together["teams"]).cast("int")).withColumn("chunk_at", F.explode(F.sequence(F.lit(0), F.col("chunks_at") - 1)))
    right = theirs.join(plan.drop("n"), key).withColumn("chunk", F.pmod(F.xxhash64("name", "centroid"), F.col("chunks")).cast("int"))
    right = _repeated(right.withColumn("chunk_at", F.floor(F.col("chunk") / together["chunks"]).cast("int")), [*key, "chunk_at"], "teams_at", "team_at")
    plans = ("teams", "chunks", "teams_at", "chunks_at")
    return left.drop(*plans), right.drop(*plans), [*key, "team_at", "chunk_at"]


def best_labels(items: DataFrame, centroids: DataFrame, keep: tuple[str, ...] = (), team: int = TEAM, chunk: int = CHUNK) -> DataFrame:
    """Each item's most similar label of its library: (library_id, item_id, *keep, label, similarity), by cosine over the label's centroids of the
    same revision and length. Equal similarities (to twelve places) go to the smaller name; an item without anything to compare with has nulls.

    items: library_id, item_id, embedding, revision, and the scalar columns in ``keep``. centroids: library_id, name, revision, centroid.
    A matrix product in blocks: a library's items are dealt into teams of about ``team``, its centroids into chunks of about ``chunk``. A
    task multiplies as many neighbouring blocks one by one as hold about ``TEAM`` items and ``CHUNK`` centroids, so small blocks copy no more rows than
    large ones. Only the best of a task's chunks leaves it, so no pair is ever a row and no vector is
    joined back; what a task holds does not depend on the sizes of the tables.
    """
    left, right, blocks = _label_blocks(items, centroids, keep, team, chunk)

    def multiply(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = asked[["library_id", "item_id", *keep]].copy()
        out["label"], out["similarity"] = None, np.nan
        if len(asked) and len(known):
            # names in rising order: argmax takes the first of equal similarities, the smallest name
            known = known.sort_values("name", kind="stable")
            chunks = [(at, _units(known["centroid"].iloc[at])) for at in _places(known["chunk"])]
            best, near = np.zeros(len(asked), dtype=np.int64), np.full(len(asked), -np.inf)
            for own in _places(asked["team"]):
                for part in (own[i : i + STRIP] for i in range(0, len(own), STRIP)):
                    units = _units(asked["embedding"].iloc[part])
                    for at, theirs in chunks:
                        cosine = np.round(units @ theirs.T, 12)
                        first, value = at[cosine.argmax(axis=1)], cosine.max(axis=1)
                        better = (value > near[part]) | (value == near[part]) & (first < best[part])
                        best[part], near[part] = np.where(better, first, best[part]), np.where(better, value, near[part])
            out["label"], out["similarity"] = known["name"].to_numpy()[best], near
        return out

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.select("library_id", "item_id", *keep).schema)
    met = left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInPandas(multiply, f"{kinds}, label string, similarity double")
    found = F.when(F.col("label").isNotNull(), F.struct((-F.col("similarity")).alias("less"), "label"))
    best = met.groupBy("library_id", "item_id", *keep).agg(F.min(found).alias("best"))
    return best.select("library_id", "item_id", *keep, "best.label", (-F.col("best.less")).alias("similarity"))


def match_labels(items: DataFrame, centroids: DataFrame, threshold: float = LABEL_THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every item's (library_id, item_id, *keep) with ``label`` and ``similarity``, null where nothing reaches the threshold."""
    near = F.col("similarity") >= threshold
    best = best_labels(items, centroids, keep)
    return best.select("library_id", "item_id", *keep, F.when(near, F.col("label")).alias("label"), F.when(near, F.col("similarity")).alias("similarity"))


# --- leader clustering ----------------------------------------------------------------------------


class Leaders:
    """State of one sequential pass: exact and projected centroids, counts. Bounded by the ceiling."""

    def __init__(self, threshold: float, ceiling: int):
        self.threshold, self.ceiling = threshold, ceiling
        self.full: list[np.ndarray] = []
        self.small: np.ndarray | None = None
        self.counts: list[float] = []

    def place(self, vector: np.ndarray, small: np.ndarray, weight: float = 1.0) -> tuple[int, float]:
        """(cluster, similarity when it joined); cluster -1 once the ceiling is reached."""
        n = len(self.full)
        if n:
            sims = self.small[:n] @ small
            best = int(sims.argmax())
            if sims[best] >= self.threshold:
                count = self.counts[best]
                merged = (self.full[best] * count + vector * weight) / (count + weight)
                length = np.linalg.norm(merged)
                self.full[best] = merged / length if length > 0 else merged
                self.small[best] = project(self.full[best][None, :])[0]
                self.counts[best] = count + weight
                return best, float(sims[best])
        if n >= self.ceiling:
            return -1, 0.0
        if self.small is None or n == len(self.small):
            grown = np.zeros((max(64, 2 * n), len(small)))
            if n:
                grown[:n] = self.small
            self.small = grown
        self.full.append(vector)
        self.small[n] = small
        self.counts.append(weight)
        return n, 1.0


def leader_pass(items: DataFrame, keys: list[str], order: list[str], threshold: float | str = MERGE_THRESHOLD, ceiling: int = LEADERS) -> DataFrame:
    """The exact, order-dependent pass within each key. ``threshold`` is one for all, or the name of a key that holds it.

    A key's rows stream through its task in order, batch by batch; what a task holds is the leaders,
    at most ``ceiling``. Rows: kind 'member' (item_id, cluster, similarity, weight) and
    kind 'leader' (cluster, centroid, weight).
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.select(*keys).schema)

    def run(key, batches):
        state = Leaders(key[keys.index(threshold)] if isinstance(threshold, str) else threshold, ceiling)
        for pdf in batches:
            full = _matrix(pdf["embedding"])
            small = project(full)
            placed = [state.place(full[i], small[i], w) for i, w in enumerate(pdf["weight"].to_numpy())]
            out = pdf[["item_id", "weight"]].copy()
            out["cluster"] = np.array([c for c, _ in placed], dtype=np.int32)
            out["similarity"] = [s for _, s in placed]
            out["kind"], out["centroid"] = "member", None
            for name, value in zip(keys, key):
                out[name] = value
            yield out[[*keys, "kind", "item_id", "cluster", "similarity", "weight", "centroid"]]
        if state.full:
            out = pd.DataFrame({"cluster": np.arange(len(state.full), dtype=np.int32), "weight": state.counts, "centroid": [list(v) for v in state.full]})
            out["kind"], out["item_id"], out["similarity"] = "leader", -1, 1.0
            for name, value in zip(keys, key):
                out[name] = value
            yield out[[*keys, "kind", "item_id", "cluster", "similarity", "weight", "centroid"]]

    run.__annotations__ = {"key": tuple, "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    rows = items if "weight" in items.columns else items.withColumn("weight", F.lit(1.0))
    ready = rows.select(*keys, *[c for c in order if c not in ("item_id", *keys)], "item_id", "embedding", "weight")
    # the grouped map keeps this order: it needs no more than the keys clustered and sorted
    ordered = ready.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = f"{kinds}, kind string, item_id bigint, cluster int, similarity double, weight double, centroid array<double>"
    return ordered.groupBy(*keys).applyInPandas(run, schema)


def leader_levels(items: DataFrame, keys: list[str], threshold: float | str = MERGE_THRESHOLD, ceiling: int = LEADERS, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """One rule at every size: (items with their cluster, clusters).

    A key's items are dealt into blocks of about ``block`` by a hash of their id. The ordered pass finds each block's leaders; the leaders of
    ``fan`` blocks go through the same pass, the best supported first, then those of ``fan`` such groups, until one group is left. Blocks and groups
    run in parallel, and none holds more than ``block`` items or ``fan`` times ``ceiling`` leaders. An item is in the cluster that its
    block's leader ended in, its similarity the least of the joins that led there. A key of one block gets the plain ordered pass.
    What found no place under the ``ceiling`` of a pass on the way has cluster -1. Items: keys, item_id, cluster, similarity. Clusters: keys, cluster,
    weight (how many items), centroid.
    """
    sizes = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.withColumn("parts", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    dealt = attach(items, blocks, keys, "n").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("bigint"))
    number = F.col("part") * ceiling + F.col("cluster")
    row = [*keys, "parts", "part", "cluster", "weight", "centroid"]
    passed, seen = materialize_counted(leader_pass(dealt, [*keys, "parts", "part"], ["item_id"], threshold, ceiling), "leaders", parts=F.max("parts"))
    leaders = passed.filter("kind = 'leader'").select(*row)
    line = leaders.select(*keys, "parts", number.alias("first"), F.col("weight").alias("n"), number.alias("at"), F.lit(1.0).alias("loosest"))
    parts = seen["parts"] or 1
    fewer = F.ceil(F.col("parts") / F.lit(fan)).cast("int").alias("parts")
    while parts > 1:
        # keys with one part left are done and stay as they are
        seeds = leaders.filter("parts > 1").select(*keys, fewer, F.floor(F.col("part") / fan).alias("part"), number.alias("item_id"), F.col("centroid").alias("embedding"), "weight", (-F.col("weight")).alias("light"))
        merged = materialize(leader_pass(seeds, [*keys, "parts", "part"], ["light", "item_id"], threshold, ceiling), "merged-leaders")
        moved = merged.filter("kind = 'member' and cluster >= 0").select(*keys, F.col("item_id").alias("at"), number.alias("to"), F.col("similarity").alias("met"))
        going = line.filter("parts > 1").join(moved, [*keys, "at"], "left").select(*keys, fewer, "first", "n", F.coalesce("to", F.lit(-1)).alias("at"), F.least("loosest", F.coalesce("met", F.lit(0.0))).alias("loosest"))
        line = line.filter("parts = 1").unionByName(going)
        leaders = materialize(leaders.filter("parts = 1").unionByName(merged.filter("kind = 'leader'").select(*row)), "level-leaders")
        parts = -(-parts // fan)
    members = passed.filter("kind = 'member'").select(*keys, "item_id", F.when(F.col("cluster") >= 0, number).otherwise(-1).alias("first"), "similarity")
    placed = attach(members.filter("first >= 0"), line.drop("parts"), [*keys, "first"], "n")
    placed = placed.select(*keys, "item_id", F.col("at").cast("int").alias("cluster"), F.least("similarity", "loosest").alias("similarity"))
    lost = members.filter("first < 0").select(*keys, "item_id", F.lit(-1).alias("cluster"), F.lit(0.0).alias("similarity"))
    return placed.unionByName(lost), leaders.select(*keys, "cluster", "weight", "centroid")


def clusters_and_centroids(items: DataFrame, keys: list[str], threshold: float | str = MERGE_THRESHOLD, ceiling: int = LEADERS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``leader_levels`` until every item has a cluster: what found no place is clustered again, its clusters numbered from the next
    multiple of the ceiling. Each pass places the items of up to ``ceiling`` clusters, at least one, so it ends.
    """
    rest, placed, found, base = items, None, None, 0
    while True:
        now, clusters = leader_levels(rest, keys, threshold, ceiling, block)
        now, seen = materialize_counted(now, "cluster-pass", left=F.count_if(F.col("cluster") < 0))
        mine = now.filter("cluster >= 0").withColumn("cluster", F.col("cluster") + F.lit(base))
        clusters = clusters.withColumn("cluster", F.col("cluster") + F.lit(base))
        placed, found = (mine, clusters) if placed is None else (placed.union(mine), found.union(clusters))
        if not seen["left"]:
            return placed, found
        left = now.filter("cluster < 0").select(*keys, "item_id")
        rest = materialize(rest.join(left, [*keys, "item_id"], "left_semi"), "cluster-rest")
        base += ceiling


def comparable(items: DataFrame) -> DataFrame:
    """Items of the current revision: vectors of another one mean something else."""
    return items.filter(F.col("revision") == fixed.EMBEDDING_REVISION) if "revision" in items.columns else items


def leader_clusters(items: DataFrame, threshold: float = MERGE_THRESHOLD, ceiling: int = LEADERS, block: int = BLOCK) -> DataFrame:
    """Clusters per library: (library_id, item_id, cluster, similarity), for every item of the current revision."""
    return clusters_and_centroids(comparable(items), ["library_id"], threshold, ceiling, block)[0]


def cluster_summary(assigned: DataFrame, bytes_of: DataFrame) -> DataFrame:
    """Clusters of two or more: size, bytes, cohesion (the loosest member when it joined)."""
    rows = assigned.filter("cluster >= 0").join(bytes_of, ["library_id", "item_id"], "left")
    return rows.groupBy("library_id", "cluster").agg(
        F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"), F.min("similarity").alias("cohesion")
    ).filter("size >= 2")


def overflow(assigned: DataFrame, ceiling: int = MAX_CLUSTERS) -> DataFrame:
    """Items that the first ``ceiling`` clusters had no place for, per library; they are in later clusters."""
    return assigned.groupBy("library_id").agg(F.count_if(F.col("cluster") >= ceiling).alias("overflow"), F.count(F.lit(1)).alias("items"))


def label_then_cluster(items: DataFrame, centroids: DataFrame, label_threshold: float = LABEL_THRESHOLD, merge_threshold: float = MERGE_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(labelled items, clusters of the rest)."""
    labelled = materialize(match_labels(items, centroids, label_threshold).filter("label is not null"), "label-matches")
    return labelled, leader_clusters(items.join(labelled, ["library_id", "item_id"], "left_anti"), merge_threshold)


# --- labels ---------------------------------------------------------------------------------------


def name_clusters(labels: DataFrame, centroids: DataFrame, namings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies namings (name, category, sample_count, revision, centroid, seq) to the label store.

    Names are trimmed and blank ones ignored. A taken name gains the centroid and the samples, and an
    empty category is filled by the first one given; a new name becomes a new label. Where all three tables have ``library_id``, names are
    each library's own.
    """
    given = namings.withColumn("name", F.regexp_replace("name", r"^\s+|\s+$", "")).filter("name <> ''")
    keys = owned(labels, "name") if "library_id" in namings.columns else ["name"]
    both = labels.select(*keys, "category", "sample_count", F.lit(-1).cast("bigint").alias("seq")).union(
        given.select(*keys, "category", "sample_count", "seq")
    )
    first_category = F.min_by("category", F.when(F.col("category").isNotNull(), F.col("seq")))
    merged = both.groupBy(*keys).agg(first_category.alias("category"), F.sum("sample_count").alias("sample_count"))
    return merged, centroids.select(*keys, "revision", "centroid").union(given.select(*keys, "revision", "centroid"))


def label_policies(edits: DataFrame) -> DataFrame:
    """State of each label after its edit log (name, at, seq, field, value).

    Turning one preference on turns the other off; a delete removes the label, and a
    later edit of a deleted label has nothing to change.
    """
    on = F.col("value")
    field = F.col("field")
    moment = F.struct("at", "seq")
    sets = lambda mine, other: F.when(field == mine, on).when((field == other) & on, False)
    last = lambda v: F.max_by(v, F.when(v.isNotNull(), moment))
    state = edits.groupBy("name").agg(
        F.coalesce(last(sets("preferDelete", "preferKeep")), F.lit(False)).alias("prefer_delete"),
        F.coalesce(last(sets("preferKeep", "preferDelete")), F.lit(False)).alias("prefer_keep"),
        F.bool_or(field == "delete").alias("deleted"),
    )
    return state.filter(~F.col("deleted")).drop("deleted")


def build_centroids(items: DataFrame, min_samples: int = 8, threshold: float = MERGE_THRESHOLD, ceiling: int = LEADERS, block: int = BLOCK) -> DataFrame:
    """Centroid library from vectors sorted by app: (name, sample_count, revision, centroid).

    Apps below ``min_samples`` are skipped; an app's clusters of two or more give its centroids; an
    app without such clusters gets its normalised mean.
    """
    sizes = items.groupBy("app").agg(F.count(F.lit(1)).alias("sample_count")).filter(F.col("sample_count") >= min_samples)
    enough = items.join(sizes.select("app"), "app", "left_semi")
    found = clusters_and_centroids(enough, ["app"], threshold, ceiling, block)[1]
    clusters = found.filter("weight >= 2").select("app", "centroid")
    rest = enough.join(clusters.select("app").distinct(), "app", "left_anti")
    centroids = clusters.union(mean_vectors(rest, ["app"]).select("app", vectors.normalise("mean")))
    return sizes.join(centroids, "app").select(F.col("app").alias("name"), "sample_count", F.lit(fixed.EMBEDDING_REVISION).alias("revision"), "centroid")


def mean_vectors(items: DataFrame, keys: list[str]) -> DataFrame:
    """Mean per key: each Arrow batch gives one sum per key it holds, the sums of a key are then added up."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.select(*keys).schema)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False, dropna=False)
            rows = [(*key, len(part), _matrix(part["embedding"]).sum(axis=0).tolist()) for key, part in groups]
            yield pd.DataFrame(rows, columns=[*keys, "n", "total"])

    partial = items.select(*keys, "embedding").mapInPandas(sums, f"{kinds}, n bigint, total array<double>")
    added = partial.groupBy(*keys).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("total")).alias("totals"))
    total = F.expr("aggregate(slice(totals, 2, size(totals)), totals[0], (a, b) -> zip_with(a, b, (x, y) -> x + y))")
    return added.select(*keys, F.transform(total, lambda x: x / F.col("n")).alias("mean"))


def pca_plane(items: DataFrame, iterations: int = 40, keys: tuple[str, ...] = ("library_id",), part: int = MAP_PART) -> DataFrame:
    """Adds ``px`` and ``py``: coordinates on the two leading principal axes of the item's library (of all items, if ``items`` has none of ``keys``).

    A library's items are dealt into parts of about ``part``, whose sums and products stream into one matrix per part. The rows
    of those matrices are added up by number, so what a task gathers is one row of each part; a library's matrix (dimension x dimension, whatever
    the number of items) then gets its power iterations, from a fixed start, so the map does not reshuffle. Vectors of other lengths, and
    libraries with fewer than three items, have zeros.
    """
    whose = [k for k in keys if k in items.columns]
    rows = items.withColumn("_dim", F.coalesce(F.size("embedding"), F.lit(-1)))
    group = [*whose, "_dim"]
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    parts = sizes.filter("_dim > 0").withColumn("_parts", F.ceil(F.col("_n") / part).cast("int"))
    dealt = attach(rows.select(*group, "embedding"), parts, group, "_n").withColumn("_part", F.pmod(F.xxhash64("embedding"), F.col("_parts")).cast("int"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*group).schema)

    def products(key, batches):
        n, total, square = 0, 0.0, 0.0
        for pdf in batches:
            block = _matrix(pdf["embedding"])
            n, total, square = n + len(block), total + block.sum(axis=0), square + block.T @ block
        out = pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "n": n, "total": total, "line": list(square)})
        for at, name in enumerate(group):
            out.insert(at, name, key[at])
        yield out

    def add(key, batches):
        n, total, line = 0, 0.0, 0.0
        for pdf in batches:
            n, total, line = n + int(pdf["n"].sum()), total + pdf["total"].sum(), line + _matrix(pdf["line"]).sum(axis=0)
        yield pd.DataFrame([(*key, n, total, line)], columns=[*group, "i", "n", "total", "line"])

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n, mean = int(pdf["n"].iloc[0]), pdf["total"].to_numpy() / pdf["n"].iloc[0]
        found = []
        if n >= 3:
            covariance = _matrix(pdf["line"]) / n - np.outer(mean, mean)
            unit = lambda x: x / size if (size := np.linalg.norm(x)) > 0 else x
            for _ in range(2):
                x = unit(np.sin(np.arange(len(mean)) * 0.7) + 0.31)
                for _ in range(iterations):
                    y = covariance @ x
                    for a in found:
                        y = y - (y @ a) * a
                    x = unit(y)
                found.append(x)
        out = pdf[group].head(1).copy()
        for name in ("x", "y"):
            out[f"_{name}"] = [found.pop(0)] if found else None
        out["_mean"] = [mean]
        return out

    for fn in (products, add):
        fn.__annotations__ = {"key": tuple, "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    lines = dealt.groupBy(*group, "_part").applyInPandas(products, f"{kinds}, i int, n bigint, total double, line array<double>")
    summed = lines.groupBy(*group, "i").applyInPandas(add, f"{kinds}, i int, n bigint, total double, line array<double>")
    plane = summed.groupBy(*group).applyInPandas(axes, f"{kinds}, _x array<double>, _y array<double>, _mean array<double>")
    per_library = sizes.join(plane, group, "left")
    offset = F.zip_with("embedding", "_mean", lambda v, m: v - m)
    placed = attach(rows, per_library, group, "_n").withColumn("_offset", offset)
    return placed.select(*items.columns, *[F.when(F.col(f"_{a}").isNotNull(), vectors.dot("_offset", f"_{a}")).otherwise(0.0).alias(f"p{a}") for a in "xy"])


def map_sample(seen: DataFrame, size: int = 600) -> DataFrame:
    """The first ``size`` items of each library in scan order (newest first, then by id), numbered ``nth``: what the map shows."""
    return top_k(seen, ["library_id"], [F.desc("creation_ts"), F.col("asset_id")], size, "nth")
