"""Approximate nearest neighbours by inner product: inverted lists scanned with adaptive dimension sampling.

Inner products become distances by one more component, sqrt(largest norm ** 2 - norm ** 2), that queries hold as zero. Vectors go to the list
of their nearest centroid; a query probes the lists nearest to it. Inside a list all vectors are turned by one random
rotation, so that any first d of D components are a fair sample: a candidate is read in column blocks, and given up as soon as its
partial distance, scaled up by D / d, exceeds the k-th best so far by more than chance allows (a test at ``epsilon`` standard
deviations). Whoever survives all blocks is measured on the original vectors in double precision.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors), every vector is indexed. How many lists to probe is measured: for
``CALIBRATION`` sampled queries the exact neighbours among all vectors are found, and the least number of lists is taken that holds
``TARGET`` of them; a query goes on to further lists until those it visits hold k others. Equal vectors are one entry with the k + 1 smallest ids. Lists stand on shelves of about ``SHELF`` vectors, a larger list on
several; a query visits a shelf once for all its lists there, nearest first. The queries of a shelf come in teams of about ``TEAM``, so
no task holds more than a shelf and a team.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import first_by_hash, materialize
from shoebox.operators.distributed import top_k

SAMPLE, CALIBRATION, TARGET = 16_384, 128, 0.97
LIST_SIZE, MAX_LISTS, SHELF, TEAM, SEEDS = 512, 4096, 16_384, 1024, 256
BLOCK, EPSILON = 16, 2.1
ROUNDS = 8


@dataclass
class Index:
    centroids: np.ndarray
    norm: float  # the largest of all vectors
    probes: int = 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) without vectors that are null, empty, all zero or hold a null or non-finite component."""
    fine = "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").filter("vec_id is not null and embedding is not null").filter(fine)


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the component that turns inner products into distances."""
    return np.hstack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1), 0.0))[:, None]])


def lifted_queries(q: np.ndarray, norm: float) -> np.ndarray:
    """Queries at the length of the vectors: only their direction matters for the order."""
    q = q * (norm / np.maximum(np.linalg.norm(q, axis=1), 1e-300))[:, None]
    return np.hstack([q, np.zeros((len(q), 1))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None, :]


def fit(sample: np.ndarray, total: int, norm: float) -> Index:
    """Centroids by Lloyd's iteration over the sample."""
    x = lifted(sample, norm)
    lists = int(np.clip(total // LIST_SIZE, 1, min(MAX_LISTS, max(1, len(x) // 4))))
    rng = np.random.default_rng(11)
    centroids = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([_distances(x[i : i + 2048], centroids).argmin(axis=1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=lists)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return Index(centroids, norm)


def rotation(n: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(23).normal(size=(n, n)))[0]


def column_blocks(x: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(x[:, at : at + BLOCK]) for at in range(0, x.shape[1], BLOCK)]


def adaptive_scan(blocks: list[np.ndarray], rows: np.ndarray, q: np.ndarray, k: int, epsilon: float = EPSILON) -> np.ndarray:
    """Of ``rows`` of the rotated vectors, nearest list first, those that may be among the k nearest of ``q``. The first rows are read
    whole and give the first bound.
    """
    if len(rows) <= 2 * k:
        return rows
    parts = [q[at : at + BLOCK] for at in range(0, len(q), BLOCK)]
    seeds = sum(((x[rows[:SEEDS]] - p) ** 2).sum(axis=1) for x, p in zip(blocks, parts, strict=True))
    bound = np.partition(seeds, k - 1)[k - 1]
    alive, partial, read = rows, np.zeros(len(rows)), 0
    for x, p in zip(blocks, parts, strict=True):
        near = x[alive] - p
        partial = partial + np.einsum("ij,ij->i", near, near)
        read += len(p)
        chance = (1 + epsilon / np.sqrt(read)) ** 2 * read / len(q) if read < len(q) else 1 + 1e-9
        keep = partial <= bound * chance
        alive, partial = alive[keep], partial[keep]
    if len(alive) > k:
        bound = np.partition(partial, k - 1)[k - 1]
        alive = alive[partial <= bound * (1 + 1e-9) + 1e-12]
    return alive


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _exact(rows: DataFrame, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """For each of a few queries its k nearest of all rows, as vectors: each task sends its k best, which are merged here."""

    def run(frames):
        kept = [(np.zeros(0), np.zeros((0, queries.shape[1])))] * len(queries)
        for frame in frames:
            x = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
            scores = queries @ x.T
            for i, (s, v) in enumerate(kept):
                near = np.argpartition(-scores[i], k - 1)[:k] if len(x) > k else np.arange(len(x))
                s, v = np.concatenate([s, scores[i][near]]), np.vstack([v, x[near]])
                top = np.argsort(-s, kind="stable")[:k]
                kept[i] = s[top], v[top]
        if any(len(s) for s, _ in kept):
            yield pd.DataFrame([(i, float(a), b.tolist()) for i, (s, v) in enumerate(kept) for a, b in zip(s, v, strict=True)], columns=["q", "score", "embedding"])

    found = rows.select("embedding").mapInPandas(run, "q int, score double, embedding array<double>")
    out = [[] for _ in queries]
    for r in top_k(found, ["q"], [F.col("score").desc()], k).collect():
        out[r["q"]].append(r["embedding"])
    return [np.array(v) for v in out]


def build(entries: DataFrame, total: int, k: int) -> Index:
    norm = entries.select(F.max(F.expr("aggregate(embedding, 0D, (a, x) -> a + double(x) * x)"))).first()[0] ** 0.5
    some = first_by_hash(entries, ["vec_id"], F.lit(total), SAMPLE).orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = np.array([r["embedding"] for r in some.select("embedding").limit(SAMPLE).collect()], dtype=np.float64)
    index = fit(sample, total, norm)
    lists = len(index.centroids)
    if lists > 1:
        queries = sample[:CALIBRATION]
        order = _distances(lifted_queries(queries, norm), index.centroids).argsort(axis=1)
        place = np.argsort(order, axis=1)
        needed = [place[i, _distances(lifted(v, norm), index.centroids).argmin(axis=1)] for i, v in enumerate(_exact(entries, queries, k))]
        index.probes = int(np.quantile(np.concatenate(needed), TARGET, method="higher")) + 1
    return index


def nearest_vectors(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) whose id ``every`` divides, its ``k`` rows of largest
    inner product found among all others, nearest first, ties to the smaller id.

    Vectors that are null, empty, all zero, or hold a null or non-finite component take no part. Vectors of different lengths have no
    inner product; each length is searched by itself. Repeated rows count once. Empty tables give no rows; other columns
    are ignored.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors).distinct(), "ann-rows")
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for dims in sorted(r["d"] for r in rows.select(F.size("embedding").alias("d")).distinct().collect()):
        out = out.unionByName(_of_length(rows.filter(F.size("embedding") == dims), dims, k, every))
    return out


def shelves(sizes: dict[int, int], lists: int) -> tuple[list[int], list[int]]:
    """For each list its first shelf and how many it takes; small lists share a shelf, in order."""
    first, pieces, shelf, held = [0] * lists, [0] * lists, 0, 0
    for i in range(lists):
        n = sizes.get(i, 0)
        if held and held + n > SHELF:
            shelf, held = shelf + 1, 0
        first[i], pieces[i] = shelf, max(1, -(-n // SHELF))
        shelf, held = shelf + pieces[i] - 1, held + n if pieces[i] == 1 else SHELF
    return first, pieces


def _of_length(rows: DataFrame, dims: int, k: int, every: int) -> DataFrame:
    spark = rows.sparkSession
    first = top_k(rows, ["embedding"], [F.col("vec_id")], k + 1)
    entries = first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("vec_id", F.col("ids")[0])
    entries = materialize(entries, "ann-entries")
    asked = rows.filter(F.col("vec_id") % every == 0)
    queries = materialize(asked.groupBy("embedding").agg(F.min("vec_id").alias("qid")), "ann-queries")
    index = build(entries, entries.count(), k)
    turn = rotation(dims + 1)

    def assign(frames):
        for frame in frames:
            x = lifted(np.stack(frame["embedding"].to_numpy()).astype(np.float64), index.norm)
            yield frame.assign(list=_distances(x, index.centroids).argmin(axis=1).astype("int32"))

    filed = materialize(entries.mapInPandas(assign, "embedding array<float>, ids array<bigint>, vec_id bigint, list int"), "ann-lists")
    sizes = {r["list"]: r["count"] for r in filed.groupBy("list").count().collect()}  # at most MAX_LISTS rows
    held = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])
    first, pieces = shelves(sizes, len(index.centroids))
    places = F.broadcast(spark.createDataFrame([(i, first[i], pieces[i]) for i in sizes], "list int, first int, pieces int"))
    shelved = filed.join(places, "list").withColumn("shelf", F.expr("first + cast(pmod(xxhash64(vec_id), pieces) as int)"))

    def probe(frames):
        for frame in frames:
            q = lifted_queries(np.stack(frame["embedding"].to_numpy()).astype(np.float64), index.norm)
            near = _distances(q, index.centroids).argsort(axis=1)
            # on to further lists until those visited hold k rows besides the query's own
            enough = 1 + (np.cumsum(held[near], axis=1) < k + 1).sum(axis=1)
            visits = []
            for n, lists in enumerate([own[: max(index.probes, m)].tolist() for own, m in zip(near, enough, strict=True)]):
                by_shelf: dict[int, list[int]] = {}
                for own in lists:
                    for shelf in range(first[own], first[own] + pieces[own]):
                        by_shelf.setdefault(shelf, []).append(own)
                visits += [(n, shelf, own) for shelf, own in by_shelf.items()]
            rows, shelf, lists = zip(*visits, strict=True)
            yield frame.iloc[list(rows)].assign(shelf=np.array(shelf, dtype="int32"), lists=list(lists))

    asking = materialize(queries.mapInPandas(probe, "embedding array<float>, qid bigint, shelf int, lists array<int>"), "ann-probes")
    teams = asking.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / TEAM).cast("int").alias("teams"))
    teams = materialize(teams, "ann-teams")
    left = shelved.join(teams, "shelf").select("shelf", F.explode(F.expr("sequence(0, teams - 1)")).alias("team"), "list", "vec_id", "ids", "embedding")
    right = asking.join(teams, "shelf").select("shelf", F.expr("cast(pmod(xxhash64(qid), teams) as int)").alias("team"), "qid", "lists", "embedding")

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asked):
            own = own.sort_values("list", kind="stable")
            vec_ids, lists = own["vec_id"].to_numpy(), own["list"].to_numpy()
            starts = {k: np.arange(*np.searchsorted(lists, [k, k + 1])) for k in np.unique(lists).tolist()}
            original = np.stack(own["embedding"].to_numpy()).astype(np.float64)
            questions = np.stack(asked["embedding"].to_numpy()).astype(np.float64)
            blocks, q = column_blocks(lifted(original, index.norm) @ turn), lifted_queries(questions, index.norm) @ turn
            ids = own["ids"].to_list()
            for i, (qid, visited) in enumerate(zip(asked["qid"], asked["lists"], strict=True)):
                rows = [starts[k] for k in visited if k in starts]
                if not rows:
                    continue
                alive = adaptive_scan(blocks, np.concatenate(rows), q[i], k + 1)
                scores = np.array([np.dot(questions[i], original[j]) for j in alive])
                top = _best(vec_ids[alive], scores, k + 1)
                several = [(qid, int(v), scores[t]) for t in top for v in ids[alive[t]]]
                several.sort(key=lambda r: (-r[2], r[1]))
                found += several[: k + 1]
        return pd.DataFrame(found, columns=["qid", "vec_id", "score"])

    keys = ["shelf", "team"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "qid bigint, vec_id bigint, score double")
    best = materialize(top_k(near, ["qid"], [F.col("score").desc(), F.col("vec_id")], k + 1).drop("rank"), "ann-best")
    whose = asked.join(queries, "embedding").select(F.col("vec_id").alias("query_id"), "qid")
    found = whose.join(best, "qid").filter("vec_id <> query_id")
    return top_k(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
