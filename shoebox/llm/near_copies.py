"""Near copies by five-word shingles: Jaccard similarity of at least 4/5, verified exactly on the shingle sets.

A text is the set of its shingles' hashes; equal sets are one node. Candidates first come from SimHash by segment popcounts (``simhash``): the
fingerprints of the shingles, linked at ``DISTANCE`` bits, form components, and those of a component are tried. Edits of a few words
soon change more bits than that, so candidates also share a band of MinHash values: ``BANDS`` bands of
``ROWS`` minima each, so a pair at similarity s is tried with chance 1 - (1 - s ** ROWS) ** BANDS: 0.9994 at 0.8 and more above, but
0.15 at 0.5. A node that shares a band also has a sketch, ``PLANES`` bits of each of ``SKETCH`` further minima. Two sets of similarity 4/5 agree in at
least ``AGREE`` of them but for a chance of about 3 in a million, and sets of similarity 0.7 hardly ever do; so pairs that agree in fewer are
settled where they meet, in the condition of the join, and a large group that stays below 4/5 gives no rows. No candidate counts without
the exact test.

A bucket is what shares a band, or a component of fingerprints. Each node of a bucket is first tried against the bucket's least and greatest nodes, which gathers dense groups with a
number of trials linear in their size; only nodes outside a bucket's largest group so far are then tried against all nodes
of other groups in the bucket, each pair in the first bucket the two share. Two nodes of one group need no trial, as their link adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm import simhash
from shoebox.llm.common import dealt_for, drop_written, map_arrow, materialize
from shoebox.operators.components import connected_components

WIDTH, SEED = 5, 42
BANDS, ROWS = 40, 8
SKETCH, PLANES, AGREE = 1024, 4, 775  # 4.5 standard deviations below what a similarity of 4/5 gives
FEWEST = 4  # sets of fewer shingles reach 4/5 only with equal ones
SHINGLES_AT_ONCE = 1 << 13


def hashed(text: str | None) -> np.ndarray:
    """The hashes of a text's five-word shingles, repeats included; a text of fewer words is one shingle, without words none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts, last = [0, *(ends[:-1] + 1).tolist()], ends[WIDTH - 1 :].tolist() or [int(ends[-1])]
    return np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, last, strict=False)], dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles in order."""
    return np.unique(hashed(text))


def digest(own: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    x = xxh3_64_intdigest(own.tobytes())
    return x - (1 << 64) if x >> 63 else x


class Minima:
    """The least of a set's hashes under each of ``n`` functions."""

    def __init__(self, n: int, seed: int = SEED):
        self.rng = np.random.default_rng(seed)
        self.factors = self.rng.integers(0, 1 << 64, (n, 1), dtype=np.uint64) | np.uint64(1)

    def of(self, own: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(own), SHINGLES_AT_ONCE):
            np.minimum(least, (own[None, at : at + SHINGLES_AT_ONCE] * self.factors).min(axis=1), out=least)
        return least


class Bands(Minima):
    """The keys of a set's bands."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        super().__init__(bands * rows)
        self.shape = bands, rows
        self.seeds = self.rng.integers(0, 1 << 64, bands, dtype=np.uint64)

    def keys(self, own: np.ndarray) -> list[int]:
        if len(own) < FEWEST:
            return []
        out = self.seeds.copy()
        for minima in self.of(own).reshape(self.shape).T:
            out = (out ^ minima) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(31)
        return out.view(np.int64).tolist()


class Sketches(Minima):
    """``PLANES`` bits of each minimum, plane by plane in words of 64."""

    def __init__(self):
        super().__init__(SKETCH, SEED + 1)

    def sketch(self, own: np.ndarray) -> list[int]:
        least = self.of(own)
        mixed = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bits = (mixed[None, :] >> np.arange(60, 60 + PLANES, dtype=np.uint64)[:, None]) & np.uint64(1)
        return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64).ravel().tolist()


def agreeing(a: str, b: str) -> str:
    """SQL: in how many minima two sketches agree."""
    words = SKETCH // 64
    differ = [" | ".join(f"({a}[{p * words + i}] ^ {b}[{p * words + i}])" for p in range(PLANES)) for i in range(words)]
    return f"{SKETCH} - " + " - ".join(f"bit_count({d})" for d in differ)


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, row, node, n, bits, keys) of every row (doc_id, row, text): the digest of its set, the set's size, the fingerprint of its
    shingles and its band keys (none for sets too small to have near copies that are not equal).
    """

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        bands = Bands()
        for rows in slices:
            sets, bits = [], []
            for text in rows["text"].to_pylist():
                every = hashed(text)
                sets.append(np.unique(every))
                bits.append(simhash.majority(every))
            yield pa.table({
                "doc_id": rows["doc_id"], "row": rows["row"], "node": pa.array([digest(s) for s in sets], "int64"), "n": pa.array([len(s) for s in sets], "int32"),
                "bits": pa.array(np.array(bits, dtype=np.uint64).view(np.int64)),
                "keys": pa.array([bands.keys(s) for s in sets], pa.list_(pa.int64())),
            })

    return map_arrow(docs.select("doc_id", "row", "text"), run, "doc_id bigint, row bigint, node bigint, n int, bits bigint, keys array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, own, sketch): the sets themselves and their sketches."""

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        sketches = Sketches()
        for rows in slices:
            sets = [shingles(t) for t in rows["text"].to_pylist()]
            own = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            sketch = pa.array([sketches.sketch(s) for s in sets], pa.list_(pa.int64()))
            yield pa.table({"node": pa.array([digest(s) for s in sets], "int64"), "own": own, "sketch": sketch})

    return map_arrow(docs.select("text"), run, "node bigint, own array<bigint>, sketch array<bigint>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose sets have a Jaccard similarity of at least 4/5."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
    return both.filter("9 * size(array_intersect(own_a, own_b)) >= 4 * (size(own_a) + size(own_b))").select(pairs.columns)


def with_families(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, bits, keys, ...) with one key more: the component of its fingerprint, by the links of SimHash. Nodes without keys keep none."""
    prints = materialize(nodes.filter("size(keys) > 0").select("bits").distinct(), "copies-prints")
    families = materialize(simhash.linked_nodes(prints).filter("bits <> label"), "copies-families")
    family = F.xxhash64(F.lit("family"), F.coalesce("label", "bits"))
    keys = F.when(F.size("keys") > 0, F.concat("keys", F.array(family))).otherwise(F.col("keys"))
    return nodes.join(families, "bits", "left").withColumn("keys", keys).drop("label")


def in_buckets(nodes: DataFrame, count: int) -> DataFrame:
    """(node, n, band, key, low, high): every one of ``count`` nodes in each of its buckets that hold more than one, with the bucket's least and
    greatest nodes. The join is told to sort, as Spark sizes the spread nodes too low and would broadcast them.
    """
    cells = dealt_for(nodes.select("node", "n", "keys"), count, BANDS + 1, "node").select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = cells.groupBy("key").agg(F.min(F.struct("node", "n")).alias("low"), F.max(F.struct("node", "n")).alias("high")).filter("low.node < high.node")
    return cells.join(shared.hint("merge"), "key")


def linked_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) for each of ``nodes`` (node, n, row, keys) that shares a bucket; equal labels within a component."""
    placed = materialize(in_buckets(nodes, nodes.count()), "copies-cells")
    ends = materialize(placed.select("node").distinct(), "copies-nodes")
    whose = nodes.join(ends, "node", "left_semi").select("row")
    sets = materialize(shingle_sets(docs.join(whose, "row", "left_semi").dropDuplicates(["row"])), "copies-sets")
    sketches = materialize(nodes.select("node", "keys").join(sets.select("node", "sketch"), "node"), "copies-sketches")

    tried = None
    for center in ("low", "high"):
        rows = placed.filter(f"node <> {center}.node and 5 * least(n, {center}.n) >= 4 * greatest(n, {center}.n)")
        rows = rows.select(F.least("node", f"{center}.node").alias("a"), F.greatest("node", f"{center}.node").alias("b"))
        tried = rows if tried is None else tried.unionByName(rows)
    one, two = (sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    tried = materialize(tried.distinct().join(one, "a").join(two, "b").filter(f"{agreeing('sketch_a', 'sketch_b')} >= {AGREE}").select("a", "b"), "copies-stars")
    links = materialize(similar(tried, sets), "copies-star-links")
    first = materialize(connected_components(links, "a", "b").select("node", "label"), "copies-first")

    own = placed.select("key", "band", "node", "n").join(first, "node", "left").select("key", "band", "node", "n", F.coalesce("label", "node").alias("label"))
    own = materialize(own, "copies-members")
    main = own.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    mixed = materialize(own.join(main.filter("labels > 1"), "key").drop("labels").join(sketches, "node"), "copies-mixed")
    rest = mixed.filter("label <> main").drop("main")
    other = mixed.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "label", "main", "keys", "sketch")])
    # both in the rest: met once, from the lesser node; and only in the first bucket that the two share
    once = "(label_b = main_b or node < node_b) and array_position(zip_with(keys, keys_b, (x, y) -> x = y), true) = band + 1"
    apart = f"label <> label_b and 5 * least(n, n_b) >= 4 * greatest(n, n_b) and {agreeing('sketch', 'sketch_b')} >= {AGREE}"
    pairs = rest.join(other.withColumnRenamed("key", "key_b"), F.expr(f"key = key_b and {apart} and {once}"))
    swapped = F.col("node") > F.col("node_b")
    ordered = [F.when(swapped, F.col(y)).otherwise(F.col(x)).alias(z) for x, y, z in (("node", "node_b", "a"), ("node_b", "node", "b"), ("label", "label_b", "at_a"), ("label_b", "label", "at_b"))]
    pairs = materialize(pairs.select(*ordered).join(tried, ["a", "b"], "left_anti"), "copies-pairs")
    links = materialize(similar(pairs, sets).select("at_a", "at_b").distinct(), "copies-links")
    joined = connected_components(links, "at_a", "at_b").select(F.col("node").alias("label"), F.col("label").alias("root"))
    labels = ends.join(first, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    labels = materialize(labels.join(joined, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "copies-roots")
    drop_written(placed, ends, sets, sketches, tried, first, own, mixed, pairs, links)
    return labels


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links of similarity 4/5 or more lead to, its own included. Texts without words are
    linked with each other. Repeated rows come back as often; a null doc_id belongs to its component but is never its
    smallest id, unless it has no other. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    marked = materialize(marks(docs), "copies-marks")
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("n").alias("n"), F.min("bits").alias("bits"), F.first("keys").alias("keys"))
    plain = materialize(nodes, "copies-sets-of")
    nodes = materialize(with_families(plain), "copies-with-families")
    drop_written(plain)
    labels = nodes.select("node", "least").join(linked_nodes(docs, nodes), "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    labels = materialize(labels, "copies-labels")
    drop_written(nodes)
    ids = labels.join(labels.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    return marked.select("doc_id", "node").join(ids, "node").select("doc_id", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less those with a smaller doc_id in their component; of repeated rows one stays. Rows without a
    doc_id stay."""
    found = near_copies(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.filter("doc_id is null").unionByName(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).join(found, "doc_id", "left_semi").select(docs.columns))
