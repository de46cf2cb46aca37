"""SimHash near-duplicates by a segment-popcount embedding.

A text's 64-bit fingerprint is the bitwise majority of the hashes of its word shingles. A fingerprint is embedded as the vector of
its bit counts over 32 segments of two bits. Flipping one bit moves one count by one, so the Manhattan distance of two vectors never exceeds
the Hamming distance of their fingerprints. Written in thermometer code (0, 1, 2 as 00, 01, 11) the vector is again one
64-bit word, and the Manhattan distance of two of them is the bit count of their exclusive or.

Vectors within ``distance`` of each other are found by a grid: the coordinates are dealt into ``blocks``, each pair in range agrees
on all but ``distance`` of the blocks, and a cell of the grid is one choice of that many blocks with their coordinates.
Cells are joined under the Manhattan bound; what passes is verified on the fingerprints.

Equal fingerprints are one node. In each cell every node is first tried against the cell's least fingerprint, which
gathers dense groups with a number of trials linear in their size; only nodes outside a cell's largest group so far are then
tried against all nodes of the cell. Nothing is left out: two nodes of one group need no trial, as their link adds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import dealt_for, map_arrow, materialize
from shoebox.operators.components import connected_components

DISTANCE, SHINGLE, SEED = 4, 4, 42
LEAST_BLOCKS, MOST_BLOCKS, CHANCE_PARTNERS = 8, 14, 100
EVEN = 0x5555555555555555
SHINGLES_AT_ONCE = 1 << 17


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The bits set in over half of the shingles' hashes; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    n = max(1, len(words) - width + 1)
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        upto = min(n, at + SHINGLES_AT_ONCE)
        last = [ends[-1]] if len(words) < width else ends[at + width - 1 : upto + width - 1]
        hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at:upto], last, strict=True)], dtype="<u8")
        bits += _set_bits(hashes)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles by their hashes, as in ``fingerprint``."""
    parts = range(0, len(hashes), SHINGLES_AT_ONCE)
    bits = sum((_set_bits(hashes[at : at + SHINGLES_AT_ONCE]) for at in parts), np.zeros(64, dtype=np.int64))
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, bits) of every whole text; ``bits`` is the fingerprint as a signed 64-bit integer."""

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            found = np.array([fingerprint(t, width) for t in rows["text"].to_pylist()], dtype=np.uint64)
            yield pa.table({"doc_id": rows["doc_id"], "bits": found.view(np.int64)})

    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id bigint, bits bigint")


def embedded(bits: str) -> Column:
    """The per-segment bit counts of a fingerprint in thermometer code."""
    return F.expr(f"(({bits} | shiftrightunsigned({bits}, 1)) & {EVEN}L) | shiftleft({bits} & shiftrightunsigned({bits}, 1) & {EVEN}L, 1)")


def blocks_for(nodes: int, distance: int = DISTANCE) -> int:
    """The least number of blocks at which a fingerprint meets at most ``CHANCE_PARTNERS`` others by chance. Any number finds the
    same pairs; more blocks mean more cells per fingerprint, with fewer fingerprints in each.
    """
    least = max(LEAST_BLOCKS, distance + 1)
    for blocks in range(least, MOST_BLOCKS):
        agree = 32 * (blocks - distance) / blocks  # coordinates of a cell; two random ones agree with chance 3/8
        if nodes * math.comb(blocks, distance) * (3 / 8) ** agree <= CHANCE_PARTNERS:
            return blocks
    return max(least, MOST_BLOCKS)


def cell_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """For each choice of blocks - distance blocks, the bits of their coordinates, as signed 64-bit integers."""
    own = [sum(3 << 2 * int(s) for s in part) for part in np.array_split(np.arange(32), blocks)]
    return [x - (1 << 64) if x >> 63 else x for x in (sum(c) for c in combinations(own, blocks - distance))]


def within_grid(nodes: DataFrame, count: int, distance: int, blocks: int) -> DataFrame:
    """(cell, place, bits, center): every one of ``count`` nodes in each of its grid cells that hold more than one, with the cell's least fingerprint.

    Spark takes the spread nodes for as few bytes as the nodes themselves and would send them to every task by way of the driver, so the join is told to sort.
    """
    masks = F.array(*[F.lit(m) for m in cell_masks(blocks, distance)])
    placed = dealt_for(nodes, count, math.comb(blocks, distance), "bits").select("bits", embedded("bits").alias("counts")).select("bits", "counts", F.posexplode(masks).alias("cell", "mask"))
    placed = placed.select("cell", (F.col("counts").bitwiseAND(F.col("mask"))).alias("place"), "bits")
    shared = placed.groupBy("cell", "place").agg(F.min("bits").alias("center"), F.max("bits").alias("_most")).filter("center < _most").drop("_most")
    return placed.join(shared.hint("merge"), ["cell", "place"])


def _near(a: str, b: str, distance: int) -> Column:
    """In range by the Manhattan bound first, then exactly."""
    counts = lambda x: embedded(x)
    return (F.bit_count(counts(a).bitwiseXOR(counts(b))) <= distance) & (F.bit_count(F.expr(f"{a} ^ {b}")) <= distance)


def linked_nodes(nodes: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """(bits, label) for each distinct fingerprint that has a link; equal labels within a component."""
    count = nodes.count()
    placed = materialize(within_grid(nodes, count, distance, blocks or blocks_for(count, distance)), "simhash-cells")
    stars = placed.filter((F.col("bits") != F.col("center")) & _near("bits", "center", distance)).select("bits", "center").distinct()
    first = materialize(connected_components(stars, "bits", "center").select(F.col("node").alias("bits"), "label"), "simhash-first")
    own = placed.join(first, "bits", "left").select("cell", "place", "bits", F.coalesce("label", "bits").alias("label"))
    own = materialize(own, "simhash-members")
    main = own.groupBy("cell", "place", "label").count().groupBy("cell", "place").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    rest = own.join(main.filter("labels > 1"), ["cell", "place"]).filter("label <> main")
    other = own.select("cell", "place", F.col("bits").alias("bits_b"), F.col("label").alias("label_b"))
    pairs = rest.join(other, (rest.cell == other.cell) & (rest.place == other.place) & (F.col("label") != F.col("label_b")) & _near("bits", "bits_b", distance))
    joined = connected_components(materialize(pairs.select("label", "label_b").distinct(), "simhash-links"), "label", "label_b")
    joined = joined.select(F.col("node").alias("label"), F.col("label").alias("root"))
    ends = pairs_nodes(first, placed)
    return ends.join(joined, "label", "left").select("bits", F.coalesce("root", "label").alias("label"))


def pairs_nodes(first: DataFrame, placed: DataFrame) -> DataFrame:
    """Every node that shares a cell, with its label after the first pass."""
    return placed.select("bits").distinct().join(first, "bits", "left").select("bits", F.coalesce("label", "bits").alias("label"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int | None = None, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links of at most ``distance`` differing bits lead to, its own included.
    Null and blank texts have fingerprint zero and are linked like any other. Repeated rows come back as often; a null
    doc_id belongs to its component but is never its smallest id, unless it has no other. An empty table gives no
    rows; other columns are ignored.
    """
    marked = materialize(fingerprints(docs, width), "simhash-marks")
    nodes = materialize(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    labels = nodes.join(linked_nodes(nodes, distance, blocks), "bits", "left").select("bits", "least", F.coalesce("label", "bits").alias("label"))
    labels = materialize(labels, "simhash-labels")
    ids = labels.join(labels.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("bits", "component_id")
    return marked.join(ids, "bits").select("doc_id", F.format_string("%016x", "bits").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` less those with a smaller doc_id in their component; of repeated rows one stays. Rows without a
    doc_id stay."""
    found = near_duplicates(docs, **how).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.filter("doc_id is null").unionByName(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).join(found, "doc_id", "left_semi").select(docs.columns))
