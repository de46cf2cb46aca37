"""Pass 1: the same picture stored more than once.

Assets collapse to *signatures* (equal content, size and hashes) before anything is joined, so a
picture stored a billion times is one row here; its members are counted by partial
aggregation. Near copies are then searched among distinct hash pairs only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions import bits, scalars
from shoebox.functions.fixed import TIERS
from shoebox.operators.components import connected_components
from shoebox.operators.distributed import attach, hot_keys, owned, shared
from shoebox.session import materialize

SIGNATURE = ["library_id", "content_hash", "pixel_width", "pixel_height", "dhash", "phash", "is_screen_like"]
HASHES = ["library_id", "shape", "dhash", "phash"]


def images(assets: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Non-video assets that have a fingerprint, with the derived columns grouping needs."""
    prints = fingerprints.select(*owned(fingerprints, "asset_id"), "dhash", "phash", "sharpness")
    return scalars.with_derived(assets.filter(~F.col("is_video"))).join(prints, shared(assets, prints, "asset_id"))


def signatures(image_rows: DataFrame) -> DataFrame:
    """One row per signature: ``node`` (its least asset id) and ``copies``."""
    return (
        image_rows.groupBy(*SIGNATURE)
        .agg(F.min("asset_id").alias("node"), F.count(F.lit(1)).alias("copies"))
        .withColumn("shape", scalars.shape_key())
    )


def band_join(nodes: DataFrame, block: list[str], max_d: int, max_p: int, crowded: int = 5_000) -> DataFrame:
    """Pairs of nodes (a < b) in one block that share a dHash band *and* a pHash band.

    With ``max_d + 1`` and ``max_p + 1`` bands, no pair within both distances is missed. The join
    key holds one band of each hash, so a crowded dHash band (flat black frames, say)
    is split by pHash bits. A pair that meets on several keys is kept on the first
    only, which needs no distinct. Buckets with more than ``crowded`` nodes are split again by longer
    pHash keys, three bands of ``max_p + 3``, which no near pair misses either; of such
    buckets only the pairs agreeing on a long key come out.
    """
    d_bands, p_bands = max_d + 1, max_p + 1
    keys = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), dv.alias("dv"), pv.alias("pv"))
        for i, dv in enumerate(bits.band_values("dhash", d_bands))
        for j, pv in enumerate(bits.band_values("phash", p_bands))
    ]
    bucket = [*block, "i", "j", "dv", "pv"]
    keyed = nodes.select(*block, "node", "dhash", "phash", F.explode(F.array(*keys)).alias("k")).select(
        *block, "node", "dhash", "phash", "k.*"
    )
    first_d = bits.first_equal(bits.band_values("da", d_bands), bits.band_values("db", d_bands))
    first_p = bits.first_equal(bits.band_values("pa", p_bands), bits.band_values("pb", p_bands))

    def pairs(rows: DataFrame, on: list[str]) -> DataFrame:
        left = rows.select(*on, F.col("node").alias("a"), F.col("dhash").alias("da"), F.col("phash").alias("pa"))
        right = rows.select(*on, F.col("node").alias("b"), F.col("dhash").alias("db"), F.col("phash").alias("pb"))
        return left.join(right, on).filter("a < b").filter((first_d == F.col("i")) & (first_p == F.col("j")))

    found = [*block, "a", "b", "da", "db", "pa", "pb"]
    crowds = hot_keys(keyed, bucket, "crowded-buckets", crowded)
    if crowds is None:
        return pairs(keyed, bucket).select(*found)
    long_keys = bits.choice_keys("phash", max_p + 3, 3)
    split = keyed.join(crowds, bucket, "left_semi").select(*bucket, "node", "dhash", "phash", F.explode(long_keys).alias("c")).select(
        *bucket, "node", "dhash", "phash", "c.*"
    )
    close = pairs(split, [*bucket, "choice", "bits"]).filter(F.col("choice") == bits.first_choice("pa", "pb", max_p + 3, 3))
    return pairs(keyed.join(crowds, bucket, "left_anti"), bucket).select(*found).union(close.select(*found))


def hash_nodes(signature_rows: DataFrame) -> DataFrame:
    """Distinct hash pairs per library and shape among photographs: the near-copy search space."""
    return signature_rows.filter(~F.col("is_screen_like")).groupBy(*HASHES).agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))


def candidate_pairs(signature_rows: DataFrame, max_d: int = 2, max_p: int = 4) -> DataFrame:
    """Pairs of distinct photographs within both distances, and what these are."""
    pairs = band_join(hash_nodes(signature_rows), ["library_id", "shape"], max_d, max_p)
    near = pairs.select(
        "library_id", "a", "b",
        scalars.hamming("da", "db").alias("d"), scalars.hamming("pa", "pb").alias("p"),
    )
    # the definition of a candidate, whichever keys a bucket was joined on
    return near.filter((F.col("d") <= max_d) & (F.col("p") <= max_p))


def bucket_sizes(hash_rows: DataFrame, hash_col: str = "dhash", bands: int = 8) -> DataFrame:
    """Distinct hashes per (band, value) bucket of a multi-index hash, combined map-side."""
    buckets = F.array(*[F.struct(F.lit(i).alias("band"), v.alias("value")) for i, v in enumerate(bits.band_values(hash_col, bands))])
    return (
        hash_rows.select("library_id", hash_col).distinct()
        .select("library_id", F.explode(buckets).alias("k"))
        .groupBy("library_id", F.col("k.band").alias("band"), F.col("k.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("members"))
    )


def identical_edges(signature_rows: DataFrame) -> DataFrame:
    """Star edges between signatures of equal content and size (their hashes differ)."""
    keys = ["library_id", "content_hash", "pixel_width", "pixel_height"]
    hubs = signature_rows.groupBy(*keys).agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (
        signature_rows.join(hubs, keys).filter("node <> hub")
        .select("library_id", F.col("hub").alias("src"), F.col("node").alias("dst"), F.lit(TIERS["identical"]).alias("tier"))
    )


def copy_edges(signature_rows: DataFrame, max_d: int = 2, max_p: int = 4) -> DataFrame:
    """Near-copy edges between photographs of one shape: d <= max_d and p <= max_p.

    Equal hash pairs are linked by a star; the band join runs over distinct hash pairs. Both give
    the components, and the component tiers, of the full pair list.
    """
    hubs = materialize(hash_nodes(signature_rows), "hash-nodes")
    several = hubs.filter("n > 1").select(*HASHES, F.col("node").alias("hub"), "n")
    stars = (
        attach(signature_rows.filter(~F.col("is_screen_like")), several, HASHES, "n")
        .filter("node <> hub")
        .select("library_id", F.col("hub").alias("src"), F.col("node").alias("dst"), F.lit(TIERS["copy"]).alias("tier"))
    )
    near = (
        band_join(hubs, ["library_id", "shape"], max_d, max_p)
        .filter((scalars.hamming("da", "db") <= max_d) & (scalars.hamming("pa", "pb") <= max_p))
    )
    content = ["content_hash", "pixel_width", "pixel_height"]
    sides = signature_rows.select("library_id", "node", F.struct(*content).alias("content"))
    same = F.col("ca") == F.col("cb")
    near = (
        near.join(sides.toDF("library_id", "a", "ca"), ["library_id", "a"]).join(sides.toDF("library_id", "b", "cb"), ["library_id", "b"])
        .select(
            "library_id", F.col("a").alias("src"), F.col("b").alias("dst"),
            F.when(same, TIERS["identical"]).otherwise(TIERS["copy"]).alias("tier"),
        )
    )
    return stars.union(near)


def copy_labels(signature_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(library_id, node, label, tier) for every signature in a group of two or more assets.

    A group's tier is the loosest of its edges; a lone signature with copies is identical.
    """
    labels = connected_components(edges, keys=("library_id",))
    tiers = edges.withColumnRenamed("src", "node").join(labels, ["library_id", "node"]).groupBy("library_id", "label").agg(F.max("tier").alias("tier"))
    grouped = labels.join(tiers, ["library_id", "label"]).select("library_id", "node", "label", "tier")
    lone = signature_rows.filter("copies > 1").join(grouped, ["library_id", "node"], "left_anti")
    return grouped.union(lone.select("library_id", "node", F.col("node").alias("label"), F.lit(TIERS["identical"])))


def copy_members(image_rows: DataFrame, signature_rows: DataFrame, labels: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """(library_id, group_key, tier, asset_id) of every asset in a copy group."""
    named = signature_rows.join(labels, ["library_id", "node"]).select(*SIGNATURE, "copies", F.col("label").alias("group_key"), "tier")
    return attach(image_rows, named, SIGNATURE, "copies", bound).select("library_id", "group_key", "tier", "asset_id")


def video_members(assets: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """Videos equal in bytes, tenths of a second and size: exact groups by metadata."""
    keys = ["library_id", "byte_size", "tenths", "pixel_width", "pixel_height"]
    videos = assets.filter(F.col("is_video") & (F.col("byte_size") > 0)).withColumn(
        "tenths", (F.col("duration") * 10).cast("bigint")
    )
    repeated = videos.groupBy(*keys).agg(F.min("asset_id").alias("group_key"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return attach(videos, repeated, keys, "n", bound).select("library_id", "group_key", F.lit(TIERS["identical"]).alias("tier"), "asset_id")


def find_copies(assets: DataFrame, fingerprints: DataFrame, max_d: int = 2, max_p: int = 4) -> DataFrame:
    """Pass 1 from assets and fingerprints to members. Signatures and edges are read several times, so they are written once."""
    rows = images(assets, fingerprints)
    sigs = materialize(signatures(rows), "signatures")
    edges = materialize(identical_edges(sigs).union(copy_edges(sigs, max_d, max_p)), "copy-edges")
    return copy_members(rows, sigs, copy_labels(sigs, edges))
