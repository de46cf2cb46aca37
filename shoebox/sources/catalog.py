"""Asset catalogs and the tables kept between scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import fixed, scalars

# stands for "no date known"
DISTANT_PAST = "0001-01-01 00:00:00"


def scan(catalog: DataFrame, source_types: tuple[str, ...] = fixed.SCANNED_SOURCES) -> DataFrame:
    """Visible assets of the scanned source types."""
    return catalog.filter(~F.col("is_hidden") & F.col("source_type").isin(*source_types))


def newest_first(assets: DataFrame) -> DataFrame:
    return assets.orderBy(F.desc("creation_ts"), "asset_id")


def snapshot(raw: DataFrame, undated: str = DISTANT_PAST) -> DataFrame:
    """Fills in dates and the edit flag. An asset whose resources were not read counts as unedited."""
    past = F.lit(undated).cast("timestamp")
    return (
        raw.withColumn("creation_ts", F.coalesce("creation_ts", "modification_ts", past))
        .withColumn("modification_ts", F.coalesce("modification_ts", past))
        .withColumn("has_adjustments", F.coalesce(F.col("resources_read") & F.col("adjusted"), F.lit(False)))
    )


def capture_ts(exif: str, modified: str) -> Column:
    """The EXIF text as a timestamp; without one the file's time; the epoch when neither is usable."""
    epoch = F.timestamp_seconds(F.lit(0))
    return F.when(
        F.col(exif).isNotNull(), F.coalesce(F.try_to_timestamp(F.col(exif), F.lit("yyyy:MM:dd HH:mm:ss")), epoch)
    ).otherwise(F.coalesce(F.col(modified), epoch))


def folder_scan(spark: SparkSession, path: str, extensions: tuple[str, ...] = fixed.IMAGE_EXTENSIONS) -> DataFrame:
    """Files of the given extensions, whatever their case, from metadata alone (contents are not read)."""
    pattern = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in e) for e in extensions) + "}"
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    )
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "path",
        F.col("length").alias("byte_size"), F.col("modificationTime").alias("modification_ts"),
    )


def exact_sizes(resources: DataFrame, shown: DataFrame) -> DataFrame:
    """Sum of resource sizes, only for the assets about to be shown."""
    return (
        resources.join(shown.select("asset_id").distinct(), "asset_id", "left_semi")
        .groupBy("asset_id").agg(F.sum("bytes").alias("exact_bytes")).filter("exact_bytes > 0")
    )


def refine_sizes(assets: DataFrame, sizes: DataFrame) -> DataFrame:
    return assets.join(sizes, "asset_id", "left").withColumn("byte_size", F.coalesce("exact_bytes", "byte_size")).drop("exact_bytes")


def missing_fingerprints(assets: DataFrame, cache: DataFrame, version: int = fixed.FINGERPRINT_VERSION) -> DataFrame:
    """Ids of images without a fingerprint of the current version."""
    current = current_version(cache, version)
    return assets.filter(~F.col("is_video")).select("asset_id").join(current.select("asset_id"), "asset_id", "left_anti")


def merge_fingerprints(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """New rows win over cached ones."""
    return fresh.unionByName(cache.join(fresh.select("asset_id"), "asset_id", "left_anti"))


def prune(cached: DataFrame, living: DataFrame) -> DataFrame:
    """Cached rows whose asset still exists."""
    return cached.join(living.select("asset_id"), "asset_id", "left_semi")


def current_version(cache: DataFrame, version: int) -> DataFrame:
    return cache.filter(F.col("version") == version)


def same_revision(rows: DataFrame, revision: int = fixed.EMBEDDING_REVISION) -> DataFrame:
    return rows.filter(F.col("revision") == revision)


def write_centroids(entries: DataFrame, path: str) -> None:
    """Centroid library, one row per centroid: name, category, sample_count, revision, centroid.

    The long form keeps a label with very many centroids splittable.
    """
    entries.filter(F.size("centroid") > 0).write.mode("overwrite").parquet(path)


def read_centroids(spark: SparkSession, path: str, revision: int = fixed.EMBEDDING_REVISION) -> DataFrame:
    """Nothing when the library was built with another revision."""
    return same_revision(spark.read.parquet(path), revision)


def seed_labels(existing: DataFrame, library: DataFrame) -> DataFrame:
    """Adds the library's labels under names not taken yet."""
    return existing.unionByName(library.join(existing.select("name"), "name", "left_anti"))
