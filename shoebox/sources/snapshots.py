"""Caches as versions: a folder per write, and a manifest that makes it the current one.

``root/data/<id>`` holds the rows of a version and ``root/manifests/<number>`` names it. Rows are written first; the manifest is written beside
its place and renamed into it, which is one step of the file system and fails if another writer was first. A reader takes the
manifest with the highest number. A write that dies on the way leaves a folder no manifest names: the old version stays readable, and
``clean`` removes the rest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shoebox.session import materialize_counted
from shoebox.sources import catalog


class Conflict(RuntimeError):
    """Another writer made the version this one was about to make."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in _names(spark, f"{root}/manifests") if n.isdigit())


def _manifest(spark: SparkSession, root: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{root}/manifests/{number:012d}", wholetext=True).first()[0])


def current(spark: SparkSession, root: str) -> tuple[int, dict] | None:
    """(number, manifest) of the current version."""
    numbers = _numbers(spark, root)
    return (numbers[-1], _manifest(spark, root, numbers[-1])) if numbers else None


def read(spark: SparkSession, root: str) -> DataFrame | None:
    found = current(spark, root)
    if found is None:
        return None
    return spark.read.schema(StructType.fromJson(found[1]["schema"])).parquet(f"{root}/data/{found[1]['folder']}")


def _commit(spark: SparkSession, root: str, number: int, manifest: dict) -> None:
    fs, place = _fs(spark, f"{root}/manifests/{number:012d}")
    _, beside = _fs(spark, f"{root}/manifests/{number:012d}.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(beside, place):
        fs.delete(beside, False)
        raise Conflict(f"version {number} of {root} exists")


def write(df: DataFrame, root: str, base: int | None = None) -> int:
    """Writes ``df`` as the version after ``base`` (default: after the current one) and makes it current."""
    spark = df.sparkSession
    number = (base if base is not None else (_numbers(spark, root) or [0])[-1]) + 1
    folder = uuid.uuid4().hex
    df.write.parquet(f"{root}/data/{folder}")
    _commit(spark, root, number, {"folder": folder, "schema": json.loads(df.schema.json())})
    return number


def clean(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Removes all but the last ``keep`` versions and what dead writes left; the names of the folders removed. For one writer at a time."""
    numbers = _numbers(spark, root)
    kept = {f"{n:012d}" for n in numbers[-keep:]}
    folders = {_manifest(spark, root, n)["folder"] for n in numbers[-keep:]}
    fs, _ = _fs(spark, root)
    # manifests first: a reader never finds one whose folder is gone
    for name in _names(spark, f"{root}/manifests"):
        if name not in kept:
            fs.delete(_fs(spark, f"{root}/manifests/{name}")[1], False)
    gone = [name for name in _names(spark, f"{root}/data") if name not in folders]
    for name in gone:
        fs.delete(_fs(spark, f"{root}/data/{name}")[1], True)
    return gone


def update_fingerprints(root: str, assets: DataFrame, compute, version: int, keep: int = 1) -> DataFrame:
    """The fingerprint cache brought up to the library: what is missing is computed, other versions and dead assets go, and
    the result is the next version. ``compute`` gives the rows of a table of missing asset ids. Nothing is written when nothing changed.
    """
    spark = assets.sparkSession
    found = current(spark, root)
    if found is None:
        fresh = compute(assets.filter(~F.col("is_video")).select("asset_id"))
        write(fresh, root, 0)
    else:
        cache = read(spark, root)
        live = catalog.prune(catalog.current_version(cache, version), assets)
        missing, wanted = materialize_counted(catalog.missing_fingerprints(assets, cache, version), "missing", n=F.count(F.lit(1)))
        if wanted["n"] or cache.count() != live.count():
            write(catalog.merge_fingerprints(live, compute(missing)).select(cache.columns), root, found[0])
    clean(spark, root, keep)
    return read(spark, root)
