"""Session set-up and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_fallback_dirs: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shoebox")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for durable intermediates: what the cluster names in
    ``spark.checkpoint.dir``. Only a local session may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _fallback_dirs:
        _fallback_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="spark-shoebox-")
    return _fallback_dirs[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/shoebox/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end_with_query(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go as soon as the query has ended. Otherwise they stay until the driver happens to collect its
    garbage, and those of many steps lie on the disks at once.
    """
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage durably (an executor may die at any time), gives later stages a columnar
    scan with real sizes, and pins values such as partition numbers that must not change on a retry.
    The shuffle files of the write are not kept, as nothing reads them again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_end_with_query(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize``, with aggregates of the rows taken while they are written."""
    seen = Observation()
    written = materialize(df.observe(seen, *[value.alias(key) for key, value in metrics.items()]), name)
    return written, seen.get


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
