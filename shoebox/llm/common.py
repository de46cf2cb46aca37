"""Shared pieces of the operators here: reading tables, Arrow maps over texts, durable intermediates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.operators.distributed import attach
from shoebox.session import materialize as _materialize

SLICE_BYTES = 4 << 20  # texts handled at once inside a task
KEYS_A_TASK = 400_000  # rows that a task makes of keys it spreads


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: its lineage ends there."""
    return _materialize(df, f"llm-{name}")


def drop_written(*tables: DataFrame) -> None:
    """Deletes intermediates made by ``materialize`` once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(hadoop).delete(path, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.Table]], Iterator[pa.Table]], schema: str) -> DataFrame:
    """``fn`` over the Arrow batches of each partition, sliced so that one slice holds a bounded number of bytes
    (a single longer text is a slice of its own).
    """

    def run(batches):
        yield from (b for t in fn(_slices(batches)) for b in t.to_batches())

    return df.mapInArrow(run, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, min(batch.num_rows, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield pa.Table.from_batches([batch.slice(at, rows)])


def dealt_for(df: DataFrame, rows: int, keys: int, by: str) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by a column, so that a task that makes ``keys`` rows of each makes about ``KEYS_A_TASK``. Files of few
    bytes are read by few tasks, and what these combine or sort before a shuffle would fill an executor.
    """
    return df.repartition(max(1, -(-rows * keys // KEYS_A_TASK)), by)


def worker_memo(key, make: Callable):
    """``make()``, kept for the life of the Python worker process, which Spark reuses for task after task."""
    import sys
    import types

    kept = sys.modules.setdefault("_shoebox_worker_memo", types.ModuleType("_shoebox_worker_memo")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def first_by_hash(df: DataFrame, of: list, total: Column, rows: int) -> DataFrame:
    """Rows whose 64-bit hash of ``of`` is among the lowest: about twice ``rows`` of ``total``, and surely all if those are few. What is
    first in the order of that hash is in it, so a sample of the first ``rows`` gathers no more than that anywhere.
    """
    share = F.least(F.lit(1.0), (2.0 * rows + 1000.0) / F.greatest(total, F.lit(1)).cast("double"))
    edge = F.when(share >= 1.0, F.lit((1 << 63) - 1)).otherwise((share * float(1 << 64) - float(1 << 63)).cast("bigint"))
    return df.filter(F.xxhash64(*of) <= edge)


def sample_per_key(df: DataFrame, key: str, of: list, rows: int) -> DataFrame:
    """At most ``rows`` distinct rows of each key that is not null, the first by the hash of ``of``, ties by its columns. Keys are counted
    first, so what meets in one task is bounded by ``rows`` and not by the number of partitions.
    """
    from pyspark.sql import Window

    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_size")).withColumn("_total", F.col("_size"))
    near = first_by_hash(attach(df.filter(F.col(key).isNotNull()), sizes.filter(F.col(key).isNotNull()), [key], "_size"), of, F.col("_total"), rows)
    w = Window.partitionBy(key).orderBy(F.xxhash64(*of), *of)
    return near.select(*df.columns).distinct().withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= rows).drop("_rank")
