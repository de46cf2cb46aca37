"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.session import materialize, materialize_counted, shuffle_width

BROADCAST_KEYS = 200_000  # more hot keys than this stay with the ordinary join
TASK_ROWS = 500_000  # rows that one task sorts


def owned(df: DataFrame, *keys: str) -> list[str]:
    """``keys`` within the library, where rows know theirs: ids repeat over libraries."""
    return [*(["library_id"] if "library_id" in df.columns and "library_id" not in keys else []), *keys]


def shared(a: DataFrame, b: DataFrame, *keys: str) -> list[str]:
    """``keys`` to join two tables by, within the library if both know theirs."""
    return owned(a, *keys) if "library_id" in b.columns else list(keys)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, by aggregation (combined map-side)."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark cuts every input partition to ``k`` rows per key before
    the shuffle (WindowGroupLimit), so a hot key sends at most k rows per partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def attach(rows: DataFrame, per_key: DataFrame, keys: list[str], size: str, bound: int = 1_000_000) -> DataFrame:
    """Inner join of many rows with one row per key, safe when a key is huge.

    ``size`` is the column of ``per_key`` that counts a key's rows; it is dropped. Keys above ``bound`` can
    number at most rows / bound, so those few are broadcast and their rows never shuffle; all
    other keys take the ordinary join. Without such keys it is just that join.
    """
    per_key, seen = materialize_counted(per_key, "per-key", hot=F.count_if(F.col(size) > bound))
    if seen["hot"] == 0 or seen["hot"] > BROADCAST_KEYS:
        return rows.join(per_key.drop(size), keys)
    hot = per_key.filter(F.col(size) > bound)
    warm = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot.drop(size)), keys).unionByName(warm.join(per_key.filter(F.col(size) <= bound).drop(size), keys))


def dealt(df: DataFrame, keys: list[str], rows: int = TASK_ROWS) -> DataFrame:
    """``df`` shuffled by ``keys`` into tasks of about ``rows`` rows where the session's width would make them larger, so that what a task
    sorts does not grow with the table. Smaller tables stay as they are.
    """
    tasks = -(-df.count() // rows)
    return df.repartition(tasks, *keys) if tasks > shuffle_width(df.sparkSession) else df


def hot_keys(df: DataFrame, keys: list[str], name: str, bound: int) -> DataFrame | None:
    """Keys with more than ``bound`` rows, None if there are none: one aggregation, at most rows / bound results."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot, seen = materialize_counted(sizes.filter(F.col("_n") > bound).drop("_n"), f"{name}-hot", n=F.count(F.lit(1)))
    return hot if seen["n"] else None


class Sequence:
    """Rows of each key in order, for neighbours, running totals and row numbers.

    Keys with at most ``bound`` rows use an ordinary window, one task per key. Larger keys are cut into
    contiguous slices of the (key, order) sequence; a second step over one row per slice
    carries values across slice edges. Both give the same rows, whatever the key sizes.
    ``order`` must identify rows within a key.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[Column], name: str, bound: int = 1_000_000, hot: DataFrame | None | str = "look"):
        self.keys, self.order = keys, order
        if keys:
            hot = hot_keys(df, keys, name, bound) if isinstance(hot, str) else hot
            self.sliced = hot is not None
        else:
            self.sliced = df.count() > bound
        if not self.sliced:
            self.rows, self.group = df, list(keys)
            return
        self.group = ["_part", *keys]
        big = df.join(hot, keys, "left_semi") if keys else df
        n = shuffle_width(df.sparkSession)
        cut = big.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
        # written once: every later pass must see the same slice numbers
        self.rows = materialize(cut, f"{name}-slices")
        if keys:
            self.rows = self.rows.unionByName(df.join(hot, keys, "left_anti").withColumn("_part", F.lit(0)))

    def _carry(self):
        """Window over the slices of a key: one row per slice."""
        return Window.partitionBy(*self.keys).orderBy("_part")

    def previous(self, *columns: str) -> "Sequence":
        """Adds ``prev_<c>``, null on the first row of a key."""
        local = Window.partitionBy(*self.group).orderBy(*self.order)
        lagged = [F.lag(c).over(local).alias(f"prev_{c}") for c in columns]
        if not self.sliced:
            self.rows = self.rows.select("*", *lagged)
            return self
        out = self.rows.select("*", (F.row_number().over(local) == 1).alias("_first"), *lagged)
        # the last row of each slice of each key: nothing follows it within the slice
        tail = (
            self.rows.select(*self.group, *columns, F.lead(F.lit(1)).over(local).alias("_next"))
            .filter("_next is null").select(*self.group, F.struct(*columns).alias("_tail"))
        )
        before = tail.select(*self.group, F.lag("_tail").over(self._carry()).alias("_before")).filter("_before is not null")
        out = out.join(before, self.group, "left")
        for c in columns:
            out = out.withColumn(f"prev_{c}", F.when(F.col("_first"), F.col(f"_before.{c}")).otherwise(F.col(f"prev_{c}")))
        self.rows = out.drop("_first", "_before")
        return self

    def _running(self, value: str, out: str, fold, combine) -> "Sequence":
        local = Window.partitionBy(*self.group).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        if not self.sliced:
            self.rows = self.rows.withColumn(out, fold(value).over(local))
            return self
        per_slice = self.rows.groupBy(*self.group).agg(fold(value).alias("_slice"))
        before = self._carry().rowsBetween(Window.unboundedPreceding, -1)
        carried = per_slice.select(*self.group, fold("_slice").over(before).alias("_before"))
        self.rows = (
            self.rows.withColumn("_local", fold(value).over(local))
            .join(carried, self.group, "left")
            .withColumn(out, F.when(F.col("_before").isNull(), F.col("_local")).otherwise(combine("_local", "_before")))
            .drop("_local", "_before")
        )
        return self

    def running_sum(self, value: str, out: str) -> "Sequence":
        return self._running(value, out, F.sum, lambda a, b: F.col(a) + F.col(b))

    def running_min(self, value: str, out: str) -> "Sequence":
        return self._running(value, out, F.min, F.least)

    def running_max(self, value: str, out: str) -> "Sequence":
        return self._running(value, out, F.max, F.greatest)

    def size(self, out: str) -> "Sequence":
        """Adds the number of rows of the key."""
        if not self.sliced:
            self.rows = self.rows.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(*self.keys)))
        else:
            self.rows = self.rows.join(self.rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias(out)), self.keys)
        return self

    def key_max(self, value: Column, out: str) -> "Sequence":
        """Adds the greatest ``value`` of the key."""
        if not self.sliced:
            self.rows = self.rows.withColumn(out, F.max(value).over(Window.partitionBy(*self.keys)))
        else:
            self.rows = self.rows.join(self.rows.groupBy(*self.keys).agg(F.max(value).alias(out)), self.keys)
        return self

    def nearby_max(self, position: str, value: str, radius: float, out: str) -> "Sequence":
        """Adds the greatest ``value`` among the key's rows whose ``position`` is at most ``radius`` away.

        A large key is first reduced to its distinct positions.
        """
        # SQL text: the Python window API takes whole numbers only
        near = f"over (partition by {', '.join(self.keys)} order by {position} range between {radius}D preceding and {radius}D following)"
        if not self.sliced:
            self.rows = self.rows.withColumn(out, F.expr(f"max({value}) {near}"))
        else:
            places = self.rows.groupBy(*self.keys, position).agg(F.max(value).alias("_high"))
            reached = places.select(*self.keys, position, F.expr(f"max(_high) {near}").alias(out))
            self.rows = self.rows.join(reached, [*self.keys, position])
        return self

    def derive(self, name: str, value: Column) -> "Sequence":
        self.rows = self.rows.withColumn(name, value)
        return self

    def result(self) -> DataFrame:
        return self.rows.drop("_part")


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str, name: str, bound: int = 1_000_000) -> DataFrame:
    """Row numbers from 1 within each key, without one task per large key."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return Sequence(one, keys, order, name, bound).running_sum("_one", out).result().drop("_one")
