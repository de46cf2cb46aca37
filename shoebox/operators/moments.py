"""Pass 2: different shots of one moment, among photographs that pass 1 did not claim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions import scalars
from shoebox.functions.fixed import TIERS
from shoebox.operators.components import connected_components
from shoebox.operators.distributed import Sequence, attach, owned, shared


def unclaimed_photos(image_rows: DataFrame, claimed: DataFrame) -> DataFrame:
    return image_rows.filter(~F.col("is_screen_like")).join(claimed.select(*owned(claimed, "asset_id")), shared(image_rows, claimed, "asset_id"), "left_anti")


def time_runs(photos: DataFrame, window: float | str = 10.0, bound: int = 1_000_000) -> DataFrame:
    """Adds ``run``: consecutive photos at most ``window`` seconds apart, or of one burst. ``window`` may name a column of ``photos``, the same
    for all rows of a library, which then stays.
    """
    columns = ["library_id", "asset_id", "creation_ts", "burst_id", "dhash", "phash", *([window] if isinstance(window, str) else [])]
    order = [F.col("creation_ts"), F.col("asset_id")]
    allowed = F.round(F.col(window) * 1e6).cast("bigint") if isinstance(window, str) else F.lit(int(round(window * 1e6)))
    gap_ok = F.unix_micros("creation_ts") - F.unix_micros("prev_creation_ts") <= allowed
    same_burst = F.coalesce(F.col("burst_id") == F.col("prev_burst_id"), F.lit(False))
    starts = ~F.coalesce(gap_ok | same_burst, F.lit(False))
    sequence = Sequence(photos.select(*columns), ["library_id"], order, "moments", bound)
    runs = sequence.previous("creation_ts", "burst_id").derive("_start", starts.cast("bigint")).running_sum("_start", "run")
    return runs.result().select(*columns, "run")


def run_verdicts(runs: DataFrame, window: float | str = 10.0, span_factor: float = 6.0, max_size: int = 12, batch_share: float = 0.6) -> DataFrame:
    """One row per run of two or more: size, guards and ``verdict``.

    vouched: one burst id throughout, exempt from the guards; span / size / batch: the guard
    that rejects it; ok otherwise. ``window`` may name a column of ``runs``.
    """
    allowed = F.max(window if isinstance(window, str) else F.lit(window)).alias("window")
    stamps = runs.groupBy("library_id", "run", "creation_ts").agg(
        F.count(F.lit(1)).alias("n"), F.count("burst_id").alias("bursts"),
        F.min("burst_id").alias("low"), F.max("burst_id").alias("high"), F.min("asset_id").alias("first_id"), allowed,
    )
    per_run = stamps.groupBy("library_id", "run").agg(
        F.sum("n").alias("members"), F.sum("bursts").alias("bursts"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("creation_ts").alias("first_ts"), F.max("creation_ts").alias("last_ts"),
        F.max("n").alias("same_stamp"), F.min("first_id").alias("first_id"), F.max("window").alias("window"),
    )
    span = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(1e6)
    verdict = (
        F.when((F.col("bursts") == F.col("members")) & (F.col("low") == F.col("high")), "vouched")
        .when(span > F.col("window") * span_factor, "span")
        .when(F.col("members") > max_size, "size")
        .when((F.col("members") >= 3) & (F.col("same_stamp") / F.col("members") > batch_share), "batch")
        .otherwise("ok")
    )
    return per_run.filter("members > 1").select(
        "library_id", "run", "members", "first_id", "same_stamp", span.alias("span_seconds"), verdict.alias("verdict")
    )


def moment_edges(runs: DataFrame, verdicts: DataFrame, max_d: int = 12, max_p: int = 12) -> DataFrame:
    """Edges inside accepted runs: same burst, or both hashes near enough.

    A vouched run is one burst of any length and links to its first member. Every other
    accepted run passed the size guard, so comparing its members is bounded by that guard.
    """
    bursts = verdicts.filter("verdict = 'vouched'").select("library_id", "run", "first_id", "members")
    vouched = (
        attach(runs, bursts, ["library_id", "run"], "members").filter("asset_id <> first_id")
        .select("library_id", F.col("first_id").alias("src"), F.col("asset_id").alias("dst"))
    )
    small = runs.join(verdicts.filter("verdict = 'ok'").select("library_id", "run"), ["library_id", "run"])
    a = small.select("library_id", "run", F.struct("asset_id", "burst_id", "dhash", "phash").alias("a"))
    b = small.select("library_id", "run", F.struct("asset_id", "burst_id", "dhash", "phash").alias("b"))
    near = (scalars.hamming("a.phash", "b.phash") <= max_p) & (scalars.hamming("a.dhash", "b.dhash") <= max_d)
    same_burst = F.coalesce(F.col("a.burst_id") == F.col("b.burst_id"), F.lit(False))
    pairs = a.join(b, ["library_id", "run"]).filter("a.asset_id < b.asset_id").filter(same_burst | near)
    return vouched.union(pairs.select("library_id", F.col("a.asset_id").alias("src"), F.col("b.asset_id").alias("dst")))


def moment_members(edges: DataFrame) -> DataFrame:
    labels = connected_components(edges, keys=tuple(owned(edges)))
    return labels.select(*owned(labels), F.col("label").alias("group_key"), F.lit(TIERS["moment"]).alias("tier"), F.col("node").alias("asset_id"))


def run_metrics(verdicts: DataFrame) -> DataFrame:
    """Runs rejected by a guard, never dropped silently."""
    return verdicts.groupBy("library_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("verdict").isin("vouched", "ok")).alias("dropped_runs")
    )
