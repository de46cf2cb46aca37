"""Structured Streaming jobs.

Each takes a streaming DataFrame and returns one, or starts a query; ``run_to_end`` drives a query
through everything available and stops, which is also how an interrupted scan resumes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shoebox.functions.fixed import GRACE_DAYS
from shoebox.operators import heads, queue, settings
from shoebox.operators.distributed import latest
from shoebox.operators.heads import Logistic
from shoebox.session import materialize

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A growing table as a stream: ``name.parquet`` and ``name-*.parquet`` of the folder, files or folders of files. The schema is that of the table so far.

    Every stream of the session keeps its state in RocksDB, off the heap.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    files = f"{folder}/{name}{{.parquet,-*.parquet}}"
    reader = spark.readStream.schema(spark.read.parquet(files).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(files)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what is available into a parquet folder. Stopped or killed runs go on from the checkpoint."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append").start()
    )
    query.awaitTermination()


def first_candidates(arrivals: DataFrame, delay: str = "1 day") -> DataFrame:
    """Candidates as they arrive, each asset once; the state forgets an asset after the delay."""
    return arrivals.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["library_id", "asset_id"])


# re-ranking


RANKS = "library_id bigint, asset_id bigint, category string, priority double, batch_id bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def learned_models(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(library_id, positives, negatives, bias, weights) as ``online_model`` last committed them to its checkpoint; no rows before that."""
    if not _exists(spark, f"{checkpoint}/commits/0"):
        return spark.createDataFrame([], f"library_id bigint, {heads.LOGISTIC_SCHEMA}")
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "model").load()
    return state.select("key.library_id", *[f"value.{c}" for c in ("positives", "negatives", "bias", "weights")])


def current_ranks(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(library_id, asset_id, category, priority): the last written rank of each candidate that still has one."""
    if not _exists(spark, path):
        return spark.createDataFrame([], RANKS.rsplit(",", 1)[0])
    rows = spark.read.schema(RANKS).parquet(path)
    rows = rows if before is None else rows.filter(F.col("batch_id") < before)
    return latest(rows, ["library_id", "asset_id"], ["batch_id"]).filter("priority is not null").select("library_id", "asset_id", "category", "priority")


def rerank_on_change(changes: DataFrame, candidates: DataFrame, models, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """For every micro-batch of changes, ranks the candidates of the libraries it touches and writes the ranks that differ
    from those written before; a candidate that is gone is written without a priority. ``current_ranks`` reads them.

    ``models()`` gives the (library_id, positives, negatives, bias, weights) of the moment: with ``learned_models`` on the checkpoint of an
    ``online_model`` that runs beside it, what one batch taught ranks the next. ``every`` is the cadence (a time such as "10 seconds");
    without it the query goes through what is available and ends. A batch has a folder of its own, so a replay writes the same again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = materialize(batch.select("library_id").distinct(), "touched")
        rows = candidates.join(touched, "library_id", "left_semi").join(models(), "library_id", "left")
        score = heads.logistic_score("weights", "bias", "embedding")
        known = F.col("weights").isNotNull() & F.col("embedding").isNotNull()
        power = F.coalesce(heads.influence(F.col("positives"), F.col("negatives")), F.lit(0.0))
        value = queue.priority(F.col("confidence"), F.col("byte_size"), F.when(known, score), power)
        ranked = rows.select("library_id", "asset_id", "category", value.alias("priority"))
        old = current_ranks(spark, path, batch_id).join(touched, "library_id", "left_semi")
        both = ranked.join(old.select("library_id", "asset_id", F.col("category").alias("was"), F.col("priority").alias("had")), ["library_id", "asset_id"], "full")
        changed = both.filter(~(F.col("priority").eqNullSafe(F.col("had")) & F.col("category").eqNullSafe(F.col("was")))).select(ranked.columns)
        # a library's rows are spread over files by priority range, so a large one is no single task
        out = changed.repartitionByRange("library_id", F.desc("priority")).sortWithinPartitions("library_id", F.desc("priority"))
        out.write.mode("overwrite").partitionBy("library_id").parquet(f"{path}/batch_id={batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    query = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    if not every:
        query.awaitTermination()
    return query


# online model


class OnlineModel(StatefulProcessor):
    """Per library: scores each decision with the weights so far, then learns from it.

    The state keeps the last folded (ts, event_id); rows that arrive behind it are counted, not applied.
    """

    STATE = "positives bigint, negatives bigint, bias double, weights array<double>, at bigint, event_id bigint, late bigint"
    OUTPUT = "library_id bigint, event_id bigint, score double, positives bigint, negatives bigint, weight_norm double, late bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"])
        head, last, late = None, (-1, -1), 0
        if self.model.exists():
            positives, negatives, bias, weights, at, event, late = self.model.get()
            head = Logistic(len(weights))
            head.positives, head.negatives, head.bias, head.weights = positives, negatives, bias, np.array(weights, dtype=np.float64)
            last = (at, event)
        out = []
        for ts, event, x, target in zip(batch["ts"], batch["event_id"], batch["embedding"], batch["target"]):
            step = (pd.Timestamp(ts).value // 1000, int(event))
            if step <= last:
                late += 1
                continue
            x = np.asarray(x, dtype=np.float64)
            head = head or Logistic(len(x))
            score = head.score(x)
            head.step(x, int(target))
            last = step
            out.append((key[0], event, score, head.positives, head.negatives, float(np.linalg.norm(head.weights)), late))
        if head is not None:
            self.model.update((head.positives, head.negatives, float(head.bias), head.weights.tolist(), *last, late))
        yield pd.DataFrame(out, columns=["library_id", "event_id", "score", "positives", "negatives", "weight_norm", "late"])

    def close(self) -> None:
        pass


def online_model(examples: DataFrame) -> DataFrame:
    """Stream of (library_id, event_id, ts, embedding, target) to the score each row had before it was learned."""
    return examples.groupBy("library_id").transformWithStateInPandas(
        statefulProcessor=OnlineModel(), outputStructType=OnlineModel.OUTPUT, outputMode="Append", timeMode="None"
    )


class PendingQueue(StatefulProcessor):
    """Per library: what is marked, when it falls due, and the stack that an undo pops.

    Rows wait in a list until the watermark has passed them and are then applied in the order (ts, event_id), whatever batches they came in.
    The grace is a setting of the library, the same for all its marks, so they fall due in the order they were made: a queue, numbered
    from ``head`` to ``tail``, whose entries count only while their asset's mark is still theirs. The stack is kept by depth, both in pages. Push, pop and expiry
    each touch one entry; one timer waits for the next row and one for the head of the queue.
    """

    ROW = "ts bigint, event_id bigint, asset_id bigint, action string, bytes bigint, grace bigint"
    OUTPUT = "library_id bigint, asset_id bigint, marked_at timestamp, bytes bigint, execute_after timestamp"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROW)
        self.counts = handle.getValueState("counts", "head bigint, tail bigint, depth bigint")
        self.marks = handle.getMapState("marks", "asset_id bigint", "event_id bigint")
        self.line = handle.getMapState("line", "page bigint", "entries string")
        self.stack = handle.getMapState("stack", "page bigint", "entries string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            micros = pdf["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([tuple(r) for r in zip(micros.tolist(), *(pdf[c].tolist() for c in ("event_id", "asset_id", "action", "bytes", "grace")), strict=True)])
            first = int(micros.min()) if first is None else min(first, int(micros.min()))
        if first is not None:
            self.handle.registerTimer(_millis(first))
        return iter(())  # an empty frame per library and batch costs more than its rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, later = sorted(r for r in rows if r[0] <= now), [r for r in rows if r[0] > now]
        known = self.counts.exists()
        head, tail, depth = self.counts.get() if known else (0, 0, 0)
        marks, line, stack = _Overlay(self.marks, not known), _Pages(self.line, tail), _Pages(self.stack, depth)
        due = []

        def expire(before: int) -> int:
            """Takes what falls due before ``before`` off the queue."""
            at = head
            while at < tail and (entry := line[at])[0] + entry[5] < before:
                ts, event, asset, _, size, grace = entry
                if marks[asset] == (event,):
                    due.append((key[0], asset, pd.Timestamp(ts, unit="us"), size, pd.Timestamp(ts + grace, unit="us")))
                    marks[asset] = None
                line[at] = None
                at += 1
            return at

        for row in ready:
            ts, event, asset, action, *_ = row
            head = expire(ts)  # a decision exactly at a deadline is in time
            if action == "undo":
                if depth:
                    depth -= 1
                    undone, asset, action = stack[depth]
                    stack[depth] = None
                    if action == "delete":
                        marks[asset] = None
                continue
            stack[depth] = (event, asset, action)
            depth += 1
            marks[asset] = (event,) if action == "delete" else None
            if action == "delete":
                line[tail] = row
                tail += 1
        head = expire(now + 1)
        for part in (marks, line, stack):
            part.write()
        self.counts.update((head, tail, depth))
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(_millis(min(r[0] for r in later)))
        if head < tail:
            self.handle.registerTimer(_millis(line[head][0] + line[head][5]))
        if due:
            yield self._frame(due)

    @staticmethod
    def _frame(due: list[tuple]) -> pd.DataFrame:
        kinds = {"library_id": "int64", "asset_id": "int64", "marked_at": "datetime64[us]", "bytes": "int64", "execute_after": "datetime64[us]"}
        return pd.DataFrame(due, columns=list(kinds)).astype(kinds)

    def close(self) -> None:
        pass


class _Overlay:
    """Map state with the changes of one call in front of it: what comes and goes within the call never reaches the store. An ``empty``
    store is not asked.
    """

    def __init__(self, state, empty: bool = False):
        self.state, self.empty, self.seen, self.stored = state, empty, {}, {}

    def __getitem__(self, key):
        if key not in self.seen:
            kept = self.state.getValue((key,)) if not self.empty and self.state.containsKey((key,)) else None
            self.seen[key] = self.stored[key] = None if kept is None else tuple(kept)
        return self.seen[key]

    def __setitem__(self, key, value) -> None:
        self.seen[key] = value

    def write(self) -> None:
        for key, value in self.seen.items():
            if value is not None:
                if self.stored.get(key) != value:
                    self.state.updateValue((key,), value)
            elif not self.empty and self.stored.get(key, self) is not None and self.state.containsKey((key,)):
                self.state.removeKey((key,))


class _Pages:
    """Numbered entries in map state, ``PAGE`` to a value, with the changes of one call in front of it: a call to the store costs far more
    than an entry. Places from ``end`` on were never stored.
    """

    PAGE = 256

    def __init__(self, state, end: int):
        self.state, self.end, self.pages, self.stored, self.changed = state, end, {}, set(), set()

    def _page(self, number: int) -> dict:
        if number not in self.pages:
            kept = number * self.PAGE < self.end and self.state.containsKey((number,))
            self.pages[number] = {at: tuple(entry) for at, entry in json.loads(self.state.getValue((number,))[0])} if kept else {}
            if kept:
                self.stored.add(number)
        return self.pages[number]

    def __getitem__(self, place: int):
        return self._page(place // self.PAGE).get(place)

    def __setitem__(self, place: int, value) -> None:
        page = self._page(place // self.PAGE)
        if value is None:
            page.pop(place, None)
        else:
            page[place] = value
        self.changed.add(place // self.PAGE)

    def write(self) -> None:
        for number in self.changed:
            if self.pages[number]:
                self.state.updateValue((number,), (json.dumps(list(self.pages[number].items())),))
            elif number in self.stored:
                self.state.removeKey((number,))


def _millis(micros: int) -> int:
    return -(-micros // 1000)


def pending_deadlines(decisions: DataFrame, grace: str = "oneWeek", delay: str = "1 hour") -> DataFrame:
    """Stream of decisions (library_id, event_id, asset_id, ts, action, bytes) to the items whose grace period ended. ``grace`` is the setting for
    all, or the name of a column that holds each library's.

    A delete waits out its grace unless a keep, a whitelist, a new delete or its undo comes first. An undo takes back the library's last decision that still
    stands; undoing a keep marks nothing again, and undoing a delete that was carried out changes nothing. A decision exactly at
    the deadline counts as in time. Rows behind the watermark are dropped. The rows do not depend on how the events are cut into batches.
    """
    days = settings.grace_days(grace) if grace in decisions.columns else F.lit(GRACE_DAYS[grace])
    made = decisions.filter(F.col("action").isin(*queue.DECISIONS, "undo")).withWatermark("ts", delay).select(
        "library_id", "event_id", "asset_id", "ts", "action", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"), (days.cast("bigint") * 86_400_000_000).alias("grace")
    )
    return made.groupBy("library_id").transformWithStateInPandas(
        statefulProcessor=PendingQueue(), outputStructType=PendingQueue.OUTPUT, outputMode="Append", timeMode="EventTime"
    )


# event-time windows


def burst_sessions(arrivals: DataFrame, gap: str = "10 seconds", delay: str = "1 hour") -> DataFrame:
    """Arriving assets in runs at most ``gap`` apart; rows behind the watermark are dropped and counted by Spark. ``gap`` is a time for all, or
    the name of a column with seconds, the same for all rows of a library.
    """
    within = F.make_interval(secs=F.col(gap).cast("decimal(18, 6)")) if gap in arrivals.columns else gap
    runs = arrivals.withWatermark("ts", delay).groupBy("library_id", F.session_window("ts", within).alias("run"))
    return runs.agg(F.count(F.lit(1)).alias("members")).select("library_id", F.col("run.start").alias("started"), F.col("run.end").alias("ended"), "members")


def daily_totals(items: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Freed bytes per day, emitted once the day is over."""
    days = items.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("day"))
    return days.agg(F.count(F.lit(1)).alias("items"), F.sum("bytes").alias("bytes")).select(F.to_date("day.start").alias("run_date"), "items", "bytes")
