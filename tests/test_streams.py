"""Streams: batch parity, late rows, resuming, deadlines."""

import random
from datetime import timedelta

import pytest
from conftest import SF, START
from pyspark.sql import functions as F

from shoebox.operators import heads, moments, settings
from shoebox.plans import q_learning, q_streams
from shoebox.sources import derived
from shoebox.streaming import jobs, metrics


def write(spark, rows, schema, path, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / "stage"))
    part = next(p for p in (path / "stage").iterdir() if p.suffix == ".parquet")
    target = path / "in"
    target.mkdir(exist_ok=True)
    part.rename(target / f"rows-{name}.parquet")
    for rest in (path / "stage").iterdir():
        rest.unlink()
    (path / "stage").rmdir()


def run(spark, path, build, times=1):
    for _ in range(times):
        stream = build(jobs.read_table(spark, str(path / "in"), "rows", files_per_trigger=1))
        jobs.run_to_end(stream, str(path / "out"), str(path / "state"))
    return spark.read.schema(stream.schema).parquet(str(path / "out"))


def test_online_model_equals_the_batch_fold(lib):
    streamed = q_streams.online(lib)
    last = streamed.groupBy("library_id").agg(F.max_by(F.struct("positives", "negatives", "weight_norm"), F.col("positives") + F.col("negatives")).alias("s"))
    size = F.round(F.sqrt(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w)), 6)
    folded = heads.train_logistic(q_learning.swipe_examples(lib), ["library_id"], ["ts", "event_id"])
    joined = last.join(folded, "library_id").select("s.*", F.col("positives").alias("p"), F.col("negatives").alias("n"), size.alias("w")).collect()
    assert joined and len(joined) == folded.count()
    assert all((r.positives, r.negatives) == (r.p, r.n) and r.weight_norm == pytest.approx(r.w, abs=1e-6) for r in joined)


def test_online_model_counts_late_rows(spark, tmp_path):
    schema = "library_id bigint, event_id bigint, ts timestamp, embedding array<double>, target int"
    row = lambda event, second: (0, event, START + timedelta(seconds=second), [1.0, 0.0], 1)
    write(spark, [row(1, 10), row(2, 20)], schema, tmp_path, 1)
    out = run(spark, tmp_path, jobs.online_model)
    write(spark, [row(3, 5), row(4, 30)], schema, tmp_path, 2)
    out = run(spark, tmp_path, jobs.online_model)
    assert {(r.event_id, r.positives, r.late) for r in out.collect()} == {(1, 1, 0), (2, 2, 0), (4, 3, 1)}


def test_deadlines_over_batches(spark, tmp_path):
    schema = "library_id bigint, event_id bigint, ts timestamp, asset_id bigint, action string, bytes bigint"
    row = lambda event, day, asset_id, action: (0, event, START + timedelta(days=day), asset_id, action, event)
    write(spark, [row(1, 0, 1, "delete"), row(2, 0, 2, "delete"), row(3, 0, 3, "delete")], schema, tmp_path, 1)
    write(spark, [row(4, 3, 2, "keepOnce"), row(5, 5, 3, "delete")], schema, tmp_path, 2)
    out = run(spark, tmp_path, jobs.pending_deadlines)
    assert out.count() == 0
    write(spark, [row(6, 9, 9, "delete")], schema, tmp_path, 3)
    out = run(spark, tmp_path, jobs.pending_deadlines)
    # 2 was kept; 3 was marked again on day 5 and still waits
    assert [(r.asset_id, r.bytes) for r in out.collect()] == [(1, 1)]
    write(spark, [row(7, 14, 9, "whitelist")], schema, tmp_path, 4)
    out = run(spark, tmp_path, jobs.pending_deadlines)
    assert {r.asset_id for r in out.collect()} == {1, 3}


def replayed(rows, grace, now):
    """What falls due by ``now``: every mark against what happens to it later, with the undo stack as in the app."""
    due, marks, stack = set(), {}, []

    def expire(before):
        for asset, (at, size) in list(marks.items()):
            if at + grace < before:
                due.add((asset, at, size, at + grace))
                del marks[asset]

    for _, event, at, asset, action, size in sorted(rows, key=lambda r: (r[2], r[1])):
        if at > now:
            break
        expire(at)
        if action == "undo":
            if stack and (last := stack.pop())[1] == "delete":
                marks.pop(last[0], None)
            continue
        stack.append((asset, action))
        marks.pop(asset, None)
        if action == "delete":
            marks[asset] = at, size
    expire(now + timedelta(microseconds=1))
    return due


@pytest.mark.parametrize("cuts", [1, 2, 5])
def test_pending_queue_honours_undo_however_batches_are_cut(spark, tmp_path, cuts):
    rng = random.Random(11)
    actions = ["delete"] * 5 + ["undo"] * 3 + ["keepOnce", "whitelist"]
    rows = [(lib, i, START + timedelta(hours=3 * i + rng.random()), rng.randint(100, 160), rng.choice(actions), i) for i in range(120) for lib in (0, 1)]
    rows += [(0, 900, START + timedelta(days=1), 50, "delete", 1), (0, 901, START + timedelta(days=8), 50, "keepOnce", 1)]  # exactly at its deadline
    schema = "library_id bigint, event_id bigint, ts timestamp, asset_id bigint, action string, bytes bigint"
    rows.sort(key=lambda r: r[2])
    for n in range(cuts):
        part = rows[n * len(rows) // cuts : (n + 1) * len(rows) // cuts]
        write(spark, rng.sample(part, len(part)), schema, tmp_path, n)
        out = run(spark, tmp_path, jobs.pending_deadlines)
    now = max(r[2] for r in rows) - timedelta(hours=1)
    now = now.replace(microsecond=now.microsecond // 1000 * 1000)
    for lib in (0, 1):
        got = [(r.asset_id, r.marked_at, r.bytes, r.execute_after) for r in out.filter(F.col("library_id") == lib).collect()]
        want = replayed([r for r in rows if r[0] == lib], timedelta(days=7), now)
        assert sorted(got) == sorted(want) and len(want) > 3 and not any(r[0] == 50 for r in want)


def test_each_library_waits_its_own_grace(spark, tmp_path):
    schema = "library_id bigint, event_id bigint, ts timestamp, asset_id bigint, action string, bytes bigint"
    rows = [(lib, 10 * lib + i, START + timedelta(days=i), i, "delete", i) for lib in (0, 1, 2) for i in range(9)] + [(9, 99, START + timedelta(days=40), 0, "keepOnce", 0)]
    given = spark.createDataFrame([(0, "oneDay"), (1, "oneMonth"), (2, None)], "library_id bigint, grace string")
    write(spark, rows, schema, tmp_path, 1)
    out = run(spark, tmp_path, lambda s: jobs.pending_deadlines(settings.with_settings(s, given, grace="oneWeek"), "grace"))
    days = {0: 1, 1: 30, 2: 7}
    got = {(r.library_id, r.asset_id): r.execute_after for r in out.collect()}
    assert got == {(lib, i): START + timedelta(days=i + days[lib]) for lib in days for i in range(9)}


@pytest.mark.parametrize("cuts", [1, 3])
def test_sessions_and_batch_runs_agree_for_libraries_of_other_strictness(spark, tmp_path, cuts):
    rng = random.Random(3)
    shots = sorted((lib, i, START + timedelta(seconds=rng.randrange(4000))) for lib in range(3) for i in range(120))
    given = spark.createDataFrame([(0, 0.0), (1, 1.0)], "library_id bigint, strictness double")
    shots.sort(key=lambda r: r[2])
    rows = [(lib, 100 * lib + i, at, None, 0, 0) for lib, i, at in shots]
    schema = "library_id bigint, asset_id bigint, creation_ts timestamp, burst_id string, dhash bigint, phash bigint"
    photos = settings.with_settings(spark.createDataFrame(rows, schema), given, strictness=6 / 7).withColumn("window", settings.moment_window())
    batch = moments.time_runs(photos, "window").groupBy("library_id", "run").agg(F.min("creation_ts"), F.count(F.lit(1))).collect()
    for n in range(cuts):
        write(spark, [r for r in rows[n::cuts]] if cuts == 1 else rows[n * 120 : (n + 1) * 120], schema, tmp_path, n)
    write(spark, [(8, 1, START + timedelta(days=3), None, 0, 0)], schema, tmp_path, 90)
    paced = lambda s: settings.with_settings(s, given, strictness=6 / 7).select("library_id", F.col("creation_ts").alias("ts"), settings.moment_window().alias("window"))
    out = run(spark, tmp_path, lambda s: jobs.burst_sessions(paced(s), "window")).filter("library_id < 8").collect()
    assert sorted((r.library_id, r.started, r.members) for r in out) == sorted((r[0], r[2], r[3]) for r in batch)
    assert len({sum(r.library_id == lib for r in out) for lib in range(3)}) == 3


def test_candidates_once_over_batches(spark, tmp_path):
    schema = "library_id bigint, asset_id bigint, ts timestamp"
    for n, ids in enumerate([(1, 2, 2), (2, 3), (1,)]):
        write(spark, [(0, i, START + timedelta(minutes=n)) for i in ids], schema, tmp_path, n)
    assert sorted(r.asset_id for r in run(spark, tmp_path, jobs.first_candidates).collect()) == [1, 2, 3]


def test_scan_resumes_where_it_stopped(spark, tmp_path):
    build = lambda s: s.mapInPandas(derived._simhash_batches, "doc_id bigint, dhash bigint, phash bigint")
    write(spark, [(1, "a b"), (2, "c")], "doc_id bigint, text string", tmp_path, 1)
    assert run(spark, tmp_path, build, times=2).count() == 2
    write(spark, [(3, "d")], "doc_id bigint, text string", tmp_path, 2)
    assert sorted(r.doc_id for r in run(spark, tmp_path, build).collect()) == [1, 2, 3]


def test_late_rows_and_observed_metrics_are_reported(spark, tmp_path):
    listener = metrics.MetricsListener()
    spark.streams.addListener(listener)
    schema = "library_id bigint, ts timestamp"
    write(spark, [(0, START + timedelta(days=2)), (0, START + timedelta(days=2, seconds=5))], schema, tmp_path, 1)
    # a batch is held against the watermark of the batch before it
    write(spark, [(0, START + timedelta(days=2, seconds=9))], schema, tmp_path, 2)
    write(spark, [(0, START), (0, START + timedelta(days=4))], schema, tmp_path, 3)
    counted = lambda s: jobs.burst_sessions(metrics.observed(s, "arrivals", rows=F.count(F.lit(1))))
    out = run(spark, tmp_path, counted)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(listener)
    assert [r.members for r in out.collect()] == [3]
    assert sum(r["rows"] for r in listener.rows if r["name"] == "arrivals") == 5
    assert sum(r["dropped"] for r in listener.rows if r["name"] == "late rows") == 1


def test_reranking_rewrites_only_touched_libraries(spark, tmp_path):
    candidates = spark.createDataFrame([(lib, lib * 10 + i, "blurry", 0.1 * i, 70_000, None) for lib in (0, 1) for i in range(3)], "library_id bigint, asset_id bigint, category string, confidence double, byte_size bigint, embedding array<double>")
    models = spark.createDataFrame([], f"library_id bigint, {heads.LOGISTIC_SCHEMA}")
    out = str(tmp_path / "ranked")
    seen = []
    for n, library in enumerate((0, 1, 1)):
        write(spark, [(library,)], "library_id bigint", tmp_path, n)
        jobs.rerank_on_change(jobs.read_table(spark, str(tmp_path / "in"), "rows"), candidates, lambda: models, out, str(tmp_path / "state"))
        seen.append(spark.read.parquet(out).groupBy("library_id").count().collect())
    assert [sorted((r.library_id, r["count"]) for r in s) for s in seen] == [[(0, 3)], [(0, 3), (1, 3)], [(0, 3), (1, 3)]]


def test_what_one_batch_taught_ranks_the_next(spark, tmp_path):
    """Learner and ranker go on side by side over the same growing folder; only ranks that moved are written."""
    schema = "library_id bigint, event_id bigint, ts timestamp, embedding array<double>, target int"
    candidates = spark.createDataFrame([(lib, lib * 10 + i, "blurry", 0.1 * i, 70_000, [1.0, float(i)]) for lib in (0, 1) for i in range(3)], "library_id bigint, asset_id bigint, category string, confidence double, byte_size bigint, embedding array<double>")
    learned, ranks, states, fewest = str(tmp_path / "learned"), str(tmp_path / "ranked"), [], heads.LOGISTIC_WARM
    swipe = lambda lib, i: (lib, i, START + timedelta(minutes=i), [1.0, float(i % 2)], i % 2)
    assert jobs.learned_models(spark, learned).collect() == [] == jobs.current_ranks(spark, ranks).collect()
    batches = [[swipe(0, 1), swipe(1, 1)], [swipe(0, i) for i in range(2, 2 * fewest + 4)], [swipe(1, 2)]]
    for n, rows in enumerate(batches):
        write(spark, rows, schema, tmp_path, n)
        stream = lambda: jobs.read_table(spark, str(tmp_path / "in"), "rows", files_per_trigger=1)
        jobs.rerank_on_change(stream(), candidates, lambda: jobs.learned_models(spark, learned), ranks, str(tmp_path / "rank-state"))
        states.append({r.asset_id: r.priority for r in jobs.current_ranks(spark, ranks).collect()})
        jobs.run_to_end(jobs.online_model(stream()), str(tmp_path / "out"), learned)
    written = {r.batch_id: r["count"] for r in spark.read.schema(jobs.RANKS).parquet(ranks).groupBy("batch_id").count().collect()}
    assert states[0] == states[1] == states[2] and written == {0: 6}  # batch 1 was ranked before it was learned, batch 2 touches the other library
    write(spark, [swipe(0, 90)], schema, tmp_path, 3)
    jobs.rerank_on_change(stream(), candidates.filter("asset_id <> 2"), lambda: jobs.learned_models(spark, learned), ranks, str(tmp_path / "rank-state"))
    now = {r.asset_id: r.priority for r in jobs.current_ranks(spark, ranks).collect()}
    model = jobs.learned_models(spark, learned).filter("library_id = 0").first()
    assert (model.positives, model.negatives) == (fewest + 2, fewest + 1)
    assert set(now) == {0, 1, 10, 11, 12} and all(now[a] == states[2][a] for a in (10, 11, 12)) and now[1] != states[2][1]
    folded = heads.train_logistic(spark.createDataFrame([r for b in batches for r in b], schema), ["library_id"], ["ts", "event_id"]).filter("library_id = 0").first()
    assert list(model.weights) == pytest.approx(list(folded.weights)) and model.bias == pytest.approx(folded.bias)


def test_folder_given(spark):
    assert jobs.read_table(spark, SF, "events").isStreaming


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    spark.range(0, 6).repartition(3).write.parquet(f"{tmp_path}/rows.parquet")
    spark.range(6, 8).coalesce(1).write.parquet(f"{tmp_path}/rows-1.parquet")
    spark.range(100, 103).write.parquet(f"{tmp_path}/rowsother.parquet")
    for _ in range(2):
        jobs.run_to_end(jobs.read_table(spark, str(tmp_path), "rows"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(8))
