"""Queue, history, layout, rules, catalog: boundaries and brute-force replays."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import START
from pyspark.sql import functions as F

from shoebox.functions import fixed, scalars, vectors
from shoebox.operators import history, layout, queue
from shoebox.sources import catalog

EVENTS = "library_id bigint, event_id bigint, ts timestamp, asset_id bigint, action string, bytes bigint"


def events(spark, rows):
    return spark.createDataFrame([(0, i, START + timedelta(seconds=i), a, action, 10) for i, (a, action) in enumerate(rows)], EVENTS)


def state_of(log):
    return queue.current_state(queue.with_undo(log, ["library_id"]), ["library_id", "asset_id"])


def test_undo_lifts_marks_and_protection(spark):
    log = events(spark, [(1, "delete"), (1, "undo"), (2, "whitelist"), (2, "undo"), (3, "delete"), (3, "keepOnce"), (3, "undo")])
    state = {r.asset_id: (r.pending, r.protected) for r in state_of(log).collect()}
    # undoing the keep of 3 does not mark it again
    assert state == {1: (False, False), 2: (False, False), 3: (False, False)}


@pytest.mark.parametrize("bound", [10_000, 15])
def test_undo_replays_a_stack(spark, bound):
    rng = random.Random(bound)
    log = [(rng.randrange(30), rng.choice(["delete", "keepOnce", "whitelist", "undo", "undo"])) for _ in range(400)]
    sessions = [rng.choice([0, 0, 1]) for _ in log]
    rows = [(s, i, START + timedelta(seconds=i // 3), a, action, 10) for i, ((a, action), s) in enumerate(zip(log, sessions))]
    got = {r.event_id: r.undo_event_id for r in queue.with_undo(spark.createDataFrame(rows, EVENTS), ["library_id"], bound).collect()}
    expected, stacks = {}, {0: [], 1: []}
    for s, i, _, _, action, _ in rows:
        if action != "undo":
            stacks[s].append(i)
            expected[i] = None
        elif stacks[s]:
            expected[stacks[s].pop()] = i
    assert got == expected


def test_whitelist_outlives_a_later_delete(spark):
    row = state_of(events(spark, [(1, "whitelist"), (1, "delete")])).first()
    assert row.pending and row.protected and row.marked_at == START + timedelta(seconds=1) and row.bytes == 10


def test_an_undone_delete_is_neither_due_nor_executed(spark):
    log = events(spark, [(1, "delete"), (2, "delete"), (2, "undo"), (3, "whitelist"), (3, "undo"), (4, "delete"), (4, "delete"), (4, "undo")])
    state = state_of(log)
    pending = queue.with_deadline(queue.pending_items(state, ["library_id", "asset_id"]))
    due = queue.due_items(pending, "2030-01-01 00:00:00", ["library_id", "asset_id"]).collect()
    assert [(r.asset_id, r.bytes, r.position) for r in due] == [(1, 10, 1)]
    assert queue.protected_items(state, ["asset_id"]).collect() == []


def test_pending_lists_the_newest_first_per_library(spark):
    log = events(spark, [(1, "delete"), (2, "delete")]).unionByName(events(spark, [(3, "delete"), (1, "delete")]).withColumn("library_id", F.lit(1).cast("bigint")))
    pending = queue.pending_items(state_of(log), ["library_id", "asset_id"])
    got = {(r.library_id, r.position): r.asset_id for r in queue.newest_first(pending, ["asset_id"]).collect()}
    assert got == {(0, 1): 2, (0, 2): 1, (1, 1): 1, (1, 2): 3}


def test_priority_weighs_size_by_logarithm(spark):
    df = spark.createDataFrame([(0.5, 65_536), (0.5, 1), (0.5, 65_536 * 1024)], "confidence double, size bigint")
    got = [round(r.p, 6) for r in df.select(queue.priority(F.col("confidence"), F.col("size")).alias("p")).collect()]
    assert got == [0.275, 0.275, 0.775]


def test_readings_keep_the_last_of_a_day_and_400_days(spark):
    rows = [(0, i, datetime(2024, 1, 1) + timedelta(days=i, hours=h), 1, 100 * h) for i in range(401) for h in (1, 5, 9)]
    rows = [(lib, 3 * n, ts, count, size) for n, (lib, _, ts, count, size) in enumerate(rows)] + [(0, 9999, datetime(2030, 1, 1), 0, 0)]
    kept = history.daily_readings(spark.createDataFrame(rows, "library_id bigint, reading_id bigint, ts timestamp, asset_count bigint, bytes bigint")).collect()
    assert len(kept) == 400 and {r.bytes for r in kept} == {900} and min(r.day for r in kept).isoformat() == "2024-01-02"


def test_nearest_reading_ties_go_to_the_earlier(spark):
    readings = spark.createDataFrame([(0, datetime(2024, 1, 1), 1), (0, datetime(2024, 1, 3), 2)], "library_id bigint, ts timestamp, bytes bigint")
    moments = spark.createDataFrame([(0, datetime(2024, 1, 2)), (1, datetime(2024, 1, 2))], "library_id bigint, ts timestamp")
    assert {r.library_id: r.reading_bytes for r in history.nearest_reading(moments, readings).collect()} == {0: 1, 1: None}


def test_unknown_categories_are_dropped_and_percents_truncate(spark):
    rows = [(0, datetime(2024, 1, 1).date(), c, b) for c, b in (("blurry", 2), ("other", 1), ("nonsense", 5))]
    runs = history.runs(spark.createDataFrame(rows, "library_id bigint, run_date date, category string, bytes bigint"))
    shares = {r.category: r.percent for r in history.category_share(history.freed_by_category(runs)).collect()}
    assert shares == {"blurry": 66, "other": 33}
    assert history.run_log(runs).first().top_category is None


LINES = "asset_id bigint, line_no bigint, x double, y double, w double, h double, text string, confidence double"


def brute_layout(rows):
    """Features by definition, from a list of (x, y, w, h, text, confidence)."""
    n = len(rows)
    sd = lambda v: (sum((a - sum(v) / len(v)) ** 2 for a in v) / len(v)) ** 0.5
    mids, lefts = sorted(y + h / 2 for _, y, _, h, _, _ in rows), sorted(r[0] for r in rows)
    median = sorted(r[3] for r in rows)[n // 2]
    out = {"median_height": median, "gap_regularity": 0.0, "paired_rows": 0.0, "column_count": 0, "columns_even": False}
    if n >= 4:
        gaps = [b - a for a, b in zip(mids, mids[1:])]
        mean = sum(gaps) / len(gaps)
        out["gap_regularity"] = max(0.0, 1 - min(1.0, sd(gaps) / mean)) if mean > 0 else 0.0
        tol = max(0.004, 0.45 * median)
        pair = lambda a, b: a is not b and abs(a[1] + a[3] / 2 - b[1] - b[3] / 2) / tol < 1 - 1e-9 and b[0] - (a[0] + a[2]) > 0.02
        out["paired_rows"] = sum(any(pair(a, b) for b in rows) for a in rows) / n
        chains = [[lefts[0]]]
        for v in lefts[1:]:
            if v - chains[-1][-1] <= 0.06:
                chains[-1].append(v)
            else:
                chains.append([v])
        centres = [sum(c) / len(c) for c in chains if len(c) >= 2]
        out["column_count"] = len(centres)
        if len(centres) >= 3:
            gaps = [b - a for a, b in zip(centres, centres[1:])]
            out["columns_even"] = sd(gaps) / (sum(gaps) / len(gaps)) < 0.35
    return out


@pytest.mark.parametrize("bound", [20_000, 20])
def test_layout_by_definition(spark, bound):
    rng = random.Random(11)
    pages = {a: [(rng.randrange(90) / 100, rng.randrange(95) / 100, rng.random() / 3, rng.choice([0.01, 0.02, 0.03]), "a1", 0.5) for _ in range(60 if a == 0 else rng.randrange(1, 15))] for a in range(25)}
    rows = [(a, i, *line) for a, lines in pages.items() for i, line in enumerate(lines)]
    got = layout.features(spark.createDataFrame(rows, LINES), bound).collect()
    assert len(got) == len(pages)
    for r in got:
        for name, value in brute_layout(pages[r.asset_id]).items():
            assert r[name] == pytest.approx(value, abs=1e-7), (r.asset_id, name)


@pytest.mark.parametrize("text, expected", [("9:41", True), ("09:41 AM", True), (" 9：41", True), ("24:00", False), ("9:60", False), ("9:4", False), ("41", False), ("123:45", False), (None, False)])
def test_clock(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(scalars.looks_like_clock("t").alias("c")).first().c is expected


def test_device_match_ignores_orientation(spark):
    rows = [(2556, 1179), (1179, 2556), (2048, 1536), (4032, 3024), (0, 10)]
    got = [r.device_match for r in scalars.device_match(spark.createDataFrame(rows, "pixel_width int, pixel_height int")).collect()]
    assert got == ["phone", "phone", "ambiguous", "none", "none"]


def test_size_estimates_truncate(spark):
    df = spark.createDataFrame([(3, 1, False, 0.0), (1, 1, True, 1.0000001)], "pixel_width int, pixel_height int, is_video boolean, duration double")
    assert [r.e for r in df.select(scalars.estimated_bytes().alias("e")).collect()] == [1, 1125000]


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(vectors.cosine("a", "b").alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert df.select(vectors.normalise("b").alias("n")).first().n == [1.0, 0.0]


def test_folder_scan_and_capture_dates(spark, tmp_path):
    for name in ("b.JPG", "a.heic", "c.txt", "sub/d.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    rows = catalog.folder_scan(spark, str(tmp_path)).orderBy("filename").collect()
    assert [(r.filename, r.byte_size) for r in rows] == [("a.heic", 5), ("b.JPG", 5), ("d.png", 5)]
    df = spark.createDataFrame([("2024:05:06 07:08:09", START), (None, START), ("junk", START), (None, None)], "exif string, m timestamp")
    got = df.select(F.unix_micros(catalog.capture_ts("exif", "m")).alias("t")).collect()
    assert [r.t for r in got] == [1714979289000000, int(START.timestamp() * 1e6), 0, 0]


def test_centroid_library_of_another_revision_reads_empty(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 3, 1, [1.0]), ("b", None, 2, 1, [])], "name string, category string, sample_count bigint, revision int, centroid array<double>")
    catalog.write_centroids(rows, str(tmp_path / "lib"))
    assert [r.name for r in catalog.read_centroids(spark, str(tmp_path / "lib"), 1).collect()] == ["a"]
    assert catalog.read_centroids(spark, str(tmp_path / "lib"), fixed.EMBEDDING_REVISION).count() == 0


def test_intermediates_need_a_shared_folder_on_a_cluster():
    from shoebox.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


@pytest.mark.parametrize("bound", [1_000_000, 7])
def test_as_of_carries_the_last_and_the_next_event(spark, bound):
    import random

    from shoebox.operators.asof import as_of

    rng = random.Random(2)
    events = [(lib, rng.randrange(60), i, f"e{i}") for i in range(40) for lib in (0, 1)]
    rows = [(lib, rng.randrange(-5, 70), i) for i in range(50) for lib in (0, 1, 2)]
    left = spark.createDataFrame(rows, "library_id bigint, at bigint, item bigint")
    right = spark.createDataFrame(events, "library_id bigint, happened bigint, seq bigint, name string")
    for forward in (False, True):
        got = {(r.library_id, r.item): (r.seq, r.name) for r in as_of(left, right, ["library_id"], "at", "happened", ["seq", "name"], forward, bound=bound).collect()}
        assert len(got) == len(rows)
        for lib, at, item in rows:
            fits = [(h, seq, name) for own, h, seq, name in events if own == lib and (h >= at if forward else h <= at)]
            best = (min(fits) if forward else max(fits))[1:] if fits else (None, None)
            assert got[lib, item] == best


def test_category_is_that_of_the_marking(spark):
    pending = spark.createDataFrame([(0, 1, 5, 10), (0, 2, 5, 10), (1, 1, 5, 10), (0, 3, 5, 10)], "library_id bigint, asset_id bigint, at int, bytes bigint").withColumn("marked_at", F.timestamp_seconds("at")).drop("at")
    named = [(0, 1, 0, -1, "blurry"), (0, 1, 5, 3, "webShot"), (0, 1, 5, 2, "blurry"), (0, 2, 0, -1, "receipt"), (1, 1, 6, 1, "late")]
    frame = lambda rows: spark.createDataFrame(rows, "library_id bigint, asset_id bigint, at int, seq bigint, category string").withColumn("named_at", F.timestamp_seconds("at"))
    want = {(0, 1): "webShot", (0, 2): "receipt", (1, 1): "other", (0, 3): "other"}
    for later in ([], [(0, 1, 6, 9, "today"), (0, 2, 99, 9, "today")]):
        got = queue.category_at_mark(pending, frame(named + later), ["library_id", "asset_id"]).collect()
        assert {(r.library_id, r.asset_id): r.category for r in got} == want


def test_cache_versions_survive_killed_writes(spark, tmp_path, monkeypatch):
    from shoebox.sources import snapshots

    root, columns = str(tmp_path / "cache"), "asset_id bigint, dhash bigint, version int"
    library = lambda ids: spark.createDataFrame([(i, i % 5 == 4) for i in ids], "asset_id bigint, is_video boolean")
    asked = []

    def compute(missing):
        asked.append(sorted(r.asset_id for r in missing.collect()))
        return missing.select("asset_id", (F.col("asset_id") * 10).alias("dhash"), F.lit(8).alias("version"))

    rows = lambda: sorted(r.asset_id for r in snapshots.read(spark, root).collect())
    assert snapshots.read(spark, root) is None
    snapshots.update_fingerprints(root, library(range(6)), compute, 8)
    assert rows() == [0, 1, 2, 3, 5] and snapshots.current(spark, root)[0] == 1
    snapshots.update_fingerprints(root, library(range(6)), compute, 8)
    assert snapshots.current(spark, root)[0] == 1 and len(asked) == 1  # nothing changed, nothing written
    commit = snapshots._commit

    def dies(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(snapshots, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        snapshots.update_fingerprints(root, library(range(2, 9)), compute, 8)
    assert rows() == [0, 1, 2, 3, 5] and len(list((tmp_path / "cache/data").iterdir())) == 2
    monkeypatch.setattr(snapshots, "_commit", commit)
    snapshots.update_fingerprints(root, library(range(2, 9)), compute, 8)
    assert rows() == [2, 3, 5, 6, 7, 8] and asked[-1] == [6, 7, 8]
    assert len(list((tmp_path / "cache/data").iterdir())) == 1 and [p.name for p in (tmp_path / "cache/manifests").iterdir() if p.suffix != ".crc"] == ["000000000002"]
    with pytest.raises(snapshots.Conflict):
        snapshots.write(spark.createDataFrame([(1, 1, 8)], columns), root, base=1)
    assert rows() == [2, 3, 5, 6, 7, 8]


def test_decks_counts_and_corrections_stay_in_their_library(spark):
    from shoebox.operators import embeddings, heads

    rows = [(lib, i, "blurry" if i % 2 else "webShot", 0.1 * i + lib, 100) for lib in (0, 1) for i in range(4)]
    cards = spark.createDataFrame(rows, "library_id bigint, asset_id bigint, category string, priority double, byte_size bigint")
    marked = spark.createDataFrame([(1, 3)], "library_id bigint, asset_id bigint")
    free = queue.open_candidates(cards, marked, marked.limit(0), marked.limit(0))
    assert free.count() == 7
    deck = queue.decks(free, 1)
    assert {(r.library_id, r.category, r.asset_id) for r in deck.collect()} == {(0, "blurry", 3), (0, "webShot", 2), (1, "blurry", 1), (1, "webShot", 2)}
    more = queue.top_up(deck.drop("position"), free.withColumn("arrival", F.col("asset_id")), 1)
    assert {(r.library_id, r.asset_id) for r in more.collect()} == {(0, 1), (0, 0), (1, 0)}
    spare = spark.createDataFrame([(1, 9, 0, False, 7)], "library_id bigint, asset_id bigint, tier int, is_keeper boolean, byte_size bigint")
    assert {(r.library_id, r.category): r.n for r in queue.category_counts(free, spare).collect()} == {(0, "blurry"): 2, (0, "webShot"): 2, (1, "blurry"): 1, (1, "webShot"): 2, (1, "duplicate"): 1}
    assert {r.library_id: r.bytes for r in queue.potential_savings(cards, marked, spare).collect()} == {0: 400, 1: 307}
    assert {(r.library_id, r.category) for r in queue.untaught(free).collect()} == {(lib, c) for lib in (0, 1) for c in fixed.HEAD_ONLY if c != "webShot"}
    fixes = spark.createDataFrame([(1, 2, 5, 5, "other")], "library_id bigint, asset_id bigint, ts bigint, event_id bigint, corrected string")
    assert {(r.library_id, r.asset_id) for r in heads.apply_corrections(cards, fixes).filter("category = 'other'").collect()} == {(1, 2)}
    labels = spark.createDataFrame([(0, "a", None, 1)], "library_id bigint, name string, category string, sample_count bigint")
    held = spark.createDataFrame([(0, "a", 2, [1.0])], "library_id bigint, name string, revision int, centroid array<double>")
    given = spark.createDataFrame([(1, " a ", "webShot", 2, 2, [2.0], 1)], "library_id bigint, name string, category string, sample_count bigint, revision int, centroid array<double>, seq bigint")
    merged, centres = embeddings.name_clusters(labels, held, given)
    assert {(r.library_id, r.name, r.category, r.sample_count) for r in merged.collect()} == {(0, "a", None, 1), (1, "a", "webShot", 2)} and centres.count() == 2


def test_moments_of_assets_with_large_ids(spark, tmp_path):
    """From id 429,500 on, an asset lies more than 2^31 seconds after the first."""
    from shoebox.sources.derived import Library

    seconds = {429_499: 21_474 * 100_000 + 19 * 2, 429_500: 21_475 * 100_000, 512_819: 25_640 * 100_000 + 19 * 60, 30_000_007: 1_500_000 * 100_000 + 7 * 2}
    rows = [(i, "a b", None, "web", 3) for i in seconds]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assets = Library(spark, str(tmp_path)).assets()
    got = {r.asset_id: r.at for r in assets.select("asset_id", (F.unix_seconds("creation_ts") - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))).alias("at")).collect()}
    assert got == seconds


def test_columns_whose_unevenness_lies_on_the_bound_go_as_in_sql(spark):
    """Gaps of 27 : 13 deviate by exactly 0.35 of their mean, so the last bit decides."""
    import duckdb

    from shoebox.operators import layout
    from shoebox.plans import q_layout  # noqa: F401
    from shoebox.plans.duck_views import with_views

    schema = "asset_id bigint, line_no bigint, x double, y double, w double, h double, text string, confidence double"
    lines, places = [], range(0, 100)
    for n, (a, low, unit) in enumerate((a, low, unit) for a in places for low in (13, 27) for unit in (1, 2, 3)):
        gaps = (low * unit, (40 - low) * unit)  # in halves of hundredths, where a column's two lines lie apart
        for odd in (0, 1):
            centres = [2 * a + odd, 2 * a + odd + gaps[0], 2 * a + odd + sum(gaps)]
            if centres[-1] < 199:
                starts = [x for c in centres for x in ((c // 2) / 100, (c - c // 2) / 100)]
                lines += [(2 * n + odd, i + 1, x, 0.1 * i, 0.02, 0.02, "a", 1.0) for i, x in enumerate(starts)]
    con = duckdb.connect()
    con.execute("create table given (asset_id bigint, line_no bigint, x double, y double, w double, h double, text varchar, confidence double)")
    con.executemany("insert into given values (?, ?, ?, ?, ?, ?, ?, ?)", lines)
    want = dict(con.execute(with_views("select asset_id, columns_even from lay_columns", ("lay_columns",), {"ocr_lines": ((), "select * from given")})).fetchall())
    assert len(set(want.values())) == 2
    got = {r.asset_id: r.columns_even for r in layout.features(spark.createDataFrame(lines, schema)).collect()}
    assert got == want


def test_area_is_summed_in_the_order_of_the_lines(spark):
    lines = [(1, 1, 0.0, 0.1, 0.1, 1.0), (1, 2, 0.5, 0.5, 0.2, 1.0), (1, 3, 0.5, 0.9, 0.3, 1.0)]
    df = spark.createDataFrame(lines, "asset_id bigint, line_no int, x double, y double, w double, h double").selectExpr("*", "'a' text", "1.0D confidence")
    assert [layout.features(df, bound).first().text_area for bound in (20_000, 2)] == [0.1 + 0.2 + 0.3] * 2  # by columns it would be 0.1 + (0.2 + 0.3)


def test_scores_are_summed_from_left_to_right(spark):
    from shoebox.operators import rules

    df = spark.sql("select 0.1D saturation, 0.8D edge_density, 0.0D flatness, false has_clock, 1.3D aspect, 0.02D text_area, array('receipt') labels")
    assert df.select(rules.game_score().alias("s")).first().s == 0.1 * 1.3 + 0.8 * 0.9 + 0.4 + 0.35 + 0.5 + 0.45
