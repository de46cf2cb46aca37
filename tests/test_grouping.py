"""Hand-written libraries, one per boundary of copies, moments and keepers."""

import random

import pytest
from conftest import asset, mark, tables
from pyspark.sql import functions as F

from shoebox.functions import scalars
from shoebox.operators import copies, keepers, moments
from shoebox.operators.components import connected_components
from shoebox.operators.distributed import Sequence, attach, numbered


def copy_groups(spark, assets, prints):
    rows = copies.find_copies(*tables(spark, assets, prints)).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.group_key, r.tier), set()).add(r.asset_id)
    return groups


def verdicts(spark, assets, prints=None, **kw):
    a, f = tables(spark, assets, prints or [mark(x["asset_id"]) for x in assets])
    runs = moments.time_runs(copies.images(a, f), **kw)
    return runs, moments.run_verdicts(runs)


@pytest.mark.parametrize("d, p, expected", [(2, 4, {(1, 1): {1, 2}}), (3, 4, {}), (2, 5, {})])
def test_tier_edges(spark, d, p, expected):
    bits = lambda n: (1 << n) - 1
    assert copy_groups(spark, [asset(1), asset(2, at=1)], [mark(1), mark(2, bits(d), bits(p) << 20)]) == expected


def test_sign_bit_and_orientation(spark):
    prints = [mark(1, -1, -1), mark(2, (1 << 63) - 1, -1), mark(3, -1, -1)]
    assets = [asset(1), asset(2), asset(3, w=3024, h=4032)]
    assert copy_groups(spark, assets, prints) == {(1, 1): {1, 2}}


def test_resized_copy_has_the_same_shape(spark):
    assert copy_groups(spark, [asset(1), asset(2, w=2016, h=1512), asset(3, w=2017, h=1512)], [mark(i) for i in (1, 2, 3)]) == {(1, 1): {1, 2}}


def test_screen_captures_are_identical_or_nothing(spark):
    same = [asset(1, subtypes=4, content="x"), asset(2, subtypes=4, content="x")]
    near = [asset(3, subtypes=4), asset(4, subtypes=4)]
    assert copy_groups(spark, same + near, [mark(i) for i in (1, 2, 3, 4)]) == {(1, 0): {1, 2}}


def test_mixed_tiers_take_the_looser(spark):
    assets = [asset(1, content="x"), asset(2, content="x"), asset(3)]
    assert copy_groups(spark, assets, [mark(1), mark(2), mark(3, dhash=1)]) == {(1, 1): {1, 2, 3}}


def test_libraries_stay_apart(spark):
    assets = [asset(1, content="x"), asset(2, content="x", library_id=1)]
    assert copy_groups(spark, assets, [mark(1), mark(2)]) == {}


@pytest.mark.parametrize("low, high, expected", [(1000, 1900, False), (1000, 2300, False), (1000, 2000, True), (0, 5, False)])
def test_screen_ratio_is_open(spark, low, high, expected):
    df = spark.createDataFrame([(low, high, 0)], "pixel_width int, pixel_height int, subtypes int")
    assert df.select(scalars.is_screen_like().alias("s")).first().s is expected


def test_two_copy_chains_and_a_close_pair(spark):
    assets = [asset(i, at=i, content="x" if i < 4 else "y") for i in range(1, 7)]
    prints = [mark(i) if i < 4 else mark(i, dhash=(1 << 20) - 1) for i in range(1, 7)]
    groups = copy_groups(spark, assets, prints)
    assert groups == {(1, 0): {1, 2, 3}, (4, 0): {4, 5, 6}}
    a, f = tables(spark, assets, prints)
    claimed = copies.find_copies(a, f)
    assert moments.unclaimed_photos(copies.images(a, f), claimed).count() == 0


@pytest.mark.parametrize("gap, runs", [(10.0, 1), (10.001, 2)])
def test_gap_boundary(spark, gap, runs):
    assert verdicts(spark, [asset(1), asset(2, at=gap)])[0].select("run").distinct().count() == runs


def test_burst_chain_is_vouched(spark):
    _, v = verdicts(spark, [asset(i, at=60 * i, burst="b") for i in range(30)])
    assert [(r.members, r.verdict) for r in v.collect()] == [(30, "vouched")]


def test_mixed_burst_is_dropped(spark):
    _, v = verdicts(spark, [asset(i, at=i, burst=None if i == 5 else "b") for i in range(13)])
    assert [r.verdict for r in v.collect()] == ["size"]
    assert moments.run_metrics(v).first().dropped_runs == 1


@pytest.mark.parametrize("last, verdict", [(60.0, "ok"), (60.001, "span")])
def test_span_boundary(spark, last, verdict):
    times = [0, 10, 20, 30, 40, 50, last]
    assert verdicts(spark, [asset(i, at=t, burst="b" if i > 4 else None) for i, t in enumerate(times)])[1].first().verdict == verdict


@pytest.mark.parametrize("same, verdict", [(3, "ok"), (4, "batch")])
def test_batch_share(spark, same, verdict):
    times = [0.0] * same + [float(i + 1) for i in range(5 - same)]
    assert verdicts(spark, [asset(i, at=t) for i, t in enumerate(times)])[1].first().verdict == verdict


def test_two_rows_are_never_a_batch(spark):
    assert verdicts(spark, [asset(1), asset(2)])[1].first().verdict == "ok"


def test_runs_do_not_depend_on_slicing(spark):
    rng = random.Random(5)
    assets = [asset(i, at=rng.choice([i * 4, i * 30, 50]), burst=rng.choice([None, "a", "b"]), library_id=0 if i % 3 else i % 5) for i in range(300)]
    prints = [mark(a["asset_id"]) for a in assets]
    whole = verdicts(spark, assets, prints)[0].groupBy("library_id", "run").agg(F.sort_array(F.collect_list("asset_id")).alias("m"))
    sliced = verdicts(spark, assets, prints, bound=20)[0].groupBy("library_id", "run").agg(F.sort_array(F.collect_list("asset_id")).alias("m"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sliced.collect()))


def test_sequence_slices_equal_windows(spark):
    df = spark.createDataFrame([(0 if i < 700 else i % 7, i, (i * 37) % 101 - 50) for i in range(1000)], "k bigint, i bigint, v bigint")

    def build(bound):
        s = Sequence(df, ["k"], [F.col("v"), F.col("i")], "test", bound)
        s = s.previous("v").running_sum("v", "total").running_min("total", "low").size("n").key_max(F.col("i"), "top").derive("p", F.col("v") / 10.0)
        return sorted(map(tuple, s.nearby_max("p", "i", 0.35, "near").result().select("k", "i", "v", "prev_v", "total", "low", "n", "top", "near").collect()), key=repr)

    assert build(10_000) == build(50)
    whole = [(r.i, r.nth) for r in numbered(df, [], [F.desc("v"), F.col("i")], "nth", "test", bound=10).collect()]
    expected = sorted(((-((i * 37) % 101 - 50), i) for i in range(1000)))
    assert sorted(whole) == sorted((i, n + 1) for n, (_, i) in enumerate(expected))


@pytest.mark.parametrize("crowded", [5_000, 8])
def test_band_join_finds_every_near_pair(spark, crowded):
    rng = random.Random(3)
    # the last ten places share one dHash, as flat frames do
    base = [(rng.getrandbits(64) if i < 30 else 0, rng.getrandbits(64)) for i in range(40)]
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    hashes = list({(flip(d, rng.randint(0, 3)), flip(p, rng.randint(0, 5))) for d, p in base for _ in range(12)})
    df = spark.createDataFrame([(0, 1.0, i, signed(d), signed(p)) for i, (d, p) in enumerate(hashes)], "library_id bigint, shape double, node bigint, dhash bigint, phash bigint")
    pairs = copies.band_join(df, ["library_id", "shape"], 2, 4, crowded)
    got = pairs.select("a", "b").collect()
    assert len(got) == len(set(got))
    near = {(i, j) for i, (d, p) in enumerate(hashes) for j, (e, q) in enumerate(hashes) if i < j and (d ^ e).bit_count() <= 2 and (p ^ q).bit_count() <= 4}
    assert near and near <= {tuple(r) for r in got}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(edges, "src bigint, dst bigint").repartition(seed + 1)
    got = {r.node: r.label for r in connected_components(df).collect()}
    expected = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert got == expected


def test_a_third_of_all_rows_in_one_copy_group(spark):
    assets = [asset(i, content="hot") for i in range(400)] + [asset(1000 + i) for i in range(800)]
    prints = [mark(a["asset_id"], dhash=0 if a["asset_id"] < 400 else hash((a["asset_id"], "d")), phash=0 if a["asset_id"] < 400 else hash((a["asset_id"], "p"))) for a in assets]
    prints = [{**p, "dhash": (p["dhash"] + 2**63) % 2**64 - 2**63, "phash": (p["phash"] + 2**63) % 2**64 - 2**63} for p in prints]
    a, f = tables(spark, assets, prints)
    assert copies.signatures(copies.images(a, f)).count() == 801
    groups = copy_groups(spark, assets, prints)
    assert groups[(0, 0)] == set(range(400))


def test_attach_treats_hot_keys_alike(spark):
    rows = spark.createDataFrame([(0 if i < 60 else i, i) for i in range(100)], "k bigint, i bigint")
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top"))
    plain, split = attach(rows, per_key, ["k"], "n"), attach(rows, per_key, ["k"], "n", bound=10)
    assert "BroadcastHashJoin" in split._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, plain.select("k", "i", "top").collect())) == sorted(map(tuple, split.select("k", "i", "top").collect()))


def grouped(spark, assets, prints, members):
    a, f = tables(spark, assets, prints)
    m = spark.createDataFrame(members, "group_key bigint, tier int, asset_id bigint")
    return keepers.with_keepers(keepers.with_scores(keepers.member_rows(m, a, f)))


def test_keeper_tie_goes_to_the_smaller_id(spark):
    g = grouped(spark, [asset(1), asset(2)], [mark(1), mark(2)], [(1, 0, 1), (1, 0, 2)])
    assert {r.keeper_id for r in g.collect()} == {1}


def test_favorite_beats_resolution(spark):
    g = grouped(spark, [asset(1, w=1000, h=1000, is_favorite=True), asset(2)], [mark(1), mark(2)], [(1, 1, 1), (1, 1, 2)])
    row = next(r for r in g.collect() if r.is_keeper)
    assert row.asset_id == 1 and row.reason == "favorite"


@pytest.mark.parametrize("tier, keeper", [(1, 1), (2, 2)])
def test_recency_counts_only_for_moments(spark, tier, keeper):
    g = grouped(spark, [asset(1), asset(2, at=5)], [mark(1), mark(2)], [(1, tier, 1), (1, tier, 2)])
    assert {r.keeper_id for r in g.collect()} == {keeper}


def test_protected_member_is_kept(spark):
    a, f = tables(spark, [asset(1, is_favorite=True), asset(2)], [mark(1), mark(2)])
    m = spark.createDataFrame([(1, 0, 1), (1, 0, 2)], "group_key bigint, tier int, asset_id bigint")
    scored = keepers.with_scores(keepers.member_rows(m, a, f), spark.createDataFrame([(2,)], "asset_id bigint"))
    assert keepers.keepers(scored).first().asDict() == {"library_id": 0, "group_key": 1, "keeper_id": 2, "keeper_reason": "kept by you", "size": 2}


def test_reclaimable_is_total_minus_keeper(lib):
    from shoebox.plans import scan

    rows = scan.grouped(lib)
    per_group = rows.groupBy("group_id").agg(F.count_if("is_keeper").alias("keepers"), F.sum("byte_size").alias("total"), F.sum(F.when(F.col("is_keeper"), F.col("byte_size"))).alias("kept"))
    joined = keepers.group_table(rows).join(per_group, "group_id").collect()
    assert joined and all(r.keepers == 1 and r.reclaimable == r.total - r.kept for r in joined)
    assert rows.count() == rows.select("asset_id").distinct().count()


def test_videos(spark):
    rows = [asset(1, is_video=True, duration=1.26, size=5), asset(2, is_video=True, duration=1.29, size=5), asset(3, is_video=True, size=0), asset(4, is_video=True, size=0)]
    got = copies.video_members(tables(spark, rows, [mark(1)])[0]).collect()
    assert {(r.group_key, r.asset_id) for r in got} == {(1, 1), (1, 2)}


def test_bucket_sizes_report_crowded_buckets(spark):
    df = spark.createDataFrame([(0, i << 8) for i in range(4001)], "library_id bigint, dhash bigint")
    sizes = {(r.band, r.value): r.members for r in copies.bucket_sizes(df).collect()}
    assert sizes[(0, 0)] == 4001 and max(n for (band, _), n in sizes.items() if band == 1) < 4000


def test_runs_twice_the_same(spark):
    from conftest import SF

    from shoebox.plans import scan
    from shoebox.sources.derived import Library

    one, two = scan.flagship(Library(spark, SF)), scan.flagship(Library(spark, SF))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_a_kept_picture_is_never_queued(lib):
    from shoebox.operators import queue
    from shoebox.plans import scan

    rows = scan.selected(lib)
    kept = {r.asset_id for r in rows.filter("kept").collect()}
    queued = keepers.mark_groups(rows, rows.select("group_id").distinct())[1]
    swept = keepers.one_tap_items(rows)
    assert kept and not kept & {r.asset_id for r in queued.select("asset_id").union(swept.select("asset_id")).collect()}
    freed = queue.potential_savings(lib.candidates().limit(0), lib.candidates().limit(0), rows).first().bytes
    assert freed == rows.filter("not kept").agg(F.sum("byte_size")).first()[0]
    assert keepers.worthwhile(rows.withColumn("is_favorite", ~F.col("kept"))).isEmpty()


def two_libraries(spark):
    """Near copies 1-2 in library 0 and 2-3 in library 1, a moment 5-6 in both with other times, a video pair 8-9 in library 1."""
    far = (1 << 40) - 1
    moment = lambda lib, at: [asset(5, at=at, library_id=lib, burst="b"), asset(6, at=at + 1, library_id=lib, burst="b", size=7 + lib)]
    video = dict(is_video=True, duration=2.0, size=50)
    zero = [asset(1), asset(2, at=1), asset(3, at=500), *moment(0, 3000), asset(8, at=9000, **video), asset(9, at=9900, library_id=0, is_video=True, duration=9.0, size=51)]
    one = [asset(1, at=700, library_id=1), asset(2, library_id=1), asset(3, at=1, library_id=1), *moment(1, 5000), asset(8, at=9000, library_id=1, **video), asset(9, at=9900, library_id=1, **video)]
    prints = {0: {1: 0, 2: 1, 3: far}, 1: {1: far, 2: 0, 3: 1}}
    rows = []
    for lib, assets in ((0, zero), (1, one)):
        a, f = tables(spark, assets, [mark(x["asset_id"], dhash=prints[lib].get(x["asset_id"], (x["asset_id"] * 0x9E3779B97F4A7C15) % 2**62), phash=prints[lib].get(x["asset_id"], x["asset_id"] << 50)) for x in assets])
        rows.append((a, f.withColumn("library_id", F.lit(lib).cast("bigint"))))
    return rows[0][0].unionByName(rows[1][0]), rows[0][1].unionByName(rows[1][1])


def test_ids_that_repeat_over_libraries_never_meet(spark):
    a, f = two_libraries(spark)
    found = copies.find_copies(a, f)
    assert {(r.library_id, r.group_key, r.asset_id) for r in found.collect()} == {(0, 1, 1), (0, 1, 2), (1, 2, 2), (1, 2, 3)}
    runs = moments.time_runs(moments.unclaimed_photos(copies.images(a, f), found))
    shots = moments.moment_members(moments.moment_edges(runs, moments.run_verdicts(runs)))
    assert {(r.library_id, r.group_key, r.asset_id) for r in shots.collect()} == {(lib, 5, i) for lib in (0, 1) for i in (5, 6)}
    videos = copies.video_members(a)
    assert {(r.library_id, r.asset_id) for r in videos.collect()} == {(1, 8), (1, 9)}
    members = found.unionByName(shots).unionByName(videos)
    rows = keepers.member_rows(members, a, f)
    assert rows.count() == members.count()
    protected = spark.createDataFrame([(1, 3)], "library_id bigint, asset_id bigint")
    grouped = keepers.with_keepers(keepers.with_scores(rows, protected)).cache()
    keeps = {(r.library_id, r.group_key): r.keeper_id for r in grouped.collect()}
    assert keeps[1, 2] == 3 and len(keeps) == 5
    table = keepers.group_table(grouped).collect()
    assert sorted((r.library_id, r.members) for r in table) == [(0, 2), (0, 2), (1, 2), (1, 2), (1, 2)]
    picks = spark.createDataFrame([(0, keeps[0, 5], 11 - keeps[0, 5], True)], "library_id bigint, group_id bigint, asset_id bigint, kept boolean")
    chosen = keepers.apply_selection(grouped, picks)
    assert {(r.library_id, r.asset_id) for r in chosen.filter("group_key = 5 and kept").collect()} == {(0, 11 - keeps[0, 5]), (1, keeps[1, 5])}
    left, marked = keepers.mark_groups(chosen, chosen.filter("library_id = 0 and group_key = 5").select("library_id", "group_id"))
    assert left.count() == grouped.count() - 2 and [(r.library_id, r.asset_id) for r in marked.collect()] == [(0, keeps[0, 5])]
    for report in (keepers.quality_badges, keepers.difference_summary, keepers.safety_evidence, keepers.member_order):
        assert "library_id" in report(chosen).columns and report(chosen).count() in (5, 10)


def test_components_of_equal_ids_in_other_libraries_and_a_wide_hub(spark):
    edges = [(0, 1, 2), (1, 2, 3), (1, 4, 9), (0, 9, 4)] + [(2, 1000, i) for i in range(1001, 1600)] + [(2, 5, 1001)]
    df = spark.createDataFrame(edges, "library_id bigint, src bigint, dst bigint")
    got = {(r.library_id, r.node): r.label for r in connected_components(df, keys=("library_id",)).collect()}
    want = {(0, 1): 1, (0, 2): 1, (1, 2): 2, (1, 3): 2, (1, 4): 4, (1, 9): 4, (0, 4): 4, (0, 9): 4} | {(2, n): 5 for n in (5, *range(1000, 1600))}
    assert got == want


def test_the_whole_scan_of_two_libraries(spark):
    from shoebox.operators import triage

    a, f = two_libraries(spark)
    nobody = spark.createDataFrame([(1, 2)], "library_id bigint, asset_id bigint")
    sizes = spark.createDataFrame([(5, 111), (6, 0), (3, 7)], "asset_id bigint, bytes bigint")
    loose = spark.createDataFrame([(0, 1.0)], "library_id bigint, strictness double")
    rows = {(r.library_id, r.asset_id): r for r in triage.find_groups(a, f, nobody, sizes, loose).collect()}
    # 2 of library 1 is protected: no copies are left there; exact sizes stand where there are any
    assert set(rows) == {(0, 1), (0, 2), (0, 5), (0, 6), (1, 5), (1, 6), (1, 8), (1, 9)}
    assert rows[0, 5].byte_size == 111 and rows[0, 6].byte_size == 7 and sum(r.is_keeper for r in rows.values()) == 4
    assert not any(lib == 1 and i > 6 for lib, i in {(r.library_id, r.asset_id) for r in triage.find_groups(a, f, nobody, include_videos=False).collect()})
    liked = a.withColumn("is_favorite", F.lit(True))
    assert triage.find_groups(liked, f, nobody).isEmpty() and not triage.find_groups(liked, f, nobody, skip_favorites=False).isEmpty()
