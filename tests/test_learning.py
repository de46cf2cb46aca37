"""Vectors, heads, evaluation and pixels against replays by definition."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoebox.operators import embeddings as emb
from shoebox.operators import evaluate, heads, pixels

ITEMS = "library_id bigint, item_id bigint, embedding array<double>, revision int, app string"


def planted(spark, groups=6, per_group=30, dim=64, noise=0.05, seed=1, library=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = []
    for i in range(groups * per_group):
        v = centres[i % groups] + noise * rng.normal(size=dim)
        rows.append((library, i, (v / np.linalg.norm(v)).tolist(), 2, f"app{i % groups}"))
    return rows, spark.createDataFrame(rows, ITEMS)


def sequential_leaders(vectors, threshold, ceiling=400):
    full, counts, out = [], [], []
    for v in vectors:
        v = np.array(v)
        sims = [float(c @ v) for c in full]
        best = int(np.argmax(sims)) if sims else -1
        if sims and sims[best] >= threshold:
            m = (full[best] * counts[best] + v) / (counts[best] + 1)
            full[best], counts[best] = m / np.linalg.norm(m), counts[best] + 1
            out.append((best, sims[best]))
        elif len(full) < ceiling:
            full.append(v)
            counts.append(1)
            out.append((len(full) - 1, 1.0))
        else:
            out.append((-1, 0.0))
    return out


@pytest.mark.parametrize("ceiling, threshold, noise", [(400, 0.93, 0.05), (3, 0.93, 0.05), (400, 0.5, 0.6)])
def test_leader_pass_is_the_sequential_pass(spark, ceiling, threshold, noise):
    rows, items = planted(spark, noise=noise)
    # shuffled partitions must not matter: order is by item id
    got = emb.leader_clusters(items.repartition(7), threshold, ceiling).collect()
    expected, rest, base = {}, list(range(len(rows))), 0
    while rest:  # what a pass has no leader for goes into the next
        placed = dict(zip(rest, sequential_leaders([rows[i][2] for i in rest], threshold, ceiling), strict=True))
        expected.update({i: (c + base, s) for i, (c, s) in placed.items() if c >= 0})
        rest, base = [i for i in rest if placed[i][0] < 0], base + ceiling
    expected = [expected[i] for i in range(len(rows))]
    assert [(r.cluster, round(r.similarity, 9)) for r in sorted(got, key=lambda r: r.item_id)] == [(c, round(s, 9)) for c, s in expected]


def test_blocks_of_a_large_library_find_the_planted_groups(spark):
    rows, items = planted(spark)
    placed = emb.leader_clusters(items, 0.93, block=40).join(items.select("item_id", "app"), "item_id")
    assert placed.filter("cluster >= 0 and similarity < 0.93").count() == 0 and placed.count() == len(rows)
    quality = evaluate.purity(placed.withColumnRenamed("app", "truth")).first()
    assert (quality.clusters, quality.pure) == (6, 6)


def test_leader_similarity_is_at_least_the_threshold(lib):
    from shoebox.plans import q_learning

    rows = emb.leader_clusters(q_learning.items(lib), 0.35)
    assert rows.filter("cluster >= 0 and similarity < 0.35").isEmpty()


def test_label_match_needs_the_revision_and_the_threshold(spark):
    items = spark.createDataFrame([(0, 1, [0.9, math.sqrt(1 - 0.81)], 2, "a"), (0, 2, [1.0, 0.0], 1, "a"), (0, 3, [0.89, math.sqrt(1 - 0.89**2)], 2, "a"), (1, 4, [1.0, 0.0], 2, "a"), (0, 5, [1.0, 0.0, 0.0], 2, "a")], ITEMS)
    centroids = spark.createDataFrame([(0, "x", 2, [1.0, 0.0]), (0, "w", 2, [2.0, 0.0])], "library_id bigint, name string, revision int, centroid array<double>")
    for team, chunk in ((4096, 4096), (1, 1), (2, 3)):
        best = emb.best_labels(items, centroids, ("app",), team, chunk)
        assert {r.item_id: r.label for r in best.filter("similarity >= 0.9").collect()} == {1: "w"}
        assert {(r.item_id, r.app, r.label) for r in best.collect()} == {(1, "a", "w"), (2, "a", None), (3, "a", "w"), (4, "a", None), (5, "a", None)}


def test_label_match_equals_all_cosines_for_any_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i % 3 == 0), i, rng.normal(size=6).tolist(), 1 + i % 2, f"a{i % 4}") for i in range(300)] + [(7, 900, None, 1, "n"), (7, 901, [0.0] * 6, 1, "z")]
    known = [(lib, f"n{k % 9}", 1 + k % 2, (rng.integers(-2, 3, size=6) + 0.0).tolist()) for k in range(40) for lib in (0, 1, 7)]
    items = spark.createDataFrame(rows, ITEMS)
    centroids = spark.createDataFrame(known, "library_id bigint, name string, revision int, centroid array<double>")
    want = {}
    for lib, item, v, revision, app in rows:
        best = (None, None)
        for library, name, r, c in known if v else ():
            if (library, r) == (lib, revision):
                lengths = np.linalg.norm(v) * np.linalg.norm(c)
                sim = round(float(np.dot(v, c) / lengths), 9) if lengths else 0.0
                if best[1] is None or (-sim, name) < (-best[1], best[0]):
                    best = (name, sim)
        want[lib, item, app] = best
    for team, chunk in ((4096, 4096), (7, 5), (40, 1)):
        got = emb.best_labels(items, centroids, ("app",), team, chunk).collect()
        assert {(r.library_id, r.item_id, r.app): (r.label, None if r.similarity is None else round(r.similarity, 9)) for r in got} == want


def test_what_has_no_label_is_clustered(spark):
    rows, items = planted(spark)
    known = spark.createDataFrame([(0, "first", 2, rows[0][2])], "library_id bigint, name string, revision int, centroid array<double>")
    labelled, rest = emb.label_then_cluster(items, known, 0.93, 0.93)
    assert labelled.count() and labelled.select("item_id").join(rest, "item_id").isEmpty() and labelled.count() + rest.count() == len(rows)


def test_projection_keeps_cosines_roughly(spark):
    rng = np.random.default_rng(4)
    block = rng.normal(size=(40, 768))
    block /= np.linalg.norm(block, axis=1, keepdims=True)
    small = emb.project(block)
    assert np.allclose(np.linalg.norm(small, axis=1), 1) and np.abs(small @ small.T - block @ block.T)[~np.eye(40, dtype=bool)].max() < 0.55
    assert np.array_equal(emb.project(block), small) and np.array_equal(emb.project(small), small)


def test_plane_follows_the_two_leading_axes(spark):
    rows, items = planted(spark, groups=4, noise=0.2)
    got = emb.pca_plane(items.select("item_id", "embedding")).toPandas().sort_values("item_id")
    m = np.array([r[2] for r in rows])
    m = m - m.mean(axis=0)
    _, s, _ = np.linalg.svd(m, full_matrices=False)
    assert got["px"].pow(2).sum() == pytest.approx(s[0] ** 2, rel=0.02) and got["py"].pow(2).sum() == pytest.approx(s[1] ** 2, rel=0.1)
    assert emb.pca_plane(items.filter("item_id < 2")).agg(F.max("px")).first()[0] == 0.0


def test_naming_and_policies(spark):
    labels = spark.createDataFrame([("x", None, 4)], "name string, category string, sample_count bigint")
    held = spark.createDataFrame([("x", 2, [1.0])], "name string, revision int, centroid array<double>")
    given = spark.createDataFrame([(" x ", "chatScreenshot", 3, 2, [0.5], 1), ("x", "webShot", 1, 2, [0.1], 2), (" ", "webShot", 9, 2, [0.2], 3), ("y", None, 2, 2, [0.3], 4)], "name string, category string, sample_count bigint, revision int, centroid array<double>, seq bigint")
    merged, centroids = emb.name_clusters(labels, held, given)
    assert {tuple(r) for r in merged.collect()} == {("x", "chatScreenshot", 8), ("y", None, 2)}
    assert centroids.groupBy("name").count().filter("name = 'x'").first()["count"] == 3
    edits = [("a", 1, 1, "preferDelete", True), ("a", 2, 2, "preferKeep", True), ("b", 1, 1, "preferKeep", True), ("b", 2, 2, "preferKeep", False), ("c", 1, 1, "preferKeep", True), ("c", 2, 2, "delete", True)]
    state = emb.label_policies(spark.createDataFrame(edits, "name string, at int, seq int, field string, value boolean"))
    assert {tuple(r) for r in state.collect()} == {("a", False, True), ("b", False, False)}


def test_centroid_build_falls_back_to_the_mean(spark):
    _, tight = planted(spark, groups=1, per_group=10)
    rng = np.random.default_rng(9)
    loose = [(0, 100 + i, np.eye(64)[i].tolist(), 2, "loose") for i in range(9)] + [(0, 200, rng.normal(size=64).tolist(), 2, "few")]
    built = emb.build_centroids(tight.union(spark.createDataFrame(loose, ITEMS))).collect()
    assert {(r.name, r.sample_count) for r in built} == {("app0", 10), ("loose", 9)}
    mean = next(r for r in built if r.name == "loose").centroid
    assert np.allclose(mean, [1 / 3] * 9 + [0] * 55)


def examples(spark, n=120, dim=8, classes=8, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, 2)), i // 3, i, rng.normal(size=dim).tolist(), int(rng.integers(0, classes))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "library_id bigint, ts bigint, event_id bigint, embedding array<double>, target int").repartition(5)


def test_softmax_fold(spark):
    rows, df = examples(spark)
    got = {r.library_id: r for r in heads.train_softmax(df, ["library_id"], ["ts", "event_id"]).collect()}
    for key in (0, 1):
        w, b = np.zeros((8, 8)), np.zeros(8)
        mine = [r for r in rows if r[0] == key]
        for _, _, _, x, t in mine:
            x = np.array(x)
            z = w @ x + b
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            for c in range(8):
                g = p[c] - (c == t)
                if abs(g) > 1e-6:
                    w[c] -= 0.35 * g * x + 1e-4 * w[c]
                    b[c] -= 0.35 * g
        assert np.allclose(got[key].weights, w) and np.allclose(got[key].bias, b) and got[key].samples == len(mine)
        assert got[key].per_class == [sum(r[4] == c for r in mine) for c in range(8)]


def test_logistic_fold(spark):
    rows, df = examples(spark, classes=2)
    got = {r.library_id: r for r in heads.train_logistic(df, ["library_id"], ["ts", "event_id"]).collect()}
    for key in (0, 1):
        w, b = np.zeros(8), 0.0
        for _, _, _, x, t in (r for r in rows if r[0] == key):
            x = np.array(x)
            g = 1 / (1 + np.exp(-(w @ x + b))) - t
            w, b = w - (0.25 * g * x + 2e-4 * w), b - 0.25 * g
        assert np.allclose(got[key].weights, w) and got[key].bias == pytest.approx(b)


def test_vectors_of_another_width_are_skipped(spark):
    df = spark.createDataFrame([(0, 1, 1, [1.0, 2.0], 1), (0, 2, 2, [1.0], 1)], "library_id bigint, ts bigint, event_id bigint, embedding array<double>, target int")
    model = heads.train_logistic(df, ["library_id"], ["ts", "event_id"])
    assert model.first().positives == 1
    odd = spark.createDataFrame([(0, [1.0])], "library_id bigint, embedding array<double>").join(model, "library_id")
    assert odd.select(heads.logistic_score("weights", "bias", "embedding").alias("s")).first().s == 0.5


def test_cold_head_leaves_the_rule_alone(spark):
    df = spark.createDataFrame([("blurry", 0.4, 11, [1.0] + [0.0] * 7), ("blurry", 0.4, 300, [1.0] + [0.0] * 7), ("blurry", 0.4, None, None)], "category string, confidence double, samples bigint, probabilities array<double>")
    got = [(r.fused, r.fused_confidence, r.used_model) for r in heads.fuse(df).collect()]
    assert got[0] == got[2] == ("blurry", 0.4, False) and got[1][0] == "chatScreenshot" and got[1][1] == pytest.approx(0.92) and got[1][2]


def test_held_out_training_learns_planted_classes(spark):
    _, items = planted(spark, groups=4, per_group=12)
    df = items.withColumn("target", F.regexp_extract("app", "([0-9]+)", 1).cast("int"))
    judged = evaluate.cross_validate(df, 4, "softmax", epochs=5)
    assert judged.count() == 48 and judged.filter("target = predicted").count() == 48
    half = evaluate.half_hold_out(df, epochs=5)
    assert half.count() == 24 and half.filter("target = predicted").count() == 24
    scored = evaluate.cross_validate(df.withColumn("target", (F.col("target") < 2).cast("int")), 4, "logistic", epochs=5)
    assert scored.filter("(score >= 0.5) <> (target = 1)").isEmpty()


def test_pair_distances_by_definition(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("abcdefghij") * 3, f"s{rng.randrange(12)}", rng.random() < 0.3, rng.random() < 0.3, rng.getrandbits(63) & rng.getrandbits(63), rng.getrandbits(62)) for i in range(90)]
    df = spark.createDataFrame(rows, "item_id bigint, content_hash string, stem string, is_burst boolean, is_screen_like boolean, dhash bigint, phash bigint")
    got = evaluate.pair_distances(df, closest=5, tasks=11)
    expected = []
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                cell = ((a[5] ^ b[5]).bit_count(), (a[6] ^ b[6]).bit_count(), a[0], b[0])
                expected.append(("same content" if a[1] == b[1] else "same capture" if a[2] == b[2] else "different", *cell))
                if not a[4] and not b[4]:
                    if a[3] and b[3]:
                        expected.append(("burst frames", *cell))
                    elif a[2] != b[2]:
                        expected.append(("different photographs", *cell))
    counts = pd.Series([e[:3] for e in expected]).value_counts().to_dict()
    assert {(r.kind, r.d, r.p): r.pairs for r in evaluate.histogram(got).collect()} == counts
    for kind in {e[0] for e in expected}:
        best = sorted(e[1:] for e in expected if e[0] == kind)[:5]
        assert [(r.d, r.p, r.a, r.b) for r in evaluate.closest_pairs(got, 5).filter(F.col("kind") == kind).orderBy("nth").collect()] == best


def test_cosine_spread_by_definition(spark):
    rows, items = planted(spark, groups=3, per_group=15, noise=0.5)
    got = {r.name: r for r in evaluate.cosine_spread(items, tasks=9).collect()}
    values = {}
    for a in rows:
        for b in rows:
            if a[1] < b[1]:
                values.setdefault(a[4] if a[4] == b[4] else "between", []).append(float(np.dot(a[2], b[2])))
    assert set(got) == set(values)
    for name, v in values.items():
        v.sort()
        assert (got[name].n, round(got[name].min, 6), got[name].median, round(got[name].max, 6)) == (len(v), round(v[0], 6), pytest.approx(v[len(v) // 2], abs=1e-6), round(v[-1], 6))


def grid_rows(n=6, seed=3):
    rng = np.random.default_rng(seed)
    gray = rng.integers(0, 256, size=(n, 1024)) / 255
    return gray, rng.random((n, 72)), rng.integers(0, 256, size=(n, 3072))


def test_pixel_fingerprints_by_definition(spark):
    gray, small, rgb = grid_rows()
    df = spark.createDataFrame(pd.DataFrame({"asset_id": range(6), "gray": list(gray), "gray9x8": list(small), "rgb": [r.tolist() for r in rgb]}))
    for r in pixels.fingerprint(df).collect():
        g, s, c = gray[r.asset_id], small[r.asset_id], rgb[r.asset_id]
        unsigned = lambda v: v % (1 << 64)
        assert unsigned(r.dhash) == sum(1 << (8 * y + x) for y in range(8) for x in range(8) if s[9 * y + x] > s[9 * y + x + 1])
        cos = lambda k, n: math.cos(math.pi * (2 * n + 1) * k / 64)
        block = [sum(g[32 * y + x] * cos(v, y) * cos(u, x) for y in range(32) for x in range(32)) for v in range(8) for u in range(8)]
        median = sorted(block[1:])[31]
        assert unsigned(r.phash) == sum(1 << i for i, b in enumerate(block) if b > median)
        h = 0xCBF29CE484222325
        for byte in [int(max(0, min(255, v * 255))) for v in g] + [int(v) for v in c]:
            h = ((h ^ byte) * 0x100000001B3) % (1 << 64)
        assert unsigned(r.content_hash) == h
        pixel = c.reshape(-1, 3) / 255
        assert r.brightness == pytest.approx(float((pixel @ [0.299, 0.587, 0.114]).mean()))
        assert r.saturation == pytest.approx(float(np.mean([(p.max() - p.min()) / p.max() if p.max() > 0 else 0 for p in pixel])))
        buckets = pd.Series([tuple(int(v * 15) for v in p) for p in pixel]).value_counts()
        assert r.flatness == pytest.approx(buckets.head(8).sum() / 1024)
        laplace = [4 * g[32 * y + x] - g[32 * y + x - 1] - g[32 * y + x + 1] - g[32 * (y - 1) + x] - g[32 * (y + 1) + x] for y in range(1, 31) for x in range(1, 31)]
        assert r.sharpness == pytest.approx(min(1, float(np.std(laplace)) / 0.15))
        edges = [abs(g[32 * y + x + 1] - g[32 * y + x]) + abs(g[32 * (y + 1) + x] - g[32 * y + x]) > 0.12 for y in range(31) for x in range(31)]
        assert r.edge_density == pytest.approx(np.mean(edges))


def test_no_item_is_left_without_a_cluster(spark):
    rows, items = planted(spark, groups=50, per_group=2, noise=0.01)
    placed = emb.leader_clusters(items, 0.93, ceiling=20)
    assert placed.count() == len(rows) and placed.filter("cluster < 0").isEmpty() and placed.select("cluster").distinct().count() == 50
    assert emb.overflow(placed, 20).first().overflow == 60


@pytest.mark.parametrize("n, bits", [(1, 2), (2, 1), (13, 2), (40, 3), (40, 8)])
def test_leave_one_out_learns_from_all_others_in_tree_order(spark, n, bits):
    import hashlib

    rng = np.random.default_rng(n)
    rows = [(lib, i, rng.normal(size=5).tolist(), i % 3) for i in range(n) for lib in ((0, 1) if i < 5 else (0,))]
    df = spark.createDataFrame(rows, "library_id bigint, item_id bigint, embedding array<double>, target int")
    want = {}
    for lib in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lib), key=lambda r: (hashlib.md5(str(r[1]).encode()).hexdigest(), r[1]))
        for p, held in enumerate(own):
            order = sorted((q for q in range(len(own)) if q != p), key=lambda q: (-(p ^ q).bit_length(), q))
            head, binary = heads.Softmax(5), heads.Logistic(5)
            for q in order:
                head.step(np.array(own[q][2]), own[q][3])
                binary.step(np.array(own[q][2]), int(own[q][3] == 0))
            x = np.array(held[2])
            want[lib, held[1]] = (int(head.predict(x).argmax()) if order else -1, binary.score(x) if order else 0.5)
    judged = evaluate.leave_one_out(df, "softmax", bits)
    assert {(r.library_id, r.item_id): r.predicted for r in judged.collect()} == {k: v[0] for k, v in want.items()}
    scored = evaluate.leave_one_out(df.withColumn("target", (F.col("target") == 0).cast("int")), "logistic", bits).collect()
    assert all(r.score == pytest.approx(want[r.library_id, r.item_id][1], abs=1e-12) for r in scored) and len(scored) == len(rows)
    named = {(r.library_id, r.target): (r.tested, r.right) for r in evaluate.each_cluster_named(judged).collect()}
    assert all(tested >= 2 and right <= tested for tested, right in named.values())


def test_triangle_copies_items_by_tasks_and_meets_every_pair_once(spark):
    for n in (50, 900):
        items = spark.range(n).withColumnRenamed("id", "item_id").withColumn("library", F.col("item_id") % 3)
        placed, keys = evaluate.triangle(items, tasks=18)
        assert placed.count() == 6 * n and keys == ["_lo", "_hi"]
    placed, keys = evaluate.triangle(items, "library", tasks=18)
    assert keys[0] == "library" and placed.count() == 2 * n  # a third of the buckets each

    def met(tiles):
        import pandas as pd

        out = [(a, b) for left, right, same in tiles for i, a in enumerate(left["item_id"]) for j, b in enumerate(right["item_id"]) if not same or i < j]
        return pd.DataFrame([(min(p), max(p)) for p in out], columns=["a", "b"]).astype("int64")

    small = items.filter("item_id < 90")
    placed, keys = evaluate.triangle(small, "library", tasks=18)
    pairs = [(r.a, r.b) for r in evaluate._grouped(placed, keys, met, "a bigint, b bigint").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in range(90) for b in range(a + 1, 90) if a % 3 == b % 3}


def test_pair_distances_within_blocks(spark):
    rows = [(i, f"c{i % 7}", f"s{i % 5}", i % 4 == 0, i % 6 == 0, (i * 2654435761) % 2**40, (i * 40503) % 2**40, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "item_id bigint, content_hash string, stem string, is_burst boolean, is_screen_like boolean, dhash bigint, phash bigint, library_id bigint")
    total = evaluate.histogram(evaluate.pair_distances(df, block_col="library_id", tasks=9)).filter("kind in ('same content', 'same capture', 'different')").agg(F.sum("pairs")).first()[0]
    assert total == 2 * (30 * 29 // 2)


def test_planes_of_libraries_are_those_of_each_alone(spark):
    rows, one = planted(spark, groups=3, noise=0.3)
    _, two = planted(spark, groups=4, noise=0.3, seed=5, library=1)
    odd = spark.createDataFrame([(2, 900, [1.0, 2.0], 2, "x"), (2, 901, [1.0, 3.0], 2, "x"), (1, 902, None, 2, "x"), (1, 903, [1.0], 2, "x")], ITEMS)
    got = {r.item_id + 10_000 * r.library_id: (r.px, r.py) for r in emb.pca_plane(one.unionByName(two).unionByName(odd), part=40).collect()}
    assert len(got) == one.count() + two.count() + 4
    for lib, alone in ((0, one), (1, two)):
        for r in emb.pca_plane(alone.drop("library_id")).collect():
            assert got[r.item_id + 10_000 * lib] == pytest.approx((r.px, r.py), abs=1e-9)
    assert all(got[k] == (0.0, 0.0) for k in (20_900, 20_901, 10_902, 10_903))


def test_clustering_does_not_depend_on_partitions_or_on_other_libraries(spark):
    _, one = planted(spark, groups=5, per_group=20)
    _, two = planted(spark, groups=7, per_group=40, seed=3, library=1)
    found = lambda df, **kw: {(r.library_id, r.item_id): (r.cluster, round(r.similarity, 9)) for r in emb.leader_clusters(df, 0.93, **kw).collect()}
    whole = found(one.unionByName(two), block=30)
    assert whole == found(one.unionByName(two).repartition(9), block=30)
    assert {k: v for k, v in whole.items() if k[0] == 0} == found(one, block=30) and {k: v for k, v in whole.items() if k[0] == 1} == found(two, block=30)
    both = found(one.unionByName(two), block=100)  # one block in library 0, three in library 1
    assert {k: v for k, v in both.items() if k[0] == 0} == found(one)
    for result in (whole, both):
        assert len(result) == one.count() + two.count() and len(set((k[0], v[0]) for k, v in result.items())) == 12


def test_an_app_of_500_clear_groups_has_500_centroids(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(500, 64))
    rows = [(0, 2 * i + k, (c + 0.01 * rng.normal(size=64)).tolist(), 2, "many") for i, c in enumerate(centres / np.linalg.norm(centres, axis=1, keepdims=True)) for k in (0, 1)]
    items = spark.createDataFrame(rows, ITEMS)
    for options in ({}, {"block": 200}, {"ceiling": 150}):
        built = emb.build_centroids(items, threshold=0.9, **options).collect()
        assert len(built) == 500 and {r.sample_count for r in built} == {1000}


def test_vectors_of_another_revision_are_not_clustered(spark):
    _, items = planted(spark)
    old = items.withColumn("revision", F.when(F.col("item_id") % 4 == 0, 1).otherwise(2))
    assert {r.item_id % 4 for r in emb.leader_clusters(old, 0.93).collect()} == {1, 2, 3}


def test_counts_of_codes_are_merged_as_they_double(monkeypatch):
    monkeypatch.setattr(evaluate, "TILE", 2)
    counts, rng, seen = evaluate._Counts(), np.random.default_rng(4), []
    assert [len(v) for v in counts.merged()] == [0, 0]
    for _ in range(30):
        seen.append(rng.integers(0, 60, 12))
        counts.add(seen[-1])
    for got, want in zip(counts.merged(), np.unique(np.concatenate(seen), return_counts=True)):
        assert got.tolist() == want.tolist()
    assert evaluate._bins(np.array([-1.0, 0.0, 1.0, np.nan])).tolist() == [0, evaluate.MILLION, 2 * evaluate.MILLION, evaluate.BINS - 1]


def test_pair_distances_over_many_tiles_and_copies(spark):
    rng = random.Random(3)
    prints = [(rng.getrandbits(62), rng.getrandbits(62)) for _ in range(500)]
    rows = [(i, "copy" if i % 3 == 0 else f"c{rng.randrange(3000)}", f"s{i // 3}", i % 5 == 0, i % 4 == 0, *(prints[0] if i % 3 == 0 else rng.choice(prints))) for i in range(4500)]
    df = spark.createDataFrame(rows, "item_id bigint, content_hash string, stem string, is_burst boolean, is_screen_like boolean, dhash bigint, phash bigint")
    got = evaluate.pair_distances(df, tasks=2)
    # tasks of few rows are long here, so they may not be merged
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    ids, content, stem, burst, screen = (np.array([r[k] for r in rows]) for k in range(5))
    i, j = np.triu_indices(len(rows), 1)
    code = sum((65, 1)[k] * np.bitwise_count((h := np.array([r[5 + k] for r in rows]))[i] ^ h[j]).astype(np.int64) for k in range(2))
    same, capture, photos, bursts = content[i] == content[j], stem[i] == stem[j], ~screen[i] & ~screen[j], burst[i] & burst[j]
    masks = {
        "same content": same, "same capture": ~same & capture, "different": ~same & ~capture,
        "burst frames": photos & bursts, "different photographs": photos & ~bursts & ~capture,
    }
    cells, best = evaluate.histogram(got).collect(), evaluate.closest_pairs(got).collect()
    for kind, mask in masks.items():
        counts = np.bincount(code[mask], minlength=65 * 65)
        assert {(r.d, r.p): r.pairs for r in cells if r.kind == kind} == {(c // 65, c % 65): counts[c] for c in np.flatnonzero(counts).tolist()}
        first = np.flatnonzero(mask)[np.lexsort((j[mask], i[mask], code[mask]))[:12]]
        assert [(r.d * 65 + r.p, r.a, r.b) for r in sorted(best, key=lambda r: r.nth) if r.kind == kind] == list(zip(code[first].tolist(), i[first].tolist(), j[first].tolist()))


def test_small_label_blocks_copy_no_more_rows_than_large_ones(spark):
    rng = random.Random(2)
    rows = [(0, i, [rng.gauss(0, 1) for _ in range(4)], 2, "x") for i in range(600)]
    items = spark.createDataFrame(rows, ITEMS)
    known = spark.createDataFrame([(0, f"n{i % 70}", 2, x) for _, i, x, _, _ in rows if i % 10 == 0], "library_id bigint, name string, revision int, centroid array<double>")
    left, right, _ = emb._label_blocks(items, known, (), 50, 3)
    assert (left.count(), right.count()) == (600, 60)
    whole, cut = (sorted(map(tuple, emb.best_labels(items, known, **size).collect())) for size in ({}, {"team": 50, "chunk": 3}))
    assert whole == cut


def test_passes_of_a_judged_fold_are_not_all_sorted_at_once(spark, monkeypatch):
    _, items = planted(spark, groups=3, per_group=6)
    df = items.withColumn("target", F.regexp_extract("app", "([0-9]+)", 1).cast("int"))
    sorted_at_once, fold = [], heads.fold
    monkeypatch.setattr(heads, "fold", lambda examples, *a: sorted_at_once.append(examples.groupBy("fold", "item_id").count().agg(F.max("count")).first()[0]) or fold(examples, *a))
    at_once = sorted(map(tuple, evaluate.half_hold_out(df, epochs=5).collect()))
    monkeypatch.setattr(evaluate, "PASS_ROWS", 250)  # nine items learn for all of eight folds and nine for seven: 135 examples
    assert sorted(map(tuple, evaluate.half_hold_out(df, epochs=5).collect())) == at_once and sorted_at_once == [5, 1, 1, 1, 1, 1]
