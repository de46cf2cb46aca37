import random
from collections import defaultdict

import numpy as np
import pytest
from compare import check, duck
from conftest import SF

from shoebox.llm import binary_search, vector_search
from shoebox.llm.common import table

SCHEMA = "vec_id bigint, embedding array<float>"


def code_rows(seed, n):
    rnd = random.Random(seed)
    centers = [rnd.getrandbits(64) for _ in range(4)]
    codes = [rnd.choice(centers) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) if rnd.random() < 0.7 else rnd.getrandbits(64) for _ in range(n)]
    codes += [centers[0]] * 40
    return [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]


@pytest.mark.parametrize("n, k", [(300, 5), (3, 20), (900, 20)])
def test_codes_equal_brute_force(spark, n, k):
    rows = code_rows(n, n)
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id bigint, code bigint, rank string, distance int")
    got = defaultdict(list)
    for r in binary_search.nearest_codes(frame, frame.filter("vec_id % 7 = 0"), k).collect():
        got[r.query_id].append((r.rank, r.distance, r.vec_id))
    for i, c in rows:
        if i % 7 == 0:
            want = sorted((((c ^ o) & ((1 << 64) - 1)).bit_count(), j) for j, o in rows if j != i)[:k]
            assert sorted(got[i]) == [(n + 1, *w) for n, w in enumerate(want)]


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0]), (7, [1.0] * 70), (8, [1.0, -1.0])]
    codes = binary_search.sign_codes(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.vec_id, r.code & (2**64 - 1)) for r in codes.collect()) == [(0, 1), (7, (2**64 - 1) ^ 63), (8, 1)]
    assert binary_search.nearest_codes(codes.limit(0), codes.limit(0), 3).collect() == []


def test_codes_equal_sql(spark):
    codes = binary_search.sign_codes(table(spark, SF, "embeddings"))
    assert check(duck(SF), binary_search.CHECK_SQL, binary_search.nearest_codes(codes, codes.filter("vec_id % 20 = 0"), 20)) is None


def recall(rows, got, k, every):
    """Share of the exact neighbours found; checks scores, order, ranks and that no query misses rows."""
    by_query = defaultdict(list)
    for r in got:
        by_query[r.query_id].append(r)
    vectors = dict(rows)
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], dtype=np.float32).astype(np.float64)
    hits = total = 0
    for q in ids[ids % every == 0]:
        mine = sorted(by_query[q], key=lambda r: r.rank)
        scores = x @ x[np.searchsorted(ids, q)]
        want = [int(ids[j]) for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
        assert [r.rank for r in mine] == list(range(1, len(want) + 1))
        assert [(r.score, r.vec_id) for r in mine] == sorted([(r.score, r.vec_id) for r in mine], key=lambda t: (-t[0], t[1]))
        assert all(abs(r.score - scores[np.searchsorted(ids, r.vec_id)]) < 1e-9 for r in mine)
        hits, total = hits + len(set(want) & {r.vec_id for r in mine}), total + len(want)
    return hits / total


def test_vectors_recall(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(1500, 24)), rng.normal(size=24) + 0.05 * rng.normal(size=(700, 24)), np.tile(rng.normal(size=24), (60, 1))]) * rng.uniform(0.5, 2, (2260, 1)).round(1)
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    got = vector_search.nearest_vectors(spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA + ", rank string, score double"), 20, 20).collect()
    assert recall(rows, got, 20, 20) >= 0.9


def test_vectors_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    assert recall(rows, vector_search.nearest_vectors(table(spark, "/root/testdata/sf0.01", "embeddings"), 20, 20).collect(), 20, 20) >= 0.9


def test_shelves_hold_their_bound():
    sizes = {0: 10, 1: vector_search.SHELF - 5, 2: 3 * vector_search.SHELF + 1, 3: 7, 5: vector_search.SHELF}
    first, pieces = vector_search.shelves(sizes, 6)
    assert first == [0, 1, 2, 6, 6, 7] and pieces == [1, 1, 4, 1, 1, 1]


def test_small_shelves_and_teams(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SHELF", 60)
    monkeypatch.setattr(vector_search, "TEAM", 7)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(600, 8)), rng.normal(size=8) + 0.01 * rng.normal(size=(300, 8))])
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    assert recall(rows, vector_search.nearest_vectors(spark.createDataFrame(rows, SCHEMA), 20, 5).collect(), 20, 5) >= 0.9


def grouped_vectors(seed, sizes, dims=16, noise=0.02):
    rng = np.random.default_rng(seed)
    x = np.vstack([c + noise * rng.normal(size=(n, dims)) for n, c in zip(sizes, rng.normal(size=(len(sizes), dims)), strict=True)])
    return [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x[rng.permutation(len(x))])]


def test_queries_in_tiny_groups_go_on_to_further_lists(spark):
    rows = grouped_vectors(5, [900, 800, 700, 485, 15, 6, 3])
    got = vector_search.nearest_vectors(spark.createDataFrame(rows, SCHEMA), 20, 1).collect()
    per_query = defaultdict(int)
    for r in got:
        per_query[r.query_id] += 1
    assert len(per_query) == len(rows) and set(per_query.values()) == {20}


def test_recall_with_many_lists_and_ties(spark):
    rows = grouped_vectors(6, [500] * 18, noise=0.4)  # 9,000 vectors: 17 lists
    rows += [(9000 + i, rows[40 * i][1]) for i in range(60)]  # equal vectors tie at every place
    assert recall(rows, vector_search.nearest_vectors(spark.createDataFrame(rows, SCHEMA), 20, 20).collect(), 20, 20) >= 0.9


def test_few_odd_and_no_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (3, [None, 2.0]), (100, [1.0, 2.0, 3.0]), (5, [])]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vector_search.nearest_vectors(frame, 2, 20).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0)]
    assert vector_search.nearest_vectors(frame.limit(0), 2, 20).collect() == []
