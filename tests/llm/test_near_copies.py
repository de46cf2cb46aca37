import random
from itertools import combinations

from conftest import SF
from llm.helpers import DOC_SCHEMA, ODD, docs
from pyspark.sql import functions as F

import corpus_pipeline
from shoebox.llm import near_copies, simhash
from shoebox.llm.common import table


def set_of(text):
    words = (text or "").encode("utf-8", "replace").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def pairs_by_definition(texts):
    sets = [set_of(t) for t in texts]
    return [(i, j) for (i, a), (j, b) in combinations(enumerate(sets), 2) if a == b or 5 * len(a & b) >= 4 * len(a | b)]


def components(n, pairs):
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        label[b] = a
    return [find(i) for i in range(n)]


def edited(seed, groups, copies=5, most=4):
    rnd = random.Random(seed)
    texts = []
    for _ in range(groups):
        words = [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 900)}" for _ in range(rnd.randint(30, 200))]
        for _ in range(copies):
            own = list(words)
            for _ in range(rnd.randint(0, most)):
                own[rnd.randrange(len(own))] = f"w{rnd.random()}"
            texts.append(" ".join(own))
    return texts


def test_equals_all_pairs(spark):
    texts = edited(1, 60) + ODD + ODD
    want = components(len(texts), pairs_by_definition(texts))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(spark, texts).selectExpr("*", "'x' node", "9 keys", "1 row")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_a_dense_group_is_gathered(spark):
    texts = edited(2, 1, 400, 3) + edited(3, 1, 100, 9)
    want = components(len(texts), pairs_by_definition(texts))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_fingerprints_alone_link_what_is_near_and_similar(spark):
    """Without any band, exactly the similar pairs within 4 bits are linked (alone or through others of their component)."""
    plain = edited(7, 60, 1, 0)
    texts = plain + [f"{t} more" for t in plain] + edited(8, 20) + ODD
    frame = docs(spark, texts).select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    nodes = near_copies.marks(frame).withColumn("keys", F.when(F.size("keys") > 0, F.array("doc_id")).otherwise(F.array().cast("array<bigint>"))).dropDuplicates(["node"]).cache()
    bits = {r.doc_id: r.bits % (1 << 64) for r in nodes.collect()}
    assert all(bits[i] == simhash.fingerprint(texts[i], near_copies.WIDTH) for i in bits)
    sets = {i: set_of(texts[i]) for i in bits}
    near = [(i, j) for i, j in combinations(sorted(bits), 2) if len(sets[i]) > 3 < len(sets[j]) and (bits[i] ^ bits[j]).bit_count() <= 4]
    similar = [(i, j) for i, j in near if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(similar) > 5
    of = {r.node: r.doc_id for r in nodes.collect()}
    label = {of[r.node]: r.label for r in near_copies.linked_nodes(frame, near_copies.with_families(nodes)).collect()}
    got = {(i, j) for i, j in combinations(sorted(label), 2) if label[i] == label[j]}
    assert got == set(similar)


def test_recall_of_bands():
    """Share of the pairs between 0.8 and 0.85 that some band brings together."""
    rnd, bands, met, n = random.Random(4), near_copies.Bands(), 0, 0
    while n < 1500:
        words = [f"w{rnd.random()}" for _ in range(120)]
        own = list(words)
        for _ in range(rnd.randint(2, 3)):
            own[rnd.randrange(len(own))] = f"w{rnd.random()}"
        a, b = near_copies.shingles(" ".join(words)), near_copies.shingles(" ".join(own))
        both = len(set(a.tolist()) & set(b.tolist()))
        if 0.8 <= both / (len(a) + len(b) - both) < 0.85:
            n += 1
            met += bool(set(bands.keys(a)) & set(bands.keys(b)))
    assert met / n >= 0.999


def test_the_stage_drops_edited_copies(spark):
    texts = edited(5, 20)
    frame = docs(spark, texts)
    label = components(len(texts), pairs_by_definition(texts))
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, frame, SF).collect()}
    assert kept == {i for i, x in enumerate(label) if i == x}


def test_repeated_rows_nulls_and_no_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "A b c  d e"), (None, "q r s t u"), (3, None), (4, ""), (7, "zz yy xx ww vv uu")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC_SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in near_copies.near_copies(frame).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (7, 7)]
    assert sorted(r.doc_id or -1 for r in near_copies.one_per_group(frame).collect()) == [-1, 1, 3, 7]
    assert near_copies.near_copies(frame.limit(0)).collect() == []


def test_on_the_table(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    ids = [r.doc_id for r in rows]
    want = components(len(rows), pairs_by_definition([r.text for r in rows]))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(table(spark, SF, "documents")).collect()}
    assert [got[i] for i in ids] == [ids[c] for c in want]


def test_spread_nodes_are_not_broadcast(spark):
    nodes = spark.range(2000).selectExpr("id node", "9 n", "array(id % 7, id % 11) keys")
    plan = near_copies.in_buckets(nodes, 2000)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
