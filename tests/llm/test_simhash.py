import random
from itertools import combinations

import pytest
import xxhash
from llm.helpers import DOC_SCHEMA, ODD, docs

from shoebox.llm import simhash


def by_definition(text):
    words, cur = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\r\x0b\x0c":
            words += [cur] if cur else []
            cur = ""
        else:
            cur += c.lower() if "A" <= c <= "Z" else c
    grams = [words[i : i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), seed=42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def components(marks, distance=4):
    """Smallest reachable index for each fingerprint, by trying all pairs."""
    label = list(range(len(marks)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(marks)), 2):
        if (marks[i] ^ marks[j]).bit_count() <= distance:
            a, b = sorted((find(i), find(j)))
            label[b] = a
    return [find(i) for i in range(len(marks))]


def near_texts(seed, n):
    rnd = random.Random(seed)
    texts = []
    for _ in range(n // 6):
        words = [rnd.choice(["alpha", "Beta", "c", "dé", "E", "fgh"]) + str(rnd.randint(0, 40)) for _ in range(rnd.randint(0, 120))]
        for _ in range(6):
            own = list(words)
            for _ in range(rnd.randint(0, 2)):
                if own:
                    own[rnd.randrange(len(own))] = f"w{rnd.random()}"
            texts.append(rnd.choice([" ", "\n", " \t "]).join(own))
    return texts


def test_equals_all_pairs(spark):
    texts = near_texts(1, 240) + ODD + ODD
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts).selectExpr("*", "'x' fingerprint", "9 bits")).collect()}
    marks = [by_definition(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{m:016x}" for m in marks]
    assert [got[i].component_id for i in range(len(texts))] == components(marks)


@pytest.mark.parametrize("chain", [False, True])
def test_dense_groups_and_chains(spark, chain):
    rnd = random.Random(7)
    if chain:  # each four bits from the last, so the ends are far apart
        marks = [0]
        for _ in range(300):
            marks.append(marks[-1] ^ sum(1 << b for b in rnd.sample(range(64), 4)))
    else:  # around two far centers, up to five bits away
        marks = [c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for c in (0, (1 << 64) - 1) for _ in range(250)]
    marks = list(dict.fromkeys(marks))
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    nodes = spark.createDataFrame([(s,) for s in signed], "bits bigint")
    label = {r.bits: r.label for r in simhash.linked_nodes(nodes).collect()}
    found = {}
    for i, c in enumerate(components(marks)):
        found.setdefault(label.get(signed[i], signed[i]), set()).add(c)
    assert all(len(v) == 1 for v in found.values()) and len(found) == len(set(components(marks)))


def test_lower_bound_holds(spark):
    rnd = random.Random(8)
    rows = [(rnd.getrandbits(63), rnd.getrandbits(63)) for _ in range(300)]
    rows += [(a, a ^ (1 << b)) for (a, _), b in zip(rows, range(60), strict=False)]
    spark.createDataFrame(rows, "a bigint, b bigint").createOrReplaceTempView("simhash_pairs")
    bad = spark.table("simhash_pairs").select(simhash.F.bit_count(simhash.embedded("a").bitwiseXOR(simhash.embedded("b"))).alias("l"), simhash.F.expr("bit_count(a ^ b)").alias("h"))
    assert bad.filter("l > h").count() == 0


def test_repeated_rows_nulls_and_stage(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "q r s t u"), (3, None), (4, ""), (7, "zz yy xx ww vv uu")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC_SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(frame).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (7, 7)]
    assert sorted(r.doc_id or -1 for r in simhash.one_per_group(frame).collect()) == [-1, 1, 3, 7]
    assert simhash.near_duplicates(frame.limit(0)).collect() == []


def test_tasks_that_spread_cells_are_bounded(spark):
    from shoebox.llm.common import KEYS_A_TASK
    from shoebox.llm.simhash import within_grid

    count, cells = 100_000, 70  # 8 blocks, 4 of which may differ
    grid = within_grid(spark.range(0, count, 1, 1).selectExpr("xxhash64(id) bits"), count, 4, 8)
    needed = -(-count * cells // KEYS_A_TASK)
    assert "hashpartitioning(bits#" in (plan := grid._jdf.queryExecution().toString()) and f", {needed}), REPARTITION_BY_NUM" in plan


def test_spread_nodes_are_not_broadcast(spark):
    nodes = spark.range(2000).selectExpr("xxhash64(id) bits")
    plan = simhash.within_grid(nodes, 2000, 4, 8)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
