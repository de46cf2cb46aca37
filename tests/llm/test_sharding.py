import zlib
from collections import Counter

import duckdb
import pytest
from compare import check
from llm.helpers import ODD, docs

from shoebox.llm import sharding
from shoebox.llm.sharding import node_weights, place, shard_documents, uniform_tree, write_shards


def placed(spark, keys, leaves):
    frame = spark.createDataFrame([(str(k),) for k in keys], "k string")
    return {r.k: r.at for r in frame.select("k", place(frame.k, leaves).alias("at")).collect()}


def test_law_sizes_and_slots(spark):
    rows = shard_documents(docs(spark, [f"text {i}" for i in range(3000)])).collect()
    assert {r.shard for r in rows} == set(range(40)) and all(r.law == "key" for r in rows)
    assert all(r.grown_shard in (r.shard, 40) for r in rows) and 30 < sum(r.grown_shard == 40 for r in rows) < 130
    for shard, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n)) and 35 < n < 120
    assert all(r.size == len(f"text {r.doc_id}") + 16 and r.text_crc32 == zlib.crc32(f"text {r.doc_id}".encode()) for r in rows)


def test_slots_of_large_shards_are_numbered_in_slices(spark, monkeypatch):
    frame = docs(spark, ["a", "b"] * 400)
    whole = sorted(map(tuple, shard_documents(frame, 3).collect()))
    small = sharding.numbered
    monkeypatch.setattr(sharding, "numbered", lambda *a: small(*a, bound=50))
    assert sorted(map(tuple, shard_documents(frame, 3).collect())) == whole


def test_movement_stays_in_subtrees_whose_weight_changed(spark):
    old = {"a.x.1": 1.0, "a.x.2": 2.0, "a.y.3": 1.0, "b.z.4": 3.0, "c.v.5": 1.0}
    new = old | {"a.x.2": 4.0}
    before, after = placed(spark, range(4000), old), placed(spark, range(4000), new)
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    assert moved and all(to.startswith("a") for _, to in moved)  # only towards what gained
    assert not any(a.startswith("a.y") and b.startswith("a.y") for a, b in moved)
    within_b = {k for k in before if before[k].startswith("b")} - {k for k in after if after[k].startswith("b")}
    assert all(after[k].startswith("a") for k in within_b)
    gone = placed(spark, range(4000), {k: w for k, w in old.items() if k != "c.v.5"} | {"c.v.5": 0.0})
    assert all(gone[k] == before[k] for k in before if not before[k].startswith("c"))


def test_shares_follow_weights(spark):
    leaves = {"0.0.0": 1.0, "0.1.1": 3.0, "1.2.2": 4.0}
    n = Counter(placed(spark, range(8000), leaves).values())
    for leaf, weight in leaves.items():
        assert abs(n[leaf] - 1000 * weight) < 150
    assert node_weights(leaves)[0] == {"": {"0": 4.0, "1": 4.0}}
    with pytest.raises(ValueError):
        node_weights({"0.0.0": 0.0})


def test_odd_rows(spark):
    frame = docs(spark, [*ODD, "same"]).unionByName(docs(spark, ["again", "again"]).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars"))
    frame = frame.unionByName(frame.filter("doc_id = 3")).selectExpr("*", "1 shard", "2 slot", "'x' size")
    rows = shard_documents(frame).collect()
    assert len(rows) == frame.count() and next(r for r in rows if r.doc_id == 0).size == 16 and next(r for r in rows if r.doc_id == 0).text_crc32 == 0
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert shard_documents(frame.limit(0)).collect() == []
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(r.doc_id, r.text) for r in frame.collect()])
    assert check(con, sharding.check_sql(), shard_documents(frame)) is None


def test_written_shards(spark, tmp_path):
    frame = docs(spark, [f"t{i}" for i in range(200)] + [None])
    write_shards(frame, str(tmp_path / "out"), 7, rows_per_file=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda x: x[0])
    want = placed(spark, range(201), uniform_tree(7))
    assert all(want[str(r.doc_id)] == f"{r.region}.{r.rack}.{r.shard}" for r in back.collect())
