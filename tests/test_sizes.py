"""What a task or the driver holds does not grow with the tables."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shoebox.operators import distributed, embeddings, evaluate, heads, pixels
from shoebox.sources import derived
from shoebox.streaming import jobs


def test_words_of_a_batch_are_split_slice_by_slice():
    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(10)] * 200
    pdf = pd.DataFrame({"doc_id": np.arange(len(texts)), "text": texts})
    tracemalloc.start()
    rows = sum(len(part) for part in derived._simhash_batches([pdf]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts)
    assert peak < 70 << 20


def test_a_chunk_of_grids_is_small():
    assert pixels.CHUNK * 4096 * 8 <= 4 << 20


def test_a_strip_of_a_product_is_small():
    assert embeddings.STRIP * embeddings.CHUNK * 8 <= 8 << 20


def test_large_tables_are_dealt_into_more_tasks(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 300)
    assert distributed.dealt(df, ["k"], 50).rdd.getNumPartitions() == 20
    assert distributed.dealt(df, ["k"]) is df


def test_lines_that_only_add_up_are_not_numbered(spark):
    plan = derived.Library(spark, "/root/testdata/sf0.001").text_lines()._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_passes_that_go_on_from_each_other_are_one_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 2, i, rng.normal(size=6).tolist(), i % 3) for i in range(80)]
    members = spark.createDataFrame(rows, "library_id bigint, item_id bigint, embedding array<float>, target int")
    whole = heads.train_softmax(heads.repeated_passes(members, ["library_id"], 3), ["library_id"], ["pass", "shuffle", "item_id"])
    flat = lambda df: sorted((r.library_id, r.samples, r.per_class, r.bias, r.weights) for r in df.collect())
    assert flat(heads.train_on_members(members, ["library_id"], 3)) == flat(whole)
    model = heads.Softmax(6)
    model.step(np.arange(6.0), 2)
    again = heads.Softmax.restored(np.concatenate([model.bias, model.per_class, model.weights.ravel()]))
    assert again.row() == model.row()


def test_thresholds_swept_side_by_side_equal_each_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(0, i, rng.normal(size=4).tolist(), f"app{i % 3}") for i in range(60)]
    items = spark.createDataFrame(rows, "library_id bigint, item_id bigint, embedding array<double>, app string")
    got = {r.threshold: (r.clusters, r.pure, r.overflow) for r in evaluate.merge_sweep(items, (0.3, 0.8), 7).collect()}
    for t in (0.3, 0.8):
        alone = evaluate.merge_sweep(items, (t,), 7).collect()[0]
        found = embeddings.leader_clusters(items, t, 7)
        assert got[t] == (alone.clusters, alone.pure, alone.overflow)
        assert got[t][0] == found.filter("cluster >= 0").select("cluster").distinct().count()
    keyed = embeddings.leader_pass(items.withColumn("t", F.lit(0.3)), ["library_id", "t"], ["item_id"], "t")
    assert keyed.filter("kind = 'leader'").count() == embeddings.leader_pass(items, ["library_id"], ["item_id"], 0.3).filter("kind = 'leader'").count()


def test_the_fitting_sample_is_filled_in_place():
    from shoebox.llm.features import frequencies

    out = np.zeros((2, 20), dtype=np.float32)
    frequencies(["one text", "another"], 16, (1, 2), out[:, :16])
    assert np.array_equal(out[:, :16], frequencies(["one text", "another"], 16, (1, 2))) and not out[:, 16:].any()


def test_queue_entries_are_stored_by_the_page():
    class Store(dict):
        calls = 0

        def containsKey(self, key):  # noqa: N802
            self.calls += 1
            return key in self

        def getValue(self, key):  # noqa: N802
            return self[key]

        def updateValue(self, key, value):  # noqa: N802
            self.calls += 1
            self[key] = value

        def removeKey(self, key):  # noqa: N802
            del self[key]

    store = Store()
    pages = jobs._Pages(store, 0)
    for i in range(1000):
        pages[i] = (i, "delete")
    pages.write()
    assert store.calls == 4
    later = jobs._Pages(store, 1000)
    assert [later[i] for i in (0, 999, 1000)] == [(0, "delete"), (999, "delete"), None]
    for i in range(256):
        later[i] = None
    later.write()
    assert sorted(store) == [(1,), (2,), (3,)]


def test_shuffle_files_of_written_tables_go(spark):
    """Else those of all steps lie on the disks at once until the driver collects its garbage."""
    import time
    from pathlib import Path

    from pyspark.sql import functions as F
    from shoebox.session import CLEANUP, materialize, materialize_counted

    top = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {p.name for p in top.rglob("shuffle_*.data")}
    rows = spark.range(1000).withColumn("key", F.col("id") % 10)
    before = files()
    written = materialize(rows.groupBy("key").count(), "shuffles")
    counted, seen = materialize_counted(rows.repartition(3, "key"), "shuffles", n=F.count(F.lit(1)))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(CLEANUP) == "false"
    assert seen["n"] == 1000 and counted.count() == 1000 and {r["count"] for r in written.collect()} == {100}
