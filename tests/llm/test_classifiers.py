import random
import tracemalloc
import zlib

import numpy as np
import pytest
from conftest import SF
from llm.helpers import DOC_SCHEMA, ODD, docs

from shoebox.llm import language_id, quality
from shoebox.llm.common import table
from shoebox.llm.features import frequencies, mean_weights

LETTERS = {"en": "the of wh th ing ", "de": "sch ein ü ung ", "fr": "é eau ç que ", "es": "ñ os ado ía ", "xx": "qaz wsx zz "}


def prose(rnd, lang, n):
    return "".join(rnd.choice(LETTERS[lang].split(" ")) + rnd.choice(["", " "]) for _ in range(n)) + " a"


def test_scores_are_weighted_frequencies():
    texts, w = ["abc", "", "Ünï x" * 50], np.random.default_rng(1).normal(size=(64, 2)).astype(np.float32)
    assert np.allclose(mean_weights(texts, w, (1, 2, 3)), frequencies(texts, 64, (1, 2, 3)) @ w, atol=1e-4)
    assert np.allclose(mean_weights(texts, w, (2,))[0], mean_weights(["abc"], w, (2,))[0])


def test_languages(spark):
    rnd = random.Random(2)
    langs = [rnd.choice(list(LETTERS)) for _ in range(300)]
    texts = [prose(rnd, k, rnd.randint(20, 80)) for k in langs]
    frame = docs(spark, texts + ODD + ["1 2 3"], lang=langs + [None] * (len(ODD) + 1)).selectExpr("*", "1 score", "'q' lang_pred")
    got = {r.doc_id: r for r in language_id.identify(frame).collect()}
    assert len(got) == len(texts) + len(ODD) + 1
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [i for i in range(300) if got[i].held_out]
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.lang_pred in {*LETTERS, "und"} for r in got.values())
    odd = {text: got[300 + i].lang_pred for i, text in enumerate(ODD)}
    assert all((odd[t] == "und") == (not any(c.isalpha() for c in t or "")) for t in ODD)
    assert len({got[300 + i].score for i, t in enumerate(ODD) if t == "a b c"}) == 1


def test_languages_without_labels_or_rows(spark):
    frame = docs(spark, ["abc", None, "d"], lang=[None] * 3)
    assert [r.lang_pred for r in language_id.identify(frame).collect()] == ["und"] * 3
    assert language_id.identify(frame.limit(0)).collect() == []
    one = docs(spark, ["abc"] * 6, lang=["en"] * 6)
    assert {(r.lang_pred, r.score) for r in language_id.identify(one).collect()} == {("en", 1.0)}


def test_held_out_accuracy(spark):
    frame = table(spark, SF, "documents")
    rows = language_id.identify(frame).join(frame.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def labelled(spark, n=160):
    rnd = random.Random(3)
    good = [prose(rnd, "en", 60) for _ in range(n)]
    junk = [" ".join(["BUY!!"] * rnd.randint(20, 60)) for _ in range(n)]
    texts = [t for pair in zip(good, junk, strict=True) for t in pair]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(n)], "doc_id bigint, quality int, toxic int")
    return texts, labels


def test_quality(spark):
    texts, labels = labelled(spark)
    frame = docs(spark, texts + ODD, source=["a", None] * (len(texts) // 2) + [None] * len(ODD)).selectExpr("*", "'x' score", "1 keep")
    got = {r.doc_id: r for r in quality.score_documents(frame, labels).collect()}
    assert len(got) == len(texts) + len(ODD)
    assert all(got[i].keep == (i % 2 == 0) for i in range(len(texts)))
    blank = [got[len(texts) + i] for i, t in enumerate(ODD) if not (t or "").strip()]
    assert blank and all(r.score == 0 and not r.keep for r in blank)


def test_the_sample_is_fitted_in_a_task(spark):
    """The driver holds neither the sample nor its features."""
    texts, labels = labelled(spark, 400)
    frame = docs(spark, texts)
    tracemalloc.start()
    model = quality.learn(frame, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.text.weights.shape == (quality.DIMS, 1)
    assert peak < len(texts) * quality.DIMS * 4 / 2  # half of the features


def test_quality_needs_both_classes(spark):
    frame = docs(spark, ["a b", None])
    none = spark.createDataFrame([(0, 1, 0), (1, None, None), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert sorted((r.doc_id, r.keep) for r in quality.score_documents(frame, none).collect()) == [(0, True), (1, False)]
    assert quality.score_documents(spark.createDataFrame([], DOC_SCHEMA), none).collect() == []


def test_views_teach_each_other():
    rng = np.random.default_rng(4)
    y = np.repeat([1.0, 0.0], 600)
    text = np.stack([y + rng.normal(0, 0.2, 1200), np.ones(1200)], axis=1).astype(np.float32)
    page = np.stack([y * (rng.random(1200) < 0.9), np.ones(1200)], axis=1).astype(np.float32)
    shown = np.where(np.arange(1200) % 50 < 4, y, -1.0)
    with_pool = quality.co_train(text, page, shown)
    alone = quality.co_train(text, page, shown, rounds=0)
    assert not np.allclose(with_pool[1].weights, alone[1].weights)  # the text view's labels reached the page view
    z = with_pool[2][0] * (with_pool[0].slope * (text @ with_pool[0].weights + with_pool[0].intercept) + with_pool[0].shift)
    assert np.mean((z > 0) == (y > 0)) > 0.9


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_quality_on_labels(spark, folder):
    labels = table(spark, folder, "labels")
    rows = quality.score_documents(table(spark, folder, "documents"), labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in rows]) > 0.97
    assert np.mean([r.keep for r in rows if r.quality == 1]) > 0.99
