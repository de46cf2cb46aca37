import pytest
from conftest import SF
from llm.helpers import DOC_SCHEMA, ODD, docs

import corpus_pipeline
from shoebox.llm import near_copies, pii, quality, repeats
from shoebox.llm.common import table
from llm.test_packing import check_pieces
from llm.test_near_copies import components, pairs_by_definition
from llm.test_passages import by_definition as passages_by_definition


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))


@pytest.fixture(scope="module")
def stages(spark):
    out = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_all_but_the_last_stage_return_documents(stages):
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert after.columns == list(corpus_pipeline.COLUMNS) and [t for _, t in after.dtypes] == [t for _, t in stages[0].dtypes]
        assert 0 < after.count() <= before.count()


def test_quality_takes_what_scores(spark, stages):
    scored = quality.score_documents(stages[0], table(spark, SF, "labels")).filter("keep").select("doc_id").collect()
    assert {r.doc_id for r in scored} == {r.doc_id for r in stages[1].collect()}


def test_one_of_each_group_stays(stages):
    before = rows_of(stages[1])
    label = components(len(before), pairs_by_definition([r.text for r in before]))
    assert rows_of(stages[2]) == [r for i, r in enumerate(before) if label[i] == i]


def test_repeats_are_cut(stages):
    before, after = rows_of(stages[2]), rows_of(stages[3])
    want = passages_by_definition([r.text for r in before], 51, 400)
    assert [r.text for r in after] == want and all(r.n_chars == len(r.text) for r in after)


def test_personal_data_is_masked(stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    assert [r.doc_id for r in before] == [r.doc_id for r in after]
    for old, new in zip(before, after, strict=True):
        assert (old.text == new.text) or "<" in new.text
        assert all(old.text[s:e] not in new.text for k, s, e in pii.base_spans(old.text) if k == 0)


def test_all_that_is_left_is_packed(stages):
    last = rows_of(stages[4])
    number = {r.doc_id: i for i, r in enumerate(last)}

    class Piece:
        def __init__(self, r):
            self.__dict__.update(r.asDict(), doc_id=number[r.doc_id])

    check_pieces([Piece(r) for r in stages[5].collect()], [r.text for r in last])


def test_run_is_its_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).groupBy("doc_id").sum("length").count() == stages[4].count()


def test_odd_documents_pass_through_every_stage(spark, tmp_path):
    frame = docs(spark, ODD, lang=[None] * len(ODD), source=[None] * len(ODD)).unionByName(spark.createDataFrame([(None, "some text here", None, None, None)], DOC_SCHEMA))
    for kind, rows in (("odd", frame), ("none", frame.limit(0))):
        folder = str(tmp_path / kind)
        rows.selectExpr("*", "'x' keep", "1 score", "2 places").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        n = corpus_pipeline.run(spark, folder).count()
        assert (n > 0) == (kind == "odd")
    assert repeats.without_repeats(frame).count() == frame.count() and near_copies.one_per_group(frame).filter("doc_id is null").count() == 1
