"""Stages of the pipeline on a small table with nulls, repeats and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronosift.llm import jaccard


def test_clashing_columns(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (3, None), (None, "seven"), (2, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_cls", "_head", "_row", "cls", "links", "label"):
        docs = docs.withColumn(name, F.lit(name))
    got = jaccard.first_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r._cls) for r in got.collect() if r.text) == [
        (0, "seven", "_cls"), (1, "one two three four five six", "_cls")]
    assert got.filter("text is null").count() == 1


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang in ('en', 'fr')").limit(80)
    names = table.columns
    odd = [(-1, "zxq wvk qqzj xkcdw pfft grbl zzt qwk jjx vvk plm krr " * 3), (-2, None), (-3, ""), (-4, "1234 5678"),
           (-5, "これは日本語の文章です。モデルは知りません。" * 5)]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    for n in names:
        if n not in more.columns:
            more = more.withColumn(n, F.lit(None).cast(table.schema[n].dataType))
    return table.unionByName(more.select(*names)).withColumn("_row", F.lit(7)).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(0))


def test_language_stage(spark, docs):
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert not ids & {-2, -3, -4, -5} and ids - {-1} == {r[0] for r in docs.filter("doc_id >= 0").select("doc_id").collect()}


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_take_anything(spark, docs, at):
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, "")
    if name != "pack":
        assert out.columns == docs.columns
    assert out.count() > 0
    assert stage(spark, docs.filter("doc_id is null"), "").count() == 0


def test_rows_carry_their_text_once(spark, docs):
    from chronosift.llm import langid
    model = langid.prototypes(docs)
    got = langid.predict_rows(docs, model)
    scan = next(n for n in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project" in n)
    assert "AS _text" not in scan
    row = F.struct(*docs.columns).alias("_row")
    want = langid.predict(docs, model, [row])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
