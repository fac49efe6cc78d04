"""The registered queries: SQL on the small tables, and their plans."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from chronosift.llm import catalog
from compare import connect, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")


@pytest.mark.parametrize("name", sorted(catalog.all_oracles()))
def test_sql(spark, name):
    assert difference(catalog.QUERIES[name](spark, SF), connect(SF), catalog.all_oracles()[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.all_oracles())))
def test_rows(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert catalog.QUERIES[name](spark, SF).count() >= docs


def test_all_registered():
    assert {*catalog.QUERIES, "pipeline"} <= set(entry.queries())
    assert len(catalog.QUERIES) == 13


@pytest.mark.parametrize("name", ["op2_quality_rules", "op4_secrets", "op5_sharding", "op10_mixing"])
def test_native(spark, name, monkeypatch):
    """Written intermediate tables are looked at too."""
    import importlib
    plans = []
    import chronosift.session as session
    real = session.pinned

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)
    for module in ("chronosift.llm.quality", "chronosift.llm.sharding", "chronosift.llm.mixing", "chronosift.operators.ordinal"):
        monkeypatch.setattr(importlib.import_module(module), "pinned", watched)
    df = catalog.QUERIES[name](spark, SF)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        for python in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert python not in plan


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names, name
        path = os.path.join(spark.conf.get("spark.checkpoint.dir"), f"stage-{name}-{os.getpid()}")
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if name == "language":
            assert docs.count() == before           # all of them are in one of the languages
        if name == "near_duplicates":
            assert docs.count() < before
            assert docs.select("text").distinct().count() == docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
    assert last.filter("piece = 0").count() == docs.count()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = catalog.QUERIES["op3_language"](spark, sf).filter("held_out").join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.filter("lang_pred = lang").count() >= 0.97 * found.count()
