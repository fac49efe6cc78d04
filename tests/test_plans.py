"""What the plans look like: pushed filters, pruned columns, no Python, no cross joins."""

import contextlib
import io
import os
import re

import pytest

import __spark_entry__ as entry
from chronosift.functions import predicates as P
from chronosift.operators import annotations as A
from chronosift.operators.histogram import bucket_counts, fine_counts
from chronosift.plans.catalog import events, marks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")


def plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def test_time_bounds_reach_the_scan(spark):
    text = plan(events(spark, SF).filter(after="2024-01-05", before="2024-01-06").select("event_id").result(ordered=False))
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in text and "LessThan(ts,2024-01-06T00:00:00.001)" in text
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz", text)
    assert "props" not in text.split("ReadSchema")[1]


def test_dedup_ranks_before_the_shuffle(spark):
    text = plan(events(spark, SF).dedup("event_type").result(ordered=False))
    assert text.count("WindowGroupLimit") >= 2


def test_limit_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(events(spark, SF).sort(("value", True)).limit(5).df)


def test_histogram_reads_one_column_and_counts_before_the_shuffle(spark):
    for counts, partial in ((fine_counts(events(spark, SF)), "partial_sum"), (bucket_counts(events(spark, SF), 60), "partial_count")):
        text = plan(counts)
        assert partial in text and "user_id" not in text and "CartesianProduct" not in text
        assert len(re.findall(r"ReadSchema", text)) == 1


def test_annotations_join_without_a_forced_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(A.annotated(events(spark, SF), marks(spark, SF)).df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" in plan(A.annotated(events(spark, SF), marks(spark, SF)).df)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_joins_and_no_row_python(spark, name):
    if name.startswith(("stream_", "source_json", "file_fingerprints")):
        pytest.skip("runs elsewhere")
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_generated_code_stays_compilable(spark):
    """The JVM does not compile methods over 8000 bytes."""
    t = events(spark, SF).filter(P.any_of(P.term("a"), P.field_eq("props{$.k}", "1")))
    for df in (t.df, t.sort("event_type").limit(3).df, entry.queries()["parse_time"](spark, SF),
               entry.queries()["source_ncsa"](spark, SF), entry.queries()["find_text"](spark, SF)):
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", plan(df, "codegen"))
        assert all(int(s) < 8000 for s in sizes), sizes
