import random

import pytest
from pyspark.sql import functions as F

from chronosift.operators import intervals
from chronosift.operators.intervals import in_ranges, merged, range_table


def covered(ranges, n):
    return sorted({p for a, b in ranges if a is not None and b is not None for p in range(max(a, 0), min(b, n))})


@pytest.mark.parametrize("seed, many, longest", [(1, 200, 10), (2, 60, 900), (3, 400, 2)])
def test_merged(spark, seed, many, longest):
    r = random.Random(seed)
    ranges = [(a, a + r.randrange(longest)) for a in (r.randrange(-20, 3000) for _ in range(many))]
    got = sorted(tuple(x) for x in merged(range_table(spark, ranges)).collect())
    assert got == intervals._merged_list(ranges)
    assert all(b < c for (_, b), (c, _) in zip(got, got[1:]))


def test_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BUCKET", 16)
    rows = spark.range(1000).select(F.col("id").alias("p"), (F.col("id") % 7).alias("start"))
    r = random.Random(4)
    cases = [
        [],
        [(5, 5), (9, 2)],
        [(0, 1)],
        [(990, 1 << 60), (-5, 3)],                          # beyond both ends
        [(0, 1 << 62)] * 50,                                # the same one again
        [(16, 32), (32, 48), (100, 101)],                   # touching, along bucket borders
        [(a, a + r.randrange(30)) for a in (r.randrange(1100) for _ in range(80))],
        [(2 * i, 2 * i + 1) for i in range(500)],
        [(None, 5), (7, None), (3, 4)],
    ]
    for ranges in cases:
        table = spark.createDataFrame(ranges, "a bigint, b bigint")
        for given in (ranges, table):
            out = in_ranges(rows, "p", given)
            assert out.columns == ["p", "start"]
            assert sorted(x.p for x in out.collect()) == covered(ranges, 1000), ranges
    nothing = rows.filter("p < 0")
    assert in_ranges(nothing, "p", spark.createDataFrame([(0, 5)], "a int, b int")).count() == 0


def test_hundred_thousand_ranges(spark):
    """The plan does not grow with the ranges."""
    rows = spark.range(400_000).select(F.col("id").alias("p"))
    ranges = spark.range(100_000).select(F.col("id") * 4, F.col("id") * 4 + 1 + F.col("id") % 2)
    out = in_ranges(rows, "p", ranges)
    assert out.count() == 150_000
    assert len(out._jdf.queryExecution().executedPlan().toString()) < 10_000
