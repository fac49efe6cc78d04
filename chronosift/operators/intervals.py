"""Rows whose position lies in one of many ranges ``[start, end)``.

Ranges are a table: overlapping and touching ones are merged to disjoint ones without bringing
them together in one task, cut at bucket borders, and joined with the rows by bucket. A row
thus meets the few ranges of its bucket, however many there are. A range with a null bound, or
that ends before it begins, holds nothing; parts below 0 are empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronosift.operators.ordinal import small_side
from chronosift.session import pinned

Ranges = Sequence[tuple[int, int]] | DataFrame

# Positions per bucket: after merging at most half as many ranges begin in one.
BUCKET = 4096
# So many ranges of a list are written out as tests, which may reach the scan.
TESTS = 32


def range_table(spark: SparkSession, ranges: Ranges) -> DataFrame:
    """``start, end`` as long of the ranges that hold something."""
    rows = (ranges.toDF("start", "end") if isinstance(ranges, DataFrame)
            else spark.createDataFrame([tuple(r) for r in ranges], "start bigint, end bigint"))
    return rows.select(F.greatest(F.col("start").cast("bigint"), F.lit(0).cast("bigint")).alias("start"),
                       F.col("end").cast("bigint").alias("end"),
                       F.col("start").isNotNull().alias("_given")).filter("_given and end > start").drop("_given")


def merged(ranges: DataFrame) -> DataFrame:
    """Disjoint ``start, end`` that hold the same positions.

    Ranges are put in order by range partitioning. A range opens a new one when it starts
    beyond all ends before it: the largest end of the earlier partitions is one number for each
    of them, the rest is a running maximum inside the partition.
    """
    placed = pinned(ranges.groupBy("start").agg(F.max("end").alias("end")).repartitionByRange("start")
                    .select("*", F.spark_partition_id().alias("_part")))
    # One row per shuffle partition.
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    reach = placed.groupBy("_part").agg(F.max("end").alias("_reach")).select(
        "_part", F.max("_reach").over(parts).alias("_reach"))
    inside = Window.partitionBy("_part").orderBy("start")
    before = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    opened = placed.join(F.broadcast(reach), "_part").withColumn(
        "_opens", F.when(before >= F.col("start"), 0).otherwise(1))
    counted = pinned(opened.select("_part", "start", "end", F.sum("_opens").over(inside).alias("_nth")))
    totals = counted.groupBy("_part").agg(F.max("_nth").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(parts), F.lit(0)).alias("_earlier"))
    return counted.join(F.broadcast(totals), "_part").groupBy(
        (F.col("_earlier") + F.col("_nth")).alias("_range")).agg(
        F.min("start").alias("start"), F.max("end").alias("end")).drop("_range")


def _merged_list(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[list[int]] = []
    for start, end in sorted((max(a, 0), b) for a, b in ranges if a is not None and b is not None):
        if end <= start:
            continue
        if found and start <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([start, end])
    return [(a, b) for a, b in found]


def in_ranges(rows: DataFrame, position: str, ranges: Ranges) -> DataFrame:
    """``rows`` whose ``position`` is in one of the ranges; each row once.

    ``rows`` are read twice: for their last position, up to which ranges are cut, and for
    the join."""
    if not isinstance(ranges, DataFrame):
        ranges = _merged_list(ranges)
        if len(ranges) <= TESTS:
            wanted = F.lit(False)
            for start, end in ranges:
                wanted = wanted | F.col(position).between(start, end - 1)
            return rows.filter(wanted)
    last = rows.agg(F.max(position)).first()[0]
    if last is None:
        return rows.filter(F.lit(False))
    spans = merged(range_table(rows.sparkSession, ranges).filter(F.col("start") <= last))
    end = F.least(F.col("end"), F.lit(last + 1).cast("bigint"))
    width = F.lit(BUCKET).cast("bigint")
    cut = spans.select("start", end.alias("end")).select("start", "end", F.explode(F.sequence(
        F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_bucket"))
    parts = cut.select(
        "_bucket", F.greatest(F.col("start"), F.col("_bucket") * width).alias("_from"),
        (F.least(F.col("end"), (F.col("_bucket") + 1) * width) - 1).alias("_upto"))
    parts = small_side(pinned(parts))
    at = F.col(position)
    keyed = rows.withColumn("_bucket", F.floor(at / width))
    # Ranges are disjoint, so that a row finds one at most.
    return keyed.join(parts, (keyed["_bucket"] == parts["_bucket"]) & at.between(F.col("_from"), F.col("_upto")),
                      "left_semi").drop("_bucket")
