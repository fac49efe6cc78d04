"""Time statistics and histograms."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.functions import timeparse
from chronosift.functions.text import col
from chronosift.plans.event_table import EventTable
from chronosift.session import pinned

# Bucket widths in seconds, 1 second to 50 years of 360 days.
WIDTHS = (
    1, 2, 5, 10, 30, 60, 300, 600, 1800, 3600, 7200, 10800, 21600, 43200, 86400,
    172800, 432000, 864000, 2592000, 15552000, 31104000, 62208000, 155520000,
    311040000, 622080000, 1555200000)
MAX_BUCKETS = 100
EMPTY_SPAN_WIDTH = 300
# For each width, the seconds that divide it and all wider ones.
FINE_WIDTHS = tuple(math.gcd(*WIDTHS[i:]) for i in range(len(WIDTHS)))


@dataclass(frozen=True)
class TimeStats:
    min_ms: int | None
    max_ms: int | None
    n: int


def time_stats_frame(table: EventTable) -> DataFrame:
    """One row: first and last event time and the number of rows with a time."""
    when = col(table.EVENT_MS)
    return table.df.agg(F.min(when).alias("min_ms"), F.max(when).alias("max_ms"),
                        F.count(when).alias("n"))


def time_stats(table: EventTable) -> TimeStats:
    row = time_stats_frame(table).first()
    return TimeStats(row["min_ms"], row["max_ms"], row["n"])


def column_time_range(table: EventTable, name: str) -> DataFrame:
    """First and last time over the raw values of any named column."""
    when = timeparse.millis(col(name), table.df.schema[name].dataType, table.ingest_zone,
                            table.session_zone)
    return table.df.agg(F.min(when).alias("min_ms"), F.max(when).alias("max_ms"))


def choose_width(start_ms: int, end_ms: int, max_buckets: int = MAX_BUCKETS) -> int:
    """Seconds per bucket: the smallest width that needs at most ``max_buckets``."""
    if end_ms <= start_ms:
        return EMPTY_SPAN_WIDTH
    span = max((end_ms - start_ms) // 1000, 1)
    return next((w for w in WIDTHS if -(-span // w) <= max_buckets), WIDTHS[-1])


def width_column(start_ms: Column, end_ms: Column, max_buckets: int = MAX_BUCKETS) -> Column:
    """``choose_width`` of every row; null where a bound is."""
    span = F.greatest(F.floor((end_ms - start_ms) / 1000), F.lit(1))
    fits = F.filter(F.array(*map(F.lit, WIDTHS)), lambda w: F.ceil(span / w) <= max_buckets)
    width = F.when(end_ms <= start_ms, F.lit(EMPTY_SPAN_WIDTH)).otherwise(F.coalesce(F.get(fits, F.lit(0)), F.lit(WIDTHS[-1])))
    return F.when(start_ms.isNotNull() & end_ms.isNotNull(), width).cast("int")


def bucket_counts(table: EventTable, width_s: int) -> DataFrame:
    """Counts of the buckets that have rows. Partial counts are made before the
    shuffle, so only one small row per bucket and task moves."""
    when = col(table.EVENT_MS)
    return (table.df.filter(when.isNotNull())
            .groupBy(_bucket(when, width_s).alias("bucket_start_ms"))
            .agg(F.count(F.lit(1)).alias("n")))


def _bucket(event_ms: Column, width_s: int) -> Column:
    """Whole-number floor, exact for any bigint."""
    width = F.lit(width_s * 1000).cast("bigint")
    return event_ms - F.pmod(event_ms, width)


def fine_width(first_ms: int, last_ms: int) -> int:
    """Seconds by which times of this span may be counted before the span of all is known:
    they divide the width of every span that holds this one."""
    span = max((last_ms - first_ms) // 1000, 1)
    return next((f for w, f in zip(WIDTHS, FINE_WIDTHS) if -(-span // w) <= MAX_BUCKETS), FINE_WIDTHS[-1])


def _fine_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task, made coarser as its span grows: some two hundred rows at most,
    but for spans beyond a hundred of the widest buckets."""
    starts, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = last = None
    for batch in batches:
        times = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
        if not len(times):
            continue
        low, high = int(times.min()), int(times.max())
        first, last = (low, high) if first is None else (min(first, low), max(last, high))
        step = fine_width(first, last) * 1000
        new, n = np.unique(times // step, return_counts=True)
        starts, place = np.unique(np.concatenate([starts // step, new]) * step, return_inverse=True)
        old, counts = counts, np.zeros(len(starts), dtype=np.int64)
        np.add.at(counts, place, np.concatenate([old, n]))
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(starts), pa.array(counts), pa.array([first] * len(starts)), pa.array([last] * len(starts))],
            names=["bucket_start_ms", "n", "first_ms", "last_ms"])


def fine_counts(table: EventTable) -> DataFrame:
    """Counts in buckets fine enough for any width that the whole span may ask for, with first
    and last time, in one scan of the time column."""
    when = col(table.EVENT_MS)
    parts = table.df.filter(when.isNotNull()).select(when.alias("ms")).mapInArrow(
        _fine_counts, "bucket_start_ms bigint, n bigint, first_ms bigint, last_ms bigint")
    return parts.groupBy("bucket_start_ms").agg(
        F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


def histogram(table: EventTable, width_s: int | None = None, zeros: bool = True) -> DataFrame:
    """Every bucket from the first to the last, or without ``zeros`` those that have rows.

    The range is the after/before bounds where given, else the data. The table is read once:
    by the width if that follows from the arguments, else in buckets that are made wider as
    the span of a task grows. Only those counts are written down and read again.
    """
    spark = table.df.sparkSession
    after, before = table.after_ms, table.before_ms
    if width_s is None and after is not None and before is not None:
        width_s = choose_width(after, before)
    if width_s:
        counts = pinned(bucket_counts(table, width_s))
        low, high = "bucket_start_ms", "bucket_start_ms"
    else:
        counts = pinned(fine_counts(table))
        low, high = "first_ms", "last_ms"
    span = counts.agg(F.min(low).alias("low"), F.max(high).alias("high")).first()
    if span["low"] is None:
        return spark.createDataFrame([], "bucket_start_ms bigint, n bigint")
    start = after if after is not None else span["low"]
    end = before if before is not None else span["high"]
    width = width_s or choose_width(start, end)
    counts = counts.groupBy(_bucket(F.col("bucket_start_ms"), width).alias("bucket_start_ms")).agg(F.sum("n").alias("n"))
    if not zeros:
        return counts
    step = width * 1000
    first, last = start // step * step, end // step * step
    series = spark.range(first, last + step, step).select(F.col("id").alias("bucket_start_ms"))
    return (series.join(counts, "bucket_start_ms", "left")
            .select("bucket_start_ms", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def time_profile(table: EventTable, name: str) -> DataFrame:
    """Rows per accepted time shape of a text column; NULL for unreadable values."""
    return (table.df.groupBy(timeparse.rung_of(col(name)).alias("rung"))
            .agg(F.count(F.lit(1)).alias("n")))


def validate_time_column(table: EventTable, name: str) -> tuple[bool, str]:
    """Whether the column exists and its first value reads as a time."""
    from chronosift.functions.text import is_blank, resolve
    column = resolve(name, table.columns)
    if column is None:
        return False, f"column {name!r} not found"
    kind = table.df.schema[column].dataType
    first = (table.df.filter(~is_blank(col(column))).orderBy(col(table.ROW_INDEX))
             .select(col(column).cast("string").alias("v"),
                     timeparse.millis(col(column), kind, table.ingest_zone,
                                      table.session_zone).alias("ms"))
             .first())
    if first is None:
        return False, f"column {column!r} has no values"
    if first["ms"] is None:
        return False, f"unknown time format: {first['v']!r}"
    return True, ""
