"""Positions in an order, without bringing the rows together in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosift.session import pinned

# A side of a join is broadcast only when it was counted and found this small.
BROADCAST_ROWS = 1_000_000
# Up to here rows of one result may meet in one task (top-k, one page): each task sends that many.
SINGLE_TASK_ROWS = 10_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``limit`` rows; beyond that
    unchanged, and the join shuffles both sides."""
    over = df.select(F.lit(1)).limit(limit + 1).count() > limit
    return df if over else F.broadcast(df)


def running_offsets(blocks: DataFrame, count: str, *order: str) -> DataFrame:
    """Rows before each block. One row per file split or shuffle partition comes in,
    so this is layout metadata and not data."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn(
        "_offset", F.coalesce(F.sum(count).over(before), F.lit(0)).cast("bigint"))


def _block_offsets(df: DataFrame, block: list[str], within: str) -> DataFrame:
    blocks = df.groupBy(*block).agg(
        F.count(F.lit(1)).alias("_n"), F.min(within).alias("_first"))
    return running_offsets(blocks, "_n", *block).select(*block, "_offset", "_first")


def _shift(df: DataFrame, offsets: DataFrame, block: list[str], name: str, within: str) -> DataFrame:
    return (df.join(offsets, block)
            .withColumn(name, (F.col("_offset") + F.col(within) - F.col("_first")).cast("bigint"))
            .drop("_offset", "_first"))


def number_blocks(df: DataFrame, block: list[str], name: str, within: str) -> DataFrame:
    """Global 0-based positions from a position inside each block.

    ``df`` must be pinned: it is read twice. ``within`` need not start at 0, the
    smallest value of each block is subtracted.
    """
    offsets = pinned(_block_offsets(df, block, within))
    return _shift(df, small_side(offsets), block, name, within)


def file_path() -> Column:
    """The file of a row. Spark's metadata escape blanks and such; names are as they are."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def located(df: DataFrame) -> DataFrame:
    """A text-like read with the place of each row: file, split start, and an id that
    grows in reading order inside the split."""
    return df.select(
        "*",
        file_path().alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"))


def dense(placed: DataFrame, shuffled: bool = False) -> DataFrame:
    """A ``located`` read from which rows were filtered, with ``_seq`` without gaps in a
    split. ``shuffled`` rows have lost the reading order and are counted split by split."""
    if shuffled:
        split = Window.partitionBy("_file", "_start").orderBy("_seq")
        return placed.withColumn("_seq", F.row_number().over(split).cast("bigint"))
    return placed.withColumn("_seq", F.monotonically_increasing_id())


def with_file_ordinal(placed: DataFrame, name: str) -> DataFrame:
    """0-based row position over the files of a ``located`` read, in path order.

    Rows of one split are read one after another by one task; splits are ordered by
    path and start. The read is pinned first because split layout may differ between
    two jobs. The file path stays in ``_file``.
    """
    return number_blocks(pinned(placed), ["_file", "_start"], name, "_seq").drop("_start", "_seq")


def with_parquet_ordinal(df: DataFrame, name: str) -> DataFrame:
    """0-based row position over Parquet files in path order.

    The position inside a file is stored in the file, so no row is shuffled and
    nothing is pinned: one file needs no second pass at all, several need the row
    count of each file, which is read lazily and without any data column.
    """
    in_file = F.col("_metadata.row_index")
    files = df.inputFiles()
    if len(files) <= 1:
        return df.select("*", in_file.alias(name))
    counts = (df.select(in_file.alias("_in_file"), F.input_file_name().alias("_file"))
              .groupBy("_file").agg((F.max("_in_file") + 1).alias("_n")))
    offsets = running_offsets(counts, "_n", "_file").drop("_n")
    if len(files) <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    located_rows = df.select("*", in_file.alias("_in_file"), F.input_file_name().alias("_file"))
    return (located_rows.join(offsets, "_file")
            .withColumn(name, F.col("_offset") + F.col("_in_file"))
            .drop("_offset", "_in_file", "_file"))


def with_position(df: DataFrame, order: list[Column], name: str,
                  partitions: int | None = None) -> DataFrame:
    """0-based position of every row in ``order``.

    The order must be total (it ends with a unique key), which also means that one
    hot value is cut into as many ranges as it needs. Range partitions are sorted
    in place, pinned, and only their row counts are added up.
    """
    spread = (df.repartitionByRange(partitions, *order) if partitions
              else df.repartitionByRange(*order))
    placed = spread.sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_seq"))
    rows = pinned(placed)
    # One row per shuffle partition, so its size is bounded by their number.
    offsets = F.broadcast(_block_offsets(rows, ["_part"], "_seq"))
    return _shift(rows, offsets, ["_part"], name, "_seq").drop("_part", "_seq")


def slice_rows(df: DataFrame, order: list[Column], start: int, end: int,
               single_task: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Rows at positions ``[start, end)`` of a total order.

    Up to ``single_task`` rows a top-k brings the first ``end`` rows together and numbers
    them; beyond that the rows are cut by distributed positions. OFFSET is not used:
    runtime re-planning may take it into account twice and drop a later sort.
    """
    if end <= single_task:
        top = df.orderBy(*order).limit(end)
        if start == 0:
            return top
        numbered = top.withColumn("_nth", F.row_number().over(Window.orderBy(*order)))
        return numbered.filter(F.col("_nth") > start).drop("_nth")
    placed = with_position(df, order, "_nth")
    return placed.filter(F.col("_nth").between(start, end - 1)).drop("_nth")
