"""Text read in splits that never change, so that a row's place needs no written copy.

How a file is cut depends on settings and on the number of cores at hand. A read here has a
session of its own in which both are fixed when it is opened. The id that a row gets in its
task is then the same in every job, also after a lost executor, and counts per split taken by
one job hold for the rows of another. Counts are taken when a query first needs them, and kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.operators.ordinal import BROADCAST_ROWS, file_path, running_offsets
from chronosift.session import scratch_path

# Splits of files that are cut small.
MOST_SPLITS = 256


def fixed_layout(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` in which the cutting of files into tasks no
    longer follows the cluster's size."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    cores = spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism
    own.conf.set("spark.sql.files.minPartitionNum", str(cores))
    return own


def cut_layout(spark: SparkSession, path: str, least: int) -> SparkSession:
    """A fixed layout that cuts the files below ``path`` small: into splits of ``least`` bytes, or into about ``MOST_SPLITS``
    of them where that would be more, as each is a task in every pass. No split is larger than in ``spark``."""
    own = fixed_layout(spark)
    size = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0] or 0
    usual = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    own.conf.set("spark.sql.files.maxPartitionBytes", str(min(usual, max(least, -(-size // MOST_SPLITS)))))
    return own


def in_order(rows: DataFrame) -> DataFrame:
    """Sorted rows as one partition. They are sorted and written range by range first, so that its
    task reads them one after another and sorts nothing."""
    path = scratch_path(rows.sparkSession, "ranges")
    rows.write.parquet(path)
    read = rows.sparkSession.read.schema(rows.schema)
    ranges = [read.parquet(part) for part in sorted(read.parquet(path).inputFiles())]
    return reduce(DataFrame.union, ranges).coalesce(1) if ranges else rows.limit(0)


def at_home(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` of another session as a DataFrame of ``spark``; the read keeps its layout."""
    nothing = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]).limit(0)
    return nothing.union(df)


def read_lines(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """Lines as ``value`` with their place: ``_file``, ``_start`` of the split, and ``_seq``, which grows in
    reading order in a split and is the same in every job."""
    return read_located(spark, lambda own: own.read.options(**options).text(paths))


def read_located(spark: SparkSession, read: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """What ``read`` gets by a text-like reader of the session that it is given, located."""
    rows = read(fixed_layout(spark)).select(
        "*", file_path().alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"))
    return at_home(spark, rows)


def split_counts(rows: DataFrame) -> DataFrame:
    """Rows and first ``_seq`` of every split, counted when first asked for. One row per split is layout
    metadata; it is kept in the executors' memory, and made again if they are lost."""
    return rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first")).persist()


def few_splits(rows: DataFrame) -> bool:
    """Whether a row for each split of a read is little enough to be sent to all tasks. ``rows`` come
    straight from the read."""
    return len(rows.inputFiles()) + rows.rdd.getNumPartitions() <= BROADCAST_ROWS


def with_stable_ordinal(rows: DataFrame, name: str, counts: DataFrame | None = None) -> DataFrame:
    """0-based row position over the files of a located read, in path order. Nothing is written, and a
    query that doesn't look at the position doesn't count: the keys of the counts are unique, so
    that an unused left join goes. The file stays in ``_file``."""
    counts = split_counts(rows) if counts is None else counts
    shifts = running_offsets(counts, "_n", "_file", "_start").groupBy("_file", "_start").agg(
        F.any_value(F.col("_offset") - F.col("_first")).alias("_shift"))
    # Splits are bounded by files and bytes; the optimizer has their number after counting.
    known = F.broadcast(shifts) if len(rows.inputFiles()) <= BROADCAST_ROWS else shifts
    return rows.join(known, ["_file", "_start"], "left").withColumn(
        name, (F.col("_seq") + F.col("_shift")).cast("bigint")).drop("_start", "_seq", "_shift")
