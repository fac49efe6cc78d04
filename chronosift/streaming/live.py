"""The same operators on unbounded input, as Structured Streaming queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronosift.functions.text import col, folded
from chronosift.plans.event_table import EventTable


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                 files_per_trigger: int | None = None, **options) -> DataFrame:
    """New files of a directory as a stream. The schema is fixed."""
    reader = spark.readStream.format(fmt).schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_table(stream: DataFrame, row_index: str, **options) -> EventTable:
    """A streaming event table: filters and column choice work as in a batch. The row
    identity has to come with the data."""
    return EventTable.of(stream, row_index=row_index, **options)


def event_time(table: EventTable) -> DataFrame:
    """Rows with a time, and that time as a timestamp for watermarks."""
    when = col(table.EVENT_MS)
    return table.df.filter(when.isNotNull()).withColumn("event_time", F.timestamp_millis(when))


def live_histogram(table: EventTable, width_s: int, late: str = "10 minutes") -> DataFrame:
    """Running bucket counts. Buckets are emitted on change; ``settled_histogram`` reads
    the final counts and ``fill_buckets`` adds the zeros."""
    return (event_time(table).withWatermark("event_time", late)
            .groupBy(F.window("event_time", f"{width_s} seconds").alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.unix_millis("w.start").alias("bucket_start_ms"), "n"))


def live_dedup(table: EventTable, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First arrival per key inside the watermark. This is by arrival, not by order."""
    named = {f"_key{i}": folded(col(k)) for i, k in enumerate(keys)}
    rows = event_time(table).withColumns(named).withWatermark("event_time", late)
    return rows.dropDuplicatesWithinWatermark(list(named)).drop(*named)


def live_annotated(table: EventTable, annotations: DataFrame) -> EventTable:
    """Stream rows with an annotation: a join with the annotation table as it is when a
    micro-batch is planned."""
    marks = (annotations.filter(F.col("file_key") == table.file_key)
             .select(F.col("row_index").alias(table.ROW_INDEX)))
    return replace(table, df=table.df.join(marks, table.ROW_INDEX, "left_semi"), whole=False)


def append_files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there now and append to Parquet files."""
    return (rows.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def write_updates(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there now and write changed buckets, one folder per batch. A batch
    that is repeated after a failure overwrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (counts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .outputMode("update").trigger(availableNow=True).start())


def settled_histogram(spark: SparkSession, path: str) -> DataFrame:
    """Newest count per bucket of a ``write_updates`` folder."""
    updates = spark.read.schema("bucket_start_ms bigint, n bigint, batch_id bigint").parquet(path)
    return updates.groupBy("bucket_start_ms").agg(F.max_by("n", "batch_id").alias("n"))


def fill_buckets(counts: DataFrame, width_s: int) -> DataFrame:
    """Zero buckets between the first and the last one."""
    step = width_s * 1000
    ends = counts.agg(F.min("bucket_start_ms").alias("a"), F.max("bucket_start_ms").alias("b")).first()
    if ends["a"] is None:
        return counts
    series = counts.sparkSession.range(ends["a"], ends["b"] + step, step).select(
        F.col("id").alias("bucket_start_ms"))
    return series.join(counts, "bucket_start_ms", "left").select(
        "bucket_start_ms", F.coalesce("n", F.lit(0)).alias("n"))


