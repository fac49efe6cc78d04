"""The merged timeline of all annotated rows of all registered files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.functions.text import col, text
from chronosift.operators.annotations import latest_per_row
from chronosift.plans.event_table import EventTable
from chronosift.session import pinned
from chronosift.sources.directory import SOURCE_COLUMN, relative

# Names of the leading columns of the export.
TIME, PATH, DESCRIPTION, NOTE = (
    "_TT_timestamp", "_TT_filepath", "_TT_file_description", "_TT_note")


def _part(table: EventTable, annotations: DataFrame, path: str, description: str,
          pattern: str) -> DataFrame:
    marks = annotations.filter(F.col("file_key") == table.file_key).select(
        F.col("row_index").alias(table.ROW_INDEX), F.coalesce("note", F.lit("")).alias(NOTE))
    others = [c for c in table.columns if c != table.time_col]
    return table.df.join(marks, table.ROW_INDEX).select(
        table.shown(table.time_col, pattern).alias(TIME),
        F.lit(path).alias(PATH), F.lit(description).alias(DESCRIPTION), NOTE,
        *(text(col(c)).alias(c) for c in others),
        col(table.EVENT_MS).alias("_ms"), col(table.ROW_INDEX).alias("_row"))


def timeline(tables: list[EventTable], annotations: DataFrame, registry: DataFrame,
             pattern: str = "yyyy-MM-dd HH:mm:ss", ordered: bool = True) -> DataFrame:
    """Annotated rows of every table that has a time column, ascending by time; the other
    columns by name. Rows without a readable time come last, by their text.

    Each table is first cut down to its annotated rows, so only those are united and
    sorted.
    """
    usable = [t for t in tables if t.time_col is not None]
    if not usable:
        raise ValueError("no file has a time column")
    # Settled once and not once per table.
    current = pinned(latest_per_row(annotations.filter(F.col("file_key").isin([t.file_key for t in usable]))))
    # One record per table handed in.
    facts = {r["file_key"]: r for r in registry.filter(
        F.col("file_key").isin([t.file_key for t in usable])).collect()}

    def fact(table: EventTable, name: str) -> str:
        return (facts[table.file_key][name] if table.file_key in facts else None) or ""

    parts = [_part(t, current, fact(t, "file_path"), fact(t, "description"), pattern) for t in usable]
    return _settled(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), ordered)


def _settled(united: DataFrame, ordered: bool) -> DataFrame:
    lead = [TIME, PATH, DESCRIPTION, NOTE]
    names = sorted(c for c in united.columns if c not in (*lead, "_ms", "_row"))
    if ordered:
        united = united.orderBy(F.col("_ms").asc_nulls_last(), TIME, PATH, "_row")
    return united.select(*lead, *(F.coalesce(col(c), F.lit("")).alias(c) for c in names))


def folder_timeline(table: EventTable, root: str, annotations: DataFrame, registry: DataFrame,
                    pattern: str = "yyyy-MM-dd HH:mm:ss", ordered: bool = True) -> DataFrame:
    """``timeline`` of a folder opened with its source column, whose files are registered
    and annotated one by one.

    Files of one header are one scan and all files are one join, so the plan does not grow
    with their number, and neither files nor records come to the driver. An annotation's row
    index counts in its file; the folder's rows are numbered file by file, so it is shifted by
    the file's first row. Annotations of rows that a file does not have are left out.
    """
    if table.time_col is None:
        raise ValueError("no file has a time column")
    if SOURCE_COLUMN not in table.df.columns or not table.whole:
        raise ValueError("a whole folder with its source column is needed")
    spark, row = table.df.sparkSession, col(table.ROW_INDEX)
    spans = table.df.groupBy(F.col(SOURCE_COLUMN).alias("_source")).agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    files = registry.select("file_key", F.coalesce("file_path", F.lit("")).alias(PATH),
                            F.coalesce("description", F.lit("")).alias(DESCRIPTION),
                            relative(spark, root, F.col("file_path")).alias("_source")).join(spans, "_source")
    current = latest_per_row(annotations.join(files.select("file_key"), "file_key", "left_semi")).select(
        "file_key", "row_index", F.coalesce("note", F.lit("")).alias(NOTE))
    at = F.col("_first") + F.col("row_index")
    # Written down: small, and read again when the rows are put in order.
    marks = pinned(current.join(files, "file_key").filter((F.col("row_index") >= 0) & (at <= F.col("_last"))).select(
        at.alias(table.ROW_INDEX), PATH, DESCRIPTION, NOTE))
    others = [c for c in table.columns if c not in (table.time_col, SOURCE_COLUMN)]
    found = table.df.join(marks, table.ROW_INDEX).select(
        table.shown(table.time_col, pattern).alias(TIME), PATH, DESCRIPTION, NOTE,
        *(text(col(c)).alias(c) for c in others), col(table.EVENT_MS).alias("_ms"), row.alias("_row"))
    return _settled(found, ordered)


def export_timeline(rows: DataFrame, path: str) -> None:
    """CSV part files whose order is the order of the timeline."""
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
