"""Row annotations as tables keyed by (file_key, row_index).

Joins carry no broadcast hint: the optimizer broadcasts the annotation side while
its known size is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both
sides beyond that. The key is unique per row, so a shuffle spreads evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosift.functions.text import col
from chronosift.operators.intervals import Ranges, in_ranges
from chronosift.plans.event_table import EventTable

SCHEMA = ("annotation_id string, file_key string, row_index bigint, note string, color string, "
          "created_by string, created_at timestamp, updated_at timestamp, version bigint")

# Fixed values.
COLORS = ("white", "grey", "blue", "green", "yellow", "orange", "red")
DEFAULT_COLOR = "grey"
MAX_NOTE, MAX_COLOR, MAX_PATH, MAX_HASH, MAX_ID = 512, 16, 512, 64, 46
UUID_SHAPE = "[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
HASH_SHAPE = "^([0-9a-fA-F]{2})+$|^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"

_KEY = ["file_key", "row_index"]


def annotation_id(*parts: Column) -> Column:
    """``ann_`` and a uuid made from the parts, so that a repeated task gives the same id."""
    digest = F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("ann_"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts]))


# ---------------------------------------------------------------------------
# Joins of a table with its annotations
# ---------------------------------------------------------------------------

def latest_per_row(annotations: DataFrame) -> DataFrame:
    """One record per row: the last one written wins."""
    rank = F.row_number().over(Window.partitionBy(*_KEY).orderBy(
        F.col("created_at").desc_nulls_last(), F.col("annotation_id").desc()))
    return annotations.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def _of_table(table: EventTable, annotations: DataFrame) -> DataFrame:
    return (annotations.filter(F.col("file_key") == table.file_key)
            .withColumnRenamed("row_index", table.ROW_INDEX))


def annotated(table: EventTable, annotations: DataFrame) -> EventTable:
    """Rows that have an annotation for this file variant."""
    marks = _of_table(table, annotations).select(table.ROW_INDEX)
    return table.keeping(table.df.join(marks, table.ROW_INDEX, "left_semi"))


def not_annotated(table: EventTable, annotations: DataFrame) -> EventTable:
    marks = _of_table(table, annotations).select(table.ROW_INDEX)
    return table.keeping(table.df.join(marks, table.ROW_INDEX, "left_anti"))


def enrich(table: EventTable, annotations: DataFrame) -> DataFrame:
    """All rows with flag, colour and note ('' when not annotated)."""
    marks = _of_table(table, annotations).select(
        table.ROW_INDEX, F.lit(True).alias("annotated"), "color", "note")
    rows = table.df.join(marks, table.ROW_INDEX, "left")
    return rows.select(
        col(table.ROW_INDEX).alias("row_index"), *(col(c) for c in table.display),
        F.coalesce("annotated", F.lit(False)).alias("annotated"),
        F.coalesce("color", F.lit("")).alias("color"),
        F.coalesce("note", F.lit("")).alias("note"))


def lookup_page(table: EventTable, annotations: DataFrame, start: int, end: int) -> DataFrame:
    """Annotation of each displayed row ``[start, end)``, blank when there is none."""
    page = table.page(start, end)
    return enrich(page, annotations).select("row_index", "annotated", "color", "note")


def with_positions(table: EventTable, annotations: DataFrame) -> DataFrame:
    """All annotations of the file with their position in this result, -1 when the row
    is filtered out."""
    mine = annotations.filter(F.col("file_key") == table.file_key)
    return (mine.join(table.positions(), "row_index", "left")
            .select("annotation_id", "row_index", "note", "color",
                    F.coalesce("position", F.lit(-1)).alias("position")))


def counts_per_file(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("file_key").agg(F.count(F.lit(1)).alias("annotations"))


# ---------------------------------------------------------------------------
# New versions of the annotation table
# ---------------------------------------------------------------------------

def selected_rows(table: EventTable, ranges: Ranges | None = None) -> DataFrame:
    """``row_index`` of all rows of the result, or of position ranges ``[start, end)``, given
    as a list or as a table of two columns."""
    if ranges is None:
        return table.df.select(col(table.ROW_INDEX).alias("row_index"))
    return in_ranges(table.positions(), "position", ranges).select("row_index")


def annotate(table: EventTable, annotations: DataFrame, note: str, color: str = DEFAULT_COLOR,
             ranges: Ranges | None = None, author: str = "",
             at: Column | None = None) -> DataFrame:
    """Upsert one note and colour for the selected rows: rows that already have an
    annotation keep their id, the others get a new one."""
    color = color or DEFAULT_COLOR
    now = F.current_timestamp() if at is None else at
    new = selected_rows(table, ranges).distinct().select(
        F.lit(table.file_key).alias("file_key"), "row_index", F.lit(True).alias("_new"))
    both = annotations.join(new, _KEY, "full_outer")
    fresh = F.col("_new").isNotNull()
    made = annotation_id(F.col("file_key"), F.col("row_index"))

    def pick(value: Column, name: str) -> Column:
        return F.when(fresh, value).otherwise(F.col(name)).alias(name)

    return both.select(
        F.coalesce("annotation_id", made).alias("annotation_id"), *_KEY,
        pick(F.lit(note), "note"), pick(F.lit(color), "color"),
        F.when(fresh, F.coalesce("created_by", F.lit(author))).otherwise(
            F.col("created_by")).alias("created_by"),
        F.when(fresh, F.coalesce("created_at", now)).otherwise(F.col("created_at")).alias("created_at"),
        pick(now, "updated_at"),
        F.when(fresh, F.coalesce(F.col("version"), F.lit(0)) + 1).otherwise(
            F.col("version")).cast("bigint").alias("version"))


def unannotate(table: EventTable, annotations: DataFrame,
               ranges: Ranges | None = None) -> DataFrame:
    """Drop the annotations of the selected rows; it is an error when there are none."""
    gone = selected_rows(table, ranges).select(
        F.lit(table.file_key).alias("file_key"), "row_index")
    if annotations.join(gone, _KEY, "left_semi").isEmpty():
        raise LookupError("none of the selected rows is annotated")
    return annotations.join(gone, _KEY, "left_anti")


def delete_by_id(annotations: DataFrame, annotation_id_: str) -> DataFrame:
    if get_by_id(annotations, annotation_id_).isEmpty():
        raise LookupError(f"no annotation {annotation_id_!r}")
    return annotations.filter(F.col("annotation_id") != annotation_id_)


def get_by_id(annotations: DataFrame, annotation_id_: str) -> DataFrame:
    return annotations.filter(F.col("annotation_id") == annotation_id_)


def list_annotations(annotations: DataFrame, file_hash: str = "", color: str = "") -> DataFrame:
    """All annotations, those of one file hash, or those of one colour; the hash is
    looked at first."""
    if file_hash:
        return annotations.filter(F.split_part("file_key", F.lit("::"), F.lit(1)) == file_hash)
    if color:
        return annotations.filter(F.col("color") == color)
    return annotations


def delete_by_file(annotations: DataFrame, file_hash: str) -> DataFrame:
    return annotations.filter(F.split_part("file_key", F.lit("::"), F.lit(1)) != file_hash)


def delete_by_variant(annotations: DataFrame, file_hash: str, jpath: str = "",
                      no_header_row: bool = False, ingest_tz: str = "") -> DataFrame:
    """Drop the annotations of one reading of a file; a blank zone is the default one."""
    part = lambda i: F.split_part("file_key", F.lit("::"), F.lit(i))
    same = ((part(1) == file_hash) & (part(2) == jpath)
            & (part(3) == str(no_header_row).lower()) & (part(4) == (ingest_tz or "default")))
    return annotations.filter(~same)


def batch_update(annotations: DataFrame, updates: DataFrame,
                 at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new table, counts). ``updates`` has annotation_id, note, color; blank values keep
    the old ones, unknown ids count as failures."""
    if updates.isEmpty():
        raise ValueError("a batch has at least one update")
    now = F.current_timestamp() if at is None else at
    changed = updates.select("annotation_id", F.col("note").alias("_note"),
                             F.col("color").alias("_color"), F.lit(True).alias("_hit"))
    joined = annotations.join(changed, "annotation_id", "left")
    hit = F.col("_hit").isNotNull()
    table = joined.select(
        "annotation_id", *_KEY,
        F.coalesce(F.nullif("_note", F.lit("")), "note").alias("note"),
        F.coalesce(F.nullif("_color", F.lit("")), "color").alias("color"),
        "created_by", "created_at",
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(hit, F.col("version") + 1).otherwise(F.col("version")).alias("version"))
    known = annotations.select("annotation_id", F.lit(1).alias("_known"))
    counts = (changed.join(known, "annotation_id", "left")
              .agg(F.count("_known").alias("succeeded"),
                   (F.count(F.lit(1)) - F.count("_known")).alias("failed")))
    return table, counts


def batch_create(annotations: DataFrame, file_key: str, row_indexes: list[int], note: str,
                 color: str = DEFAULT_COLOR, author: str = "", batch: str = "",
                 at: Column | None = None) -> DataFrame:
    """Append annotations with one note and colour, one or more. Rows that already have one
    get another; ``latest_per_row`` settles that on reading."""
    if not row_indexes:
        raise ValueError("a batch has at least one row")
    if min(row_indexes) < 0:
        raise ValueError("row indexes start at 0")
    spark = annotations.sparkSession
    now = F.current_timestamp() if at is None else at
    rows = spark.createDataFrame(list(enumerate(row_indexes)), "item int, row_index bigint").select(
        annotation_id(F.lit(file_key), F.col("row_index"), F.col("item"), F.lit(batch))
        .alias("annotation_id"),
        F.lit(file_key).alias("file_key"), "row_index", F.lit(note).alias("note"),
        F.lit(color or DEFAULT_COLOR).alias("color"), F.lit(author).alias("created_by"),
        now.alias("created_at"), now.alias("updated_at"), F.lit(1).cast("bigint").alias("version"))
    return annotations.unionByName(rows)


def validate(records: DataFrame) -> DataFrame:
    """Records with a ``problems`` array, empty for valid ones. Checks the columns that
    are there: note, color, file_path, annotation_id, file_hash, row_index."""
    has = set(records.columns)
    uuid = F.regexp_replace("annotation_id", "^[^_]*_", "")
    checks = [
        ("note", F.length("note") > MAX_NOTE, "note too long"),
        ("color", F.length("color") > MAX_COLOR, "color too long"),
        ("file_path", F.length("file_path") > MAX_PATH, "file_path too long"),
        ("annotation_id", (F.length("annotation_id") > MAX_ID) | ~uuid.rlike(f"^{UUID_SHAPE}$"),
         "annotation_id not a prefixed uuid"),
        ("file_hash", (F.length("file_hash") > MAX_HASH) | ~F.col("file_hash").rlike(HASH_SHAPE)
         | (F.col("file_hash") == ""), "file_hash not hex or base64"),
        ("row_index", F.col("row_index") < 0, "row_index negative"),
    ]
    found = [F.when(bad, F.lit(reason)) for name, bad, reason in checks if name in has]
    return records.withColumn("problems", F.array_compact(F.array(*found)))


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate(records)
    return (checked.filter(F.size("problems") == 0).drop("problems"),
            checked.filter(F.size("problems") > 0))


def reconcile(store: DataFrame, files: DataFrame) -> DataFrame:
    """Annotations taken over from the shared store: those without a file record are
    dropped, the last record of a row wins."""
    return latest_per_row(store.join(files.select("file_key"), "file_key", "left_semi"))
