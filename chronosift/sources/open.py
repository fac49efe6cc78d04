"""One way in: a path and its options to an event table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.operators.ordinal import file_path, number_blocks
from chronosift.plans.event_table import EventTable
from chronosift.sources import cells, compressed, csvfiles, directory, jsonfiles, workbooks
from chronosift.sources.headers import SURPLUS
from chronosift.sources.heads import SUFFIXES, first_records
from chronosift.sources.options import FileOptions, file_key
from chronosift.sources.registry import Loader, Sources, standard_sources
from chronosift.sources.splits import with_stable_ordinal
from chronosift.session import pinned

ROW = EventTable.ROW_INDEX


def kind_of(path: str, options: FileOptions, sources: Sources) -> str:
    """csv, xlsx, json, plugin or parquet, by ending inside any compression ending."""
    inner = path.lower()
    for ending in SUFFIXES:
        inner = inner.removesuffix(ending)
    if options.plugin_id:
        return "plugin"
    for kind in ("csv", "xlsx", "json", "parquet"):
        if inner.endswith("." + kind):
            return kind
    return "plugin" if sources.find(path) else "csv"


def open_events(spark: SparkSession, path: str, options: FileOptions | None = None, *,
                time_col: str | None = None, display_zone: str | None = None,
                file_hash: str = "", sources: Sources | None = None,
                exclude: tuple[str, ...] = (), max_files: int = 0,
                multiline: bool | None = None, kind: str = "",
                zone_names: Mapping[str, str] | None = None) -> EventTable:
    """A file or directory as an event table. Files of a directory may be of several kinds,
    each told by its own ending, inside any compression ending; ``kind`` (csv, json, xlsx)
    overrules that. ``zone_names`` gives offsets of zone abbreviations in times (``EST`` to ``-05:00``).
    Opening writes nothing; for repeated use of text logs write the table to Parquet once (``save_events``) and
    open that."""
    options = options or FileOptions()
    sources = sources or standard_sources()
    if options.is_directory:
        rows = _directory(spark, path, options, sources, exclude, max_files, multiline, kind)
    else:
        rows = _file(spark, path, options, sources, multiline, kind)
    return EventTable.of(rows, time_col=time_col, ingest_zone=options.ingest_tz,
                         display_zone=display_zone, file_key=file_key(file_hash, options), zone_names=zone_names)


def _file(spark: SparkSession, path: str, options: FileOptions, sources: Sources,
          multiline: bool | None, kind: str) -> DataFrame:
    kind = kind or kind_of(path, options, sources)
    if kind == "plugin":
        loader = sources.find(path, options.plugin_id)
        if loader is None:
            raise LookupError(f"no source {options.plugin_id!r}")
        return loader(spark, path, replace(options, is_directory=False))
    if kind == "parquet":
        return EventTable.from_parquet(spark, path).df.drop(EventTable.EVENT_MS)
    if kind == "xlsx":
        return _from_cells(workbooks.read_cells(spark, [path]), options)
    if kind == "json":
        return _json(spark, [path], options.jpath)
    if first_records(spark, [path])[path].streamed:
        return _from_cells(compressed.read_cells(spark, [path]), options)
    rows, counts = csvfiles.read_csv(spark, path, options.no_header_row, multiline)
    return with_stable_ordinal(rows, ROW, counts).drop("_file")


def _from_cells(found: DataFrame, options: FileOptions) -> DataFrame:
    rows = cells.named_rows(pinned(found), options.no_header_row)
    return cells.with_ordinal(rows, ROW).drop("_file")


def _json(spark: SparkSession, paths: list[str], jpath: str, keep_file: bool = False) -> DataFrame:
    """Records at the path; without a path the file holds objects one after another."""
    if jpath:
        rows = cells.with_ordinal(jsonfiles.read_records(spark, paths, jpath), ROW)
    else:
        rows = with_stable_ordinal(jsonfiles.read_values(spark, paths), ROW)
    return rows if keep_file else rows.drop("_file")


def _directory(spark: SparkSession, root: str, options: FileOptions, sources: Sources,
               exclude: tuple[str, ...], max_files: int, multiline: bool | None, kind: str) -> DataFrame:
    """Files of a kind are read together; kinds are united by column name, as text, and
    rows numbered by path and place."""
    paths = [r["path"] for r in directory.listing(
        spark, root, options.file_pattern, exclude, max_files).orderBy("relative_path").select("path").collect()]
    if not paths:
        raise ValueError(f"no files match {options.file_pattern!r} in {root}")
    groups: dict[tuple, list[str]] = {}
    for path in paths:
        own = kind or kind_of(path, options, sources)
        loader = sources.find(path, options.plugin_id) if own == "plugin" else None
        if own == "plugin" and loader is None:
            raise LookupError(f"no source {options.plugin_id!r}")
        groups.setdefault((own, loader), []).append(path)
    parts = [_group(spark, root, options, multiline, own, loader, group)
             for (own, loader), group in groups.items()]
    source = directory.SOURCE_COLUMN
    if len(parts) == 1 and ("parquet", None) not in groups:
        rows = parts[0]
    else:
        texts = [p.select(*[F.col("`" + n.replace("`", "``") + "`").cast("string") if n not in (ROW, SURPLUS) else F.col(n)
                            for n in p.columns]) for p in parts] if len(parts) > 1 else parts
        united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), texts)
        rows = number_blocks(pinned(united.withColumnRenamed(ROW, "_within")), [source], ROW, "_within").drop("_within")
        rows = rows.select(*[F.col("`" + n.replace("`", "``") + "`") for n in rows.columns if n not in (source, ROW)], source, ROW)
    return rows if options.include_source else rows.drop(source)


def _group(spark: SparkSession, root: str, options: FileOptions, multiline: bool | None, kind: str,
           loader: Loader | None, paths: list[str]) -> DataFrame:
    """Files of one kind: their columns, the relative path of each row, its row index."""
    if kind == "csv":
        return directory.read_csv_directory(
            spark, root, options.file_pattern, no_header_row=options.no_header_row,
            include_source=True, multiline=multiline, row_index=ROW, paths=paths)
    if kind == "json":
        rows = _json(spark, paths, options.jpath, keep_file=True)
    elif kind == "xlsx":
        rows = cells.with_ordinal(cells.named_rows(
            pinned(workbooks.read_cells(spark, paths)), options.no_header_row), ROW)
    elif kind == "parquet":
        rows = spark.read.parquet(*paths).select(
            "*", file_path().alias("_file"), F.col("_metadata.row_index").alias(ROW))
    else:
        rows = loader(spark, paths, replace(options, is_directory=True))
    return rows.withColumn("_file", directory.relative(spark, root, F.col("_file"))).select(
        *[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns if c not in ("_file", ROW)],
        F.col("_file").alias(directory.SOURCE_COLUMN), ROW)


def save_events(table: EventTable, path: str) -> None:
    """The whole table as Parquet, with row index and event time, in file order inside
    each output file so that later scans can skip by time."""
    table.df.write.mode("errorifexists").parquet(path)


def load_events(spark: SparkSession, path: str, **options) -> EventTable:
    """A table written by ``save_events``."""
    return EventTable.of(spark.read.parquet(path), **options)
