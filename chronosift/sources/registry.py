"""User-defined sources: a file ending or an id leads to a loader."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.operators.ordinal import BROADCAST_ROWS, dense
from chronosift.session import pinned
from chronosift.sources import syslog, weblogs
from chronosift.sources.heads import SUFFIXES
from chronosift.sources.options import FileOptions
from chronosift.sources.splits import read_lines, with_stable_ordinal

# A loader gives the data columns and a 0-based ``_row_index``. With ``is_directory`` it gets
# a list of paths and adds the path of each row as ``_file``.
Loader = Callable[[SparkSession, str, FileOptions], DataFrame]


class Sources:
    """Loaders by id and by ending (any case). The first one registered for an ending
    keeps it; an explicit id always leads to its own loader."""

    def __init__(self) -> None:
        self._by_id: dict[str, Loader] = {}
        self._by_ending: dict[str, str] = {}

    def register(self, source_id: str, endings: list[str], loader: Loader) -> None:
        self._by_id.setdefault(source_id, loader)
        for ending in endings:
            ending = ending.lower()
            self._by_ending.setdefault(ending if "." in ending else "." + ending, source_id)

    def find(self, path: str, source_id: str = "") -> Loader | None:
        if source_id:
            return self._by_id.get(source_id)
        inner = path.lower()
        for packed in SUFFIXES:
            inner = inner.removesuffix(packed)
        ending = next((e for e in self._by_ending if inner.endswith(e)), None)
        return self._by_id[self._by_ending[ending]] if ending else None


def _text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_lines(spark, path)


def _numbered(rows: DataFrame, options: FileOptions) -> DataFrame:
    """Rows of a directory keep their file in ``_file``."""
    rows = with_stable_ordinal(dense(rows), "_row_index")
    return rows if options.is_directory else rows.drop("_file")


def load_syslog(spark: SparkSession, path: str, options: FileOptions,
                year: int | None = None) -> DataFrame:
    return _numbered(syslog.parse(_text(spark, path), year=year), options)


def load_upper(spark: SparkSession, path: str, options: FileOptions) -> DataFrame:
    """Sample loader: line number from 1 and the line in upper case."""
    rows = _numbered(_text(spark, path), options)
    file = ["_file"] if options.is_directory else []
    return rows.select((F.col("_row_index") + 1).cast("string").alias("line_number"),
                       F.upper("value").alias("content"), *file, "_row_index")


def load_weblog(spark: SparkSession, path: str, options: FileOptions) -> DataFrame:
    """Web server logs: each file is read in the format that most of its lines show; unknown
    ones as W3C extended, each row by the last field list before it. Rows with different W3C
    fields are united by name.

    Only the different formats and field lists come to the driver; each of them is one part
    of the union, and lines find theirs by a join on the file. Files in which the list varies
    are read apart, and their lines find it row by row.
    """
    lines = _text(spark, path)
    votes = pinned(weblogs.vote(lines, order=("_start", "_seq")))
    found = votes.groupBy("format", "fields", "varies").agg(F.min("_file").alias("first")).orderBy("first").collect()
    if not found:
        raise ValueError(f"no lines in {path}")
    many = len(found) > 1 and votes.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS

    def of(files: DataFrame) -> DataFrame:
        return lines.join(files if many else F.broadcast(files), "_file", "left_semi")

    def with_list(rows: DataFrame, name: str, fields: list[str] | None) -> DataFrame:
        return rows.filter(F.col(name).eqNullSafe(F.lit(fields) if fields is not None else F.lit(None)))

    parts = []
    for group in found:
        if group["varies"]:
            continue
        mine = lines
        if len(found) > 1:
            steady = votes.filter((F.col("format") == group["format"]) & ~F.col("varies"))
            mine = of(with_list(steady, "fields", group["fields"]).select("_file"))
        if group["format"] == "iis_native":
            parts.append(weblogs.parse_iis(mine))
        elif group["format"] == "ncsa":
            parts.append(weblogs.parse_ncsa(mine))
        else:
            parts.append(weblogs.parse_w3c(mine, group["fields"]))
    placed = [dense(_united(parts), many)] if parts else []
    if any(group["varies"] for group in found):
        varying = votes.filter("varies")
        told = pinned(weblogs.with_fields(of(varying.select("_file")), varying))
        lists = told.groupBy("_fields").agg(F.min(F.struct("_file", "_start", "_seq")).alias("first")).orderBy("first").collect()
        placed += [weblogs.parse_w3c(with_list(told, "_fields", r["_fields"]).drop("_fields"), r["_fields"]) for r in lists]
    rows = with_stable_ordinal(_united(placed), "_row_index")
    return rows if options.is_directory else rows.drop("_file")


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def standard_sources() -> Sources:
    sources = Sources()
    sources.register("syslog", ["kern.log", "syslog"], load_syslog)
    sources.register("weblog", ["log"], load_weblog)
    sources.register("upper", [], load_upper)
    return sources
