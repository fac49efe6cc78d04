"""Export of a selection as tab-separated text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.functions.jsonpath import json_cell
from chronosift.functions.text import col, resolve
from chronosift.operators.intervals import Ranges, in_ranges
from chronosift.plans.event_table import EventTable


def selection(table: EventTable, ranges: Ranges | None = None,
              fields: Sequence[str] | None = None, headers: Sequence[str] | None = None,
              paths: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of the current result, all or position ranges ``[start, end)`` (a list, or a
    table of two columns), with the chosen columns in the given order. Of ranges only sort keys
    are put in order, and the cells of the rows found are fetched by row index. Unknown columns are empty; tabs and line breaks
    become blanks; ``paths`` shows columns through a JSON path. Positions come along in
    ``position`` to keep the order."""
    fields = list(fields or table.display)
    names = list(headers) if headers and len(headers) == len(fields) else fields
    through = {k.strip().lower(): v for k, v in (paths or {}).items()}
    cells = []
    for field, name in zip(fields, names):
        column = resolve(field, table.columns)
        cell = F.lit("") if column is None else table.shown(column)
        path = through.get(name.strip().lower()) or through.get(field.strip().lower())
        if path and column is not None:
            cell = json_cell(col(column), path)
        cells.append(F.regexp_replace(cell, "[\t\r\n]", " ").alias(name))
    cells = F.struct(*cells).alias("_cells")
    if ranges is None:
        return table.positions(cells).select("position", "_cells.*")
    found = in_ranges(table.positions(), "position", ranges)
    rows = table.df.select(col(table.ROW_INDEX).alias("row_index"), cells)
    return rows.join(found, "row_index").select("position", "_cells.*")


def export_selection(rows: DataFrame, path: str) -> None:
    """TSV part files in row order, with header and without quoting."""
    (rows.orderBy("position").drop("position").write
     .options(header=True, sep="\t", quote="\x00", escape="\x00", emptyValue="").csv(path))
