"""Rows that arrive as (file, position, cells): the first row of a file may name them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.operators.ordinal import number_blocks, small_side
from chronosift.session import pinned
from chronosift.sources.headers import SURPLUS, normal_names, union_header, unnamed

SHAPE = "_file string, _pos bigint, cells array<string>"


def named_rows(cells: DataFrame, no_header_row: bool = False) -> DataFrame:
    """One column per name over all files, and ``_file``, ``_pos`` of each data row.

    One header per file comes to the driver; rows are mapped to names by a join with
    that small table, so files with different headers need no separate reads.
    """
    spark = cells.sparkSession
    firsts = cells.filter("_pos = 0").select("_file", "cells").orderBy("_file").collect()
    headers = {r["_file"]: (unnamed(len(r["cells"])) if no_header_row
                            else normal_names(list(r["cells"]))) for r in firsts}
    names = union_header(headers.values())
    if not names:
        raise ValueError("no rows found")
    data = cells if no_header_row else cells.filter("_pos > 0")
    table = spark.createDataFrame(list(headers.items()), "_file string, _names array<string>")
    width = F.size("_names")
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(None).cast("string"), width)),
                     F.lit(1), width)
    by_name = F.map_from_arrays("_names", padded)
    rows = data.join(small_side(table), "_file").select("_file", "_pos", by_name.alias("_by"),
        F.when(F.size("cells") > width, F.slice("cells", width + 1, F.size("cells"))).alias(SURPLUS))
    return rows.select("_file", "_pos", *(F.try_element_at("_by", F.lit(n)).alias(n) for n in names), SURPLUS)


def with_ordinal(rows: DataFrame, name: str) -> DataFrame:
    """0-based position over files in path order from the position inside each file."""
    return number_blocks(pinned(rows), ["_file"], name, "_pos").drop("_pos")
