"""Find in cells, snippets, hit pages and highlight spans."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosift.functions.text import col
from chronosift.operators.ordinal import slice_rows
from chronosift.plans.event_table import EventTable

# Fixed values.
CONTEXT = 30
PAGE = 1000
CUT = "…"
MARK = "\x00"


def snippet(cell: Column, start: Column, end: Column, context: int = CONTEXT) -> Column:
    """``context`` characters on each side of the match, with a mark where cut."""
    low = F.greatest(start - context, F.lit(0))
    high = F.least(end + context, F.length(cell))
    return F.concat(F.when(low > 0, CUT).otherwise(""),
                    F.substring(cell, low + 1, high - low),
                    F.when(high < F.length(cell), CUT).otherwise(""))


def _start(cell: Column, pattern: str, regex: bool) -> Column:
    """0-based start of the first match."""
    if regex:
        return F.regexp_instr(cell, F.lit(pattern)) - 1
    return F.locate(pattern.lower(), F.lower(cell)) - 1


def _end(hit: Column, pattern: str, regex: bool) -> Column:
    if regex:
        return hit["s"] + F.length(F.regexp_substr(hit["cell"], F.lit(pattern)))
    return hit["s"] + len(pattern)


def _has(cell: Column, pattern: str, regex: bool) -> Column:
    if regex:
        return (cell != "") & cell.rlike(pattern)
    return F.lower(cell).contains(pattern.lower())


def find(table: EventTable, pattern: str, *, regex: bool = False,
         max_hits: int | None = None) -> DataFrame:
    """First match in every cell, in row then column order.

    Plain text ignores case, a regular expression does not. The time column is
    searched as it is displayed. Positions are those of the current result; only
    sort keys and hits are shuffled for them, never whole rows. All hits are given; with
    ``max_hits`` the first ones, in order. ``hit_page`` cuts pages.
    """
    if pattern == "":
        return table.df.sparkSession.createDataFrame([], (
            "row_pos bigint, column_index int, column_name string, match_start int, "
            "match_end int, snippet string"))
    shown = [f"_cell{i}" for i in range(len(table.columns))]
    # Cells beyond the header are searched after the others, and have no name.
    spare = table.SURPLUS if table.SURPLUS in table.df.columns else None
    seen = table.keeping(table.df.withColumns(
        {place: table.shown(name) for place, name in zip(shown, table.columns)}))
    if table.whole and not table.order:
        # Positions are row indexes, so rows without a hit can go at once.
        some = reduce(lambda a, b: a | b, (_has(F.col(c), pattern, regex) for c in shown))
        if spare:
            some = some | F.coalesce(F.exists(spare, lambda c: _has(c, pattern, regex)), F.lit(False))
        seen = replace(seen.keeping(seen.df.filter(some)), whole=True)
    else:
        seen = replace(seen, whole=table.whole)
    # Only cells with a hit are carried on; where and how is looked up in those.
    cells = F.array(*(F.when(_has(F.col(c), pattern, regex), F.struct(F.lit(i).alias("i"), F.col(c).alias("cell")))
                      for i, c in enumerate(shown)))
    if spare:
        beyond = F.transform(spare, lambda c, i: F.when(
            _has(c, pattern, regex), F.struct((i + len(shown)).alias("i"), c.alias("cell"))))
        cells = F.concat(cells, F.coalesce(beyond, F.slice(cells, 1, 0)))
    found = F.array_compact(cells)
    placed = F.transform(found, lambda hit: F.struct(
        hit["i"].alias("i"), hit["cell"].alias("cell"), _start(hit["cell"], pattern, regex).alias("s")))
    ended = F.transform(placed, lambda hit: F.struct(
        hit["i"].alias("i"), hit["s"].alias("s"), _end(hit, pattern, regex).alias("e"),
        snippet(hit["cell"], hit["s"], _end(hit, pattern, regex)).alias("snippet")))
    names = F.array(*(F.lit(c) for c in table.columns))
    rows = seen.positions(ended.alias("hits"), name="row_pos", costly=True).select(
        "row_pos", F.inline("hits").alias("column_index", "match_start", "match_end", "snippet"))
    rows = rows.select("row_pos", "column_index", F.coalesce(F.get(names, F.col("column_index")), F.lit("")).alias("column_name"),
                       F.col("match_start").cast("int").alias("match_start"),
                       F.col("match_end").cast("int").alias("match_end"), "snippet")
    if max_hits is None:
        return rows
    return rows.orderBy("row_pos", "column_index").limit(max_hits)


def hit_page(hits: DataFrame, page: int, size: int = PAGE) -> DataFrame:
    """One page of hits, pages counted from 0."""
    return slice_rows(hits, [F.col("row_pos"), F.col("column_index")], page * size, (page + 1) * size)


def highlight(table: EventTable, terms: list[str]) -> DataFrame:
    """All places of all terms per cell, overlapping or touching ranges merged.

    A marker put before every place splits the cell, and the lengths of the pieces
    add up to the start positions. Only cells with a hit are shuffled, once, by cell.
    """
    shape = "row_index bigint, column_index int, span_start int, span_end int"
    needles = list(dict.fromkeys(t.lower() for t in terms if t))
    if not needles:
        return table.df.sparkSession.createDataFrame([], shape)
    lowered = F.translate(F.lower(F.col("cell")), MARK, " ")
    hit = reduce(lambda a, b: a | b, (lowered.contains(n) for n in needles))
    cells = table.df.select(
        col(table.ROW_INDEX).alias("row_index"),
        F.posexplode(F.array(*(table.shown(c) for c in table.columns)))
        .alias("column_index", "cell")).filter(hit)
    # Zero-width look-ahead: overlapping places of one term are all marked.
    marked = F.explode(F.array(*(F.struct(
        F.lit(len(n)).alias("size"), F.lit(i).alias("needle"),
        F.regexp_replace(lowered, f"(?={re.escape(n)})", MARK).alias("text"))
        for i, n in enumerate(needles))))
    cell = ["row_index", "column_index"]
    pieces = (cells.select(*cell, marked.alias("m"))
              .select(*cell, "m.size", "m.needle",
                      F.posexplode(F.split("m.text", MARK)).alias("pos", "piece"))
              .select(*cell, "size", "needle", "pos", F.length("piece").alias("step"))
              .repartition(*cell))
    upto = Window.partitionBy(*cell, "needle").orderBy("pos")
    last = F.max("pos").over(Window.partitionBy(*cell, "needle"))
    spans = (pieces.withColumn("s", F.sum("step").over(upto)).withColumn("last", last)
             .filter(F.col("pos") < F.col("last"))
             .select(*cell, "s", (F.col("s") + F.col("size")).alias("e")))
    line = Window.partitionBy(*cell).orderBy("s", "e")
    reach = F.max("e").over(line.rowsBetween(Window.unboundedPreceding, -1))
    islands = (spans.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1))
               .withColumn("island", F.sum("new").over(line)))
    return (islands.groupBy(*cell, "island")
            .agg(F.min("s").cast("int").alias("span_start"), F.max("e").cast("int").alias("span_end"))
            .drop("island"))
