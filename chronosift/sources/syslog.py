"""Syslog and kernel log lines."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line shapes, in the order they are tried, and the columns.
COLUMNS = ("timestamp", "hostname", "facility", "uptime", "message")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_REST = r"(\S+?):\s*(?:\[([0-9.]+)\]\s*)?(.*)$"
ISO = (r"(?s)^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:\.\d+)?(?:[+-]\d{2}:\d{2}|Z)?\s+"
       r"(\S+)\s+" + _REST)
_CLASSIC_TIME = r"(?s)^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
CLASSIC = _CLASSIC_TIME + _REST
BARE = _CLASSIC_TIME + r"(.*)$"

# Groups are cut where this stands between them. A line may hold it too: it is written as something else before,
# which no shape tells from other letters, and back after.
_SEP, _ESCAPE = "\x1f", "\x1e"


def escaped(line: Column) -> Column:
    return F.replace(F.replace(line, F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(_SEP), F.lit(_ESCAPE + "1"))


def as_written(cell: Column) -> Column:
    """The text of a group of an ``escaped`` line."""
    return F.replace(F.replace(cell, F.lit(_ESCAPE + "1"), F.lit(_SEP)), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))


def groups(line: Column, pattern: str, n: int) -> Column:
    """All groups of a pattern that matches the whole ``escaped`` line, by one regex run."""
    return F.split(F.regexp_replace(line, pattern, _SEP.join(f"${i}" for i in range(1, n + 1))),
                   _SEP, n)


def month_number(name: Column) -> Column:
    """Month of an English abbreviation; an unknown one counts as the first."""
    place = F.position(name, F.lit("".join(MONTHS)))
    return F.when(place % 3 == 1, (place + 2) / 3).otherwise(1).cast("int")


def parse(lines: DataFrame, value: str = "value", year: int | None = None) -> DataFrame:
    """Log lines to columns. Blank lines are dropped, lines of no known shape are kept
    as message. Classic lines carry no year: it is a parameter, by default this year.
    Other columns of ``lines`` are kept."""
    year = year or datetime.now(timezone.utc).year
    others = [c for c in lines.columns if c != value]
    line, cells = F.col("_line"), F.col("_cells")

    def as_cells(shape: str, *parts: str) -> Column:
        return F.split(F.regexp_replace(line, shape, _SEP.join(parts)), _SEP, len(COLUMNS))

    empty = F.lit("")
    found = (F.when(line.rlike(ISO), as_cells(ISO, "$1 $2", "$3", "$4", "$5", "$6"))
             .when(line.rlike(CLASSIC), as_cells(CLASSIC, "$1 $2 $3", "$4", "$5", "$6", "$7"))
             .when(line.rlike(BARE), as_cells(BARE, "$1 $2 $3", "$4", "", "", "$5"))
             .otherwise(F.array(empty, empty, empty, empty, line)))
    # 'Jan 15 10:30:00' gets its year; an impossible date stays as it is written.
    words = F.col("_words")
    full = F.concat(F.lit(f"{year:04d}-"), F.lpad(month_number(words[0]).cast("string"), 2, "0"),
                    F.lit("-"), F.lpad(words[1], 2, "0"), F.lit(" "), words[2])
    classic = (cells[0] != "") & (F.substring(cells[0], 5, 1) != "-")
    rows = (lines.select(*others, escaped(F.regexp_replace(value, r"[\r\n]+$", "")).alias("_line"))
            .filter("_line <> ''").select(*others, found.alias("_cells"))
            .select(*others, "_cells", F.when(classic, F.split(cells[0], " ")).alias("_words"))
            .select(*others, "_cells", F.when(words.isNotNull(), full).alias("_full")))
    stamp = F.when(F.col("_full").try_cast("timestamp_ntz").isNotNull(), F.col("_full")).otherwise(cells[0])
    return rows.select(*others, as_written(stamp).alias(COLUMNS[0]),
                       *(as_written(cells[i]).alias(c) for i, c in enumerate(COLUMNS) if i))
