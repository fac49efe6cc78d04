"""Web server logs: W3C extended, IIS native and NCSA common, and the vote that tells
which one a file is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosift.operators.ordinal import small_side
from chronosift.session import pinned
from chronosift.sources.syslog import as_written, escaped, groups, month_number

# Columns and line shapes of the formats.
W3C_FIELDS = (
    "date", "time", "s-ip", "cs-method", "cs-uri-stem", "cs-uri-query", "s-port", "cs-username",
    "c-ip", "cs(User-Agent)", "cs(Referer)", "sc-status", "sc-substatus", "sc-win32-status",
    "time-taken")
IIS_COLUMNS = (
    "timestamp", "client_ip", "username", "service", "server", "server_ip", "time_taken",
    "bytes_received", "bytes_sent", "status_code", "win32_status", "method", "uri", "parameters")
NCSA_COLUMNS = ("timestamp", "client_ip", "ident", "username", "method", "uri", "protocol",
                "status_code", "bytes_sent")
NCSA_LINE = (r'(?s)^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d+)\s+(\S+).*$')
NCSA_TIME = (r"(?s)^(\d{1,2})/(\w{3})/(\d{4}):(\d{2}:\d{2}:\d{2})\s*(?:([+-]\d{2})(\d{2}))?.*$")
NCSA_GUESS = r'^\S+\s+\S+\s+\S+\s+\[.+\]\s+"[^"]+"\s+\d+\s+\d+'
W3C_NAME = r"^(date|time|time-taken|bytes|cached|(c|s|r|cs|sc|sr|rs|x)[-(].+)$"
CENTURY_PIVOT = 70


def _line(value: str) -> Column:
    return F.regexp_replace(value, r"[\r\n]+$", "")


def _no_dash(value: Column) -> Column:
    return F.when(value == "-", "").otherwise(F.coalesce(value, F.lit("")))


def _others(lines: DataFrame, value: str) -> list[str]:
    return [c for c in lines.columns if c != value]


def w3c_header(fields: list[str] | None) -> list[str]:
    """Date and time become one leading column."""
    fields = list(fields or W3C_FIELDS)
    if "date" in fields and "time" in fields:
        return ["timestamp", *(f for f in fields if f not in ("date", "time"))]
    return fields


def parse_w3c(lines: DataFrame, fields: list[str] | None = None, value: str = "value") -> DataFrame:
    """W3C extended lines: '-' is empty, short lines are padded and long ones cut."""
    fields = list(fields or W3C_FIELDS)
    others = _others(lines, value)
    rows = (lines.withColumn("_line", _line(value))
            .filter((F.col("_line") != "") & ~F.col("_line").startswith("#"))
            .select(*others, F.split(F.regexp_replace("_line", r"^\s+|\s+$", ""), r"\s+").alias("_p")))

    def part(name: str) -> Column:
        return F.coalesce(F.get("_p", F.lit(fields.index(name))), F.lit(""))

    shown = {f: _no_dash(part(f)) for f in fields}
    if "date" in fields and "time" in fields:
        date, time = part("date"), part("time")
        known = ~date.isin("", "-") & ~time.isin("", "-")
        shown["timestamp"] = F.when(known, F.concat(date, F.lit("T"), time, F.lit("Z"))).otherwise(
            F.concat(date, F.lit(" "), time))
    return rows.select(*others, *(shown[c].alias(c) for c in w3c_header(fields)))


def parse_iis(lines: DataFrame, value: str = "value") -> DataFrame:
    """IIS native lines: 15 comma fields, local time with a two-digit year."""
    others = _others(lines, value)
    rows = (lines.withColumn("_line", _line(value)).filter("_line <> ''")
            .select(*others, F.transform(F.split("_line", ","), lambda p: F.trim(p)).alias("_p"))
            .select(*others, "_p", F.transform("_p", lambda p: _no_dash(p)).alias("_shown"),
                    F.split(F.get("_p", F.lit(2)), "/").alias("_date")))

    def part(i: int, source: str = "_p") -> Column:
        return F.coalesce(F.get(source, F.lit(i)), F.lit(""))

    date, time, pieces = part(2), part(3), F.col("_date")
    year = pieces[2]
    century = F.when(year.try_cast("int") >= CENTURY_PIVOT, "19").otherwise("20")
    full_year = F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year)
    pad = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    readable = (F.size(pieces) == 3) & ((F.length(year) != 2) | year.rlike(r"^\d\d$"))
    stamp = (F.when((date == "") | (time == ""), "")
             .when(readable, F.concat(full_year, F.lit("-"), pad(pieces[0]), F.lit("-"),
                                      pad(pieces[1]), F.lit("T"), time))
             .otherwise(F.concat(date, F.lit(" "), time)))
    places = (0, 1, *range(4, 15))
    return rows.select(*others, stamp.alias("timestamp"), *(
        part(i, "_shown").alias(c) for i, c in zip(places, IIS_COLUMNS[1:])))


def parse_ncsa(lines: DataFrame, value: str = "value") -> DataFrame:
    """NCSA common lines; others are dropped. The time keeps its offset."""
    others = _others(lines, value)
    rows = (lines.withColumn("_line", escaped(_line(value))).filter(F.col("_line").rlike(NCSA_LINE))
            .select(*others, groups(F.col("_line"), NCSA_LINE, 7).alias("_p"))
            .select(*others, F.transform("_p", lambda p: _no_dash(as_written(p))).alias("_p"), F.col("_p")[3].alias("_raw"),
                    F.split(as_written(F.col("_p")[4]), " ", 3).alias("_request"))
            .select("*", F.when(F.col("_raw").rlike(NCSA_TIME), groups(F.col("_raw"), NCSA_TIME, 6)).alias("_t")))
    t = F.col("_t")
    iso = F.concat(t[2], F.lit("-"), F.lpad(month_number(t[1]).cast("string"), 2, "0"), F.lit("-"),
                   F.lpad(t[0], 2, "0"), F.lit("T"), t[3],
                   F.when(t[4] != "", F.concat(t[4], F.lit(":"), t[5])).otherwise(""))
    word = lambda i: F.coalesce(F.get("_request", F.lit(i)), F.lit(""))
    return rows.select(
        *others, F.coalesce(iso, as_written(F.col("_raw"))).alias("timestamp"), F.col("_p")[0].alias("client_ip"),
        F.col("_p")[1].alias("ident"), F.col("_p")[2].alias("username"),
        word(0).alias("method"), word(1).alias("uri"), word(2).alias("protocol"),
        F.col("_p")[5].alias("status_code"), F.col("_p")[6].alias("bytes_sent"))


def _names(line: Column) -> Column:
    """The field names of a ``#Fields:`` line; null for other lines."""
    names = F.split(F.regexp_replace(F.substr(line, F.lit(9)), r"^\s+|\s+$", ""), r"\s+")
    return F.when(line.startswith("#Fields:"), names)


def _new_names(line: Column) -> Column:
    """Names that hold for the rows after a line. A single word that is no field of W3C is no list."""
    names = _names(line)
    return F.when((F.size(names) > 1) | names[0].rlike(W3C_NAME), names)


def vote(lines: DataFrame, value: str = "value", file: str = "_file",
         order: tuple[str, ...] = ("_seq",)) -> DataFrame:
    """Format and first W3C field list of every file, and whether the list ``varies`` in the
    file. All lines decide: directives anywhere, else the format that most lines have, of
    equals the one seen first. One row per file, split, kind and field list is left of a task's lines.
    """
    *above, last = order
    head = lines.select(file, *order, _line(value).alias("line"))
    line = F.col("line")
    directive = (line.startswith("#Software:") | line.startswith("#Version:")
                 | line.startswith("#Fields:"))
    words = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")
    kind = (F.when((line == "") | line.startswith("#"), None)
            .when(line.contains(", ") & (F.size(F.split(line, ", ")) >= 10), "iis_native")
            .when(line.rlike(NCSA_GUESS) | line.rlike(NCSA_LINE), "ncsa")
            .when((F.size(words) >= 3) & words[0].rlike(r"^\d{4}-\d{2}-\d{2}"), "w3c"))
    # Numbers only are kept for each text, so that no task sorts its lines.
    told = head.select(file, *order, directive.alias("directive"), kind.alias("kind"),
                       _names(line).alias("names"), F.array_join(_new_names(line), " ").alias("list")).groupBy(
        file, *above, F.col(last).isNull().alias("_unplaced"), "directive", "kind", "names", "list").agg(
            F.count(F.lit(1)).alias("_lines"), F.min(last).alias(last)).withColumn("_n", F.struct(*order))
    votes = {k: (F.sum(F.when(F.col("kind") == k, F.col("_lines")).otherwise(0)).alias(f"n_{k}"),
                 F.min(F.when(F.col("kind") == k, F.col("_n"))).alias(f"at_{k}"))
             for k in ("iis_native", "ncsa", "w3c")}
    files = told.groupBy(file).agg(
        F.max("directive").alias("directive"), *(c for pair in votes.values() for c in pair),
        F.min_by("names", F.when(F.col("names").isNotNull(), F.col("_n"))).alias("fields"),
        F.min("list").alias("low"), F.max("list").alias("high"))
    most = F.array_min(F.array(*(F.when(F.col(f"n_{k}") > 0, F.struct(
        (-F.col(f"n_{k}")).alias("n"), F.col(f"at_{k}").alias("at"), F.lit(k).alias("kind"))) for k in votes)))["kind"]
    varies = (F.col("low") != F.col("high")) | (F.col("low") != F.array_join("fields", " "))
    return files.select(file, F.when(F.col("directive"), "w3c").otherwise(F.coalesce(most, F.lit("unknown"))).alias("format"),
                        "fields", F.coalesce(varies, F.lit(False)).alias("varies"))


def with_fields(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The W3C data lines of ``files`` (``_file, fields``) with ``_fields``, the last list before
    each one; lines before the first list have that one. ``lines`` are located; their ``_seq``
    comes back without gaps. Only lines of one split meet in a task: lists are handed from
    split to split by a table of one row per split."""
    inside = Window.partitionBy("_file", "_start").orderBy("_seq")
    line = _line("value")
    rows = pinned(lines.select(
        "value", "_file", "_start", "_seq", ((line != "") & ~line.startswith("#")).alias("_data"),
        F.last(_new_names(line), ignorenulls=True).over(inside).alias("_own")))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_file", "_start").agg(F.max_by("_own", "_seq").alias("_end"))
    carried = ends.select("_file", "_start", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    splits = pinned(carried.join(files.select("_file", "fields"), "_file"))
    told = rows.filter("_data").join(small_side(splits), ["_file", "_start"])
    return told.select("value", "_file", "_start", F.row_number().over(inside).cast("bigint").alias("_seq"),
                       F.coalesce("_own", "_carried", "fields").alias("_fields"))
