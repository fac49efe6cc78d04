"""Every operator as a query over the given tables, with the SQL that answers the same.

``QUERIES`` maps a name to a callable ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` maps
it to SQL where SQL can say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.functions import predicates as P
from chronosift.functions import timeparse
from chronosift.operators import annotations as A
from chronosift.plans.event_table import EventTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return add


# ---------------------------------------------------------------------------
# Tables
# ---------------------------------------------------------------------------

def parquet(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def table(spark: SparkSession, sf: str, name: str, **options) -> EventTable:
    return EventTable.from_parquet(spark, f"{sf}/{name}.parquet", file_key=f"{name}::v1", **options)


def events(spark: SparkSession, sf: str, **options) -> EventTable:
    return table(spark, sf, "events", **options)


def ids(found: EventTable) -> DataFrame:
    """The rows of a result, by the key the table carries."""
    return found.df.select(found.columns[0])


MIXED_SQL = """case event_type when 'error' then cast(user_id as varchar) when 'view' then ''
  when 'click' then props else event_type end"""
NUMBER_SQL = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def mixed(spark: SparkSession, sf: str) -> EventTable:
    """Events with a column of numbers, text and blanks."""
    kind = F.col("event_type")
    cell = (F.when(kind == "error", F.col("user_id").cast("string")).when(kind == "view", "")
            .when(kind == "click", F.col("props")).otherwise(kind))
    return EventTable.of(parquet(spark, sf, "events").select(
        "event_id", cell.alias("mixed"), "event_type", "user_id", "props",
        F.col("event_id").alias("rowno")), row_index="rowno")


# Annotations made from the data: every unusually large event is marked.
MARKS_SQL = """(select concat('ann-', event_id) as annotation_id, 'events::v1' as file_key,
  event_id as row_index, concat('user ', user_id) as note,
  case when event_type = 'error' then 'red' else 'grey' end as color from events where value >= 100)"""


def marks(spark: SparkSession, sf: str) -> DataFrame:
    moment = F.timestamp_seconds(F.lit(1700000000))
    return parquet(spark, sf, "events").filter("value >= 100").select(
        F.concat(F.lit("ann-"), "event_id").alias("annotation_id"),
        F.lit("events::v1").alias("file_key"), F.col("event_id").alias("row_index"),
        F.concat(F.lit("user "), "user_id").alias("note"),
        F.when(F.col("event_type") == "error", "red").otherwise("grey").alias("color"),
        F.lit("analyst").alias("created_by"), moment.alias("created_at"),
        moment.alias("updated_at"), F.lit(1).cast("bigint").alias("version"))


# ---------------------------------------------------------------------------
# Flagship: errors of a period, newest first, and their histogram
# ---------------------------------------------------------------------------

def error_window(spark: SparkSession, sf: str) -> EventTable:
    return events(spark, sf).filter(
        P.field_eq("event_type", "error"), after="2024-01-05", before="2024-01-20 12:00:00")


@query("error_timeline", """
select event_id, user_id, event_type, value, props from events
where event_type = 'error' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20 12:00:00.001'
order by (epoch_us(ts) // 1000) desc, event_id limit 1000""")
def error_timeline(spark, sf):
    return (error_window(spark, sf).sort(("ts", True)).limit(1000)
            .select("event_id", "user_id", "event_type", "value", "props").result())


@query("error_histogram", """
with b as (select ((epoch_us(ts) // 1000) // 21600000) * 21600000 as b, count(*) as n from events
  where event_type = 'error' and ts >= timestamp '2024-01-05'
  and ts < timestamp '2024-01-20 12:00:00.001' group by 1)
select s.b as bucket_start_ms, coalesce(b.n, 0) as n
from (select unnest(range(1704412800000, 1705752000000 + 1, 21600000)) as b) s left join b on b.b = s.b""")
def error_histogram(spark, sf):
    from chronosift.operators.histogram import histogram
    return histogram(error_window(spark, sf))


# ---------------------------------------------------------------------------
# Row index and counts
# ---------------------------------------------------------------------------

@query("row_index_parquet", "select o_orderkey as row_index, o_orderkey, o_orderstatus from orders")
def row_index_parquet(spark, sf):
    t = table(spark, sf, "orders")
    return t.df.select(F.col(t.ROW_INDEX).alias("row_index"), "o_orderkey", "o_orderstatus")


@query("row_count", "select count(*) as n from lineitem")
def row_count(spark, sf):
    return table(spark, sf, "lineitem").df.agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Time functions
# ---------------------------------------------------------------------------

SHAPES_SQL = """case event_type
  when 'error' then strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')
  when 'click' then strftime(ts, '%Y-%m-%d %H:%M:%S')
  when 'view' then strftime(ts, '%Y-%m-%dT%H:%M:%S+05:30')
  when 'signup' then cast((epoch_us(ts) // 1000) // 1000 as varchar)
  else strftime(ts, '%m/%d/%Y %H:%M:%S') end"""


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their time written in one of five ways."""
    kind, ts = F.col("event_type"), F.col("ts")
    written = (F.when(kind == "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
               .when(kind == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
               .when(kind == "view", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))
               .when(kind == "signup", F.unix_seconds(F.convert_timezone(
                   F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")).cast("string"))
               .otherwise(F.date_format("ts", "MM/dd/yyyy HH:mm:ss")))
    return parquet(spark, sf, "events").select(
        "event_id", written.alias("written"), F.col("event_id").alias("rowno"))


@query("parse_time", """
select event_id, case event_type when 'error' then (epoch_us(ts) // 1000)
  when 'click' then (epoch_us(ts) // 1000) // 1000 * 1000
  when 'view' then (epoch_us(ts) // 1000) // 1000 * 1000 - 19800000
  when 'signup' then (epoch_us(ts) // 1000) // 1000 * 1000 end as event_ms from events""")
def parse_time(spark, sf):
    t = EventTable.of(shapes(spark, sf), row_index="rowno").using_time("written")
    return t.df.select("event_id", F.col(t.EVENT_MS).alias("event_ms"))


@query("parse_time_rungs", """
select event_id, case event_id % 9 when 0 then epoch_us(ts) // 1000000 * 1000 when 1 then epoch_us(ts) // 1000
  when 2 then epoch_us(ts) // 1000 - 19800000 when 3 then epoch_us(ts) // 1000000 * 1000 + 12600000
  when 4 then epoch_us(ts) // 1000000 * 1000 when 5 then epoch_us(ts) // 1000000 * 1000 + 18000000
  when 6 then epoch_us(ts) // 60000000 * 60000 when 7 then epoch_us(ts) // 60000000 * 60000 end as event_ms from events""")
def parse_time_rungs(spark, sf):
    """Every shape of the ladder, an abbreviation from a table, and one that no table has."""
    at = lambda shape: F.date_format("ts", shape)
    written = F.array(
        F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp")).cast("string"),
        at("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.concat(at("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0530")),
        F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit("-03:30")), F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit(" GMT")),
        F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit(" EST")), at("yyyy-MM-dd HH:mm"),
        F.concat(at("dd/MM/yyyy h:mm"), F.lower(at("a"))), F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit(" XYZ")))
    rows = parquet(spark, sf, "events").select(
        "event_id", F.get(written, (F.col("event_id") % 9).cast("int")).alias("written"), F.col("event_id").alias("rowno"))
    t = EventTable.of(rows, row_index="rowno", zone_names={"EST": "-05:00"}).using_time("written")
    return t.df.select("event_id", F.col(t.EVENT_MS).alias("event_ms"))


@query("ingest_zone", """
select event_id, (epoch_us(ts) // 1000) // 1000 * 1000 - 13 * 3600000 as from_text,
  (epoch_us(ts) // 1000) - 13 * 3600000 as from_typed from events""")
def ingest_zone(spark, sf):
    zone = "Pacific/Auckland"
    df = parquet(spark, sf, "events").select(
        "event_id", "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("written"))
    session = spark.conf.get("spark.sql.session.timeZone")
    return df.select(
        "event_id", timeparse.text_millis(F.col("written"), zone).alias("from_text"),
        timeparse.millis(F.col("ts"), df.schema["ts"].dataType, zone, session).alias("from_typed"))


@query("display_time", """
select event_id, strftime(ts - interval 5 hour, '%Y-%m-%d %H:%M:%S') as ts from events""")
def display_time(spark, sf):
    return (events(spark, sf, display_zone="America/New_York").select("event_id", "ts")
            .result(ordered=False, format_time=True))


@query("time_equals", """
select event_id from events where cast(ts as date) = date '2024-01-10'
   or strftime(ts, '%Y-%m-%d %H') = '2024-01-12 07' or strftime(ts, '%Y-%m-%d %H:%M') like '2024-01-2_ 1_:3%'
   and strftime(ts, '%Y-%m-%d %H:%M:%S') like '2024-01-25 1%'""")
def time_equals(spark, sf):
    return ids(events(spark, sf).filter(P.any_of(
        P.field_eq("ts", "2024-01-10"), P.field_eq("ts", "2024-01-12T07"),
        P.all_of(P.field_eq("ts", "2024-01-25 1*"), P.term(":3"), _minute_thirties))))


def _minute_thirties(t: EventTable):
    return F.substring(t.shown("ts"), 15, 1) == "3"


@query("time_profile", f"""
select case event_type when 'error' then 'iso_offset' when 'view' then 'iso_offset'
  when 'click' then 'zoneless' when 'signup' then 'epoch' end as rung, count(*) as n
from events group by 1""")
def time_profile(spark, sf):
    from chronosift.operators.histogram import time_profile as profile
    return profile(EventTable.of(shapes(spark, sf), row_index="rowno"), "written")


@query("validate_time_column", """
select count(ts) > 0 as valid, 'ts' as name from events union all
select coalesce(bool_or(try_cast(props as timestamp) is not null), false), 'props' from events""")
def validate_time_column(spark, sf):
    from chronosift.operators.histogram import validate_time_column as check
    t = events(spark, sf)
    return spark.createDataFrame(
        [(check(t, name)[0], name) for name in ("ts", "props")], "valid boolean, name string")


# ---------------------------------------------------------------------------
# Filters
# ---------------------------------------------------------------------------

def _any_cell(test: str) -> str:
    cells = ("cast(event_id as varchar)", "cast(ts as varchar)", "cast(user_id as varchar)",
             "event_type", "cast(value as varchar)", "props")
    return " or ".join(test.format(cell=f"lower({c})") for c in cells)


FILTERS: dict[str, tuple[P.Test, str]] = {
    "any_field_contains": (P.term("12.3"), _any_cell("contains({cell}, '12.3')")),
    "quoted_phrase": (P.phrase('"k": 87'), _any_cell("contains({cell}, '\"k\": 87')")),
    "any_field_prefix": (P.term("SIGN*"), _any_cell("starts_with({cell}, 'sign')")),
    "field_equals": (P.field_eq("Event_Type", "ERROR"), "event_type = 'error'"),
    "field_prefix": (P.field_eq("event_type", "PUR*"), "event_type like 'pur%'"),
    "field_has_value": (P.field_eq("props", "*"), "trim(props) <> ''"),
    "field_not_equal": (P.field_ne("event_type", "View"), "event_type <> 'view'"),
    "field_not_prefix": (P.field_ne("event_type", "s*"), "event_type not like 's%'"),
    "field_contains": (P.field_contains("props", '"K": 5'), "contains(lower(props), '\"k\": 5')"),
    "field_not_contains": (P.field_not_contains("event_type", "I"), "not contains(event_type, 'i')"),
    "unknown_field": (P.any_of(P.field_contains("nope", "x"), P.all_of(
        P.field_not_contains("nope", "x"), P.field_eq("user_id", "42"))), "user_id = 42"),
    "json_equals": (P.field_eq("props{$.k}", "42"), "json_extract_string(props, '$.k') = '42'"),
    "json_prefix": (P.field_eq("props{$.k}", "4*"), "json_extract_string(props, '$.k') like '4%'"),
    "json_has_value": (P.field_eq("props{$.zzz}", "*"), "json_extract_string(props, '$.zzz') <> ''"),
    "json_not_equal": (P.field_ne("props{$.k}", "42"), "json_extract_string(props, '$.k') <> '42'"),
    "json_contains": (P.field_contains("props{$.k}", "7"),
                      "contains(json_extract_string(props, '$.k'), '7')"),
    "json_not_contains": (P.field_not_contains("props{$.k}", "7"),
                          "not contains(json_extract_string(props, '$.k'), '7')"),
    "json_missing_negative": (P.all_of(P.field_ne("props{$.zzz}", "1"), P.field_eq("user_id", "7")),
                              "user_id = 7"),
    "boolean_groups": (
        P.any_of(P.all_of(P.negate(P.field_eq("event_type", "view")),
                          P.any_of(P.field_eq("user_id", "8"), P.field_eq("user_id", "9*"))),
                 P.all_of(P.field_eq("event_type", "error"), P.field_contains("props", "33"))),
        "(event_type <> 'view' and (user_id = 8 or cast(user_id as varchar) like '9%'))"
        " or (event_type = 'error' and contains(props, '33'))"),
}

for _name, (_test, _where) in FILTERS.items():
    query(f"filter_{_name}", f"select event_id from events where {_where}")(
        lambda spark, sf, test=_test: ids(events(spark, sf).filter(test)))


@query("filter_documents_text", """
select doc_id from documents where contains(lower(text), 'nterti') or contains(lower(lang), 'nterti')
  or contains(lower(source), 'nterti')""")
def filter_documents_text(spark, sf):
    return ids(table(spark, sf, "documents").filter(P.term("Nterti")))


@query("filter_time_bounds", """
select event_id from events where ts >= timestamp '2024-01-03 04:05:06'
  and ts < timestamp '2024-01-09 00:00:00.001'""")
def filter_time_bounds(spark, sf):
    return ids(events(spark, sf).after("2024-01-03 04:05:06").before("2024-01-09"))


@query("filter_mixed", """
select event_id from events where ts >= timestamp '2024-01-28' and contains(props, '9')""")
def filter_mixed(spark, sf):
    return ids(events(spark, sf).filter(P.field_contains("props", "9"), after="2024-01-28"))


@query("filter_relative_time", """
select event_id from events where ts >= timestamp '2024-01-30 00:00:00' - interval 3 day
  and ts < timestamp '2024-01-29 12:00:00.001'""")
def filter_relative_time(spark, sf):
    from datetime import datetime, timezone
    now = datetime(2024, 1, 30, tzinfo=timezone.utc)
    return ids(events(spark, sf).after("3 days ago", now=now).before("12h", now=now))


@query("filter_chain", """
select event_id from events where event_type <> 'click' and user_id <> 11
  and contains(props, '1') and ts < timestamp '2024-01-15 00:00:00.001'""")
def filter_chain(spark, sf):
    return ids(events(spark, sf).filter(P.field_ne("event_type", "click"))
               .filter(P.field_ne("user_id", "11")).filter(P.field_contains("props", "1"))
               .before("2024-01-15"))


@query("time_range_brush", """
select event_id from events where event_type = 'view' and ts >= timestamp '2024-01-10'
  and ts < timestamp '2024-01-12 00:00:00.001'""")
def time_range_brush(spark, sf):
    base = events(spark, sf).filter(P.field_eq("event_type", "view"))
    shown = base.filter(after="2024-01-20")
    return ids(shown.time_range(base, 1704844800000, 1705017600000))


# ---------------------------------------------------------------------------
# Columns
# ---------------------------------------------------------------------------

@query("columns", "select props, event_id from events where event_type = 'signup'")
def columns(spark, sf):
    return (events(spark, sf).select("PROPS", "nope", " event_id ", "value").select("props", "event_id")
            .filter(P.field_eq("event_type", "signup")).result(ordered=False))


@query("strip", """
select event_id, user_id, props from events where event_type = 'view'""")
def strip(spark, sf):
    """Columns that hold only blanks in the current rows disappear."""
    cell = F.when(F.col("event_type") == "error", "x").otherwise("  ")
    df = parquet(spark, sf, "events").select(
        "event_id", cell.alias("only_errors"), "user_id", F.lit(None).cast("string").alias("nothing"),
        "props", "event_type", F.col("event_id").alias("rowno"))
    t = EventTable.of(df, row_index="rowno").filter(P.field_eq("event_type", "view"))
    return t.select("event_id", "only_errors", "user_id", "nothing", "props").strip().result(ordered=False)


@query("json_value", """
select event_id, json_extract_string(props, '$.k') as k from events""")
def json_value(spark, sf):
    from chronosift.functions.jsonpath import json_value as at
    return parquet(spark, sf, "events").select("event_id", at(F.col("props"), "$.k").alias("k"))


JSON_DOCUMENT = """'{"a":{"p":' || props || '},"list":[' || props || ',{"k":' || event_id || '}]}'"""


@query("json_value_descent", """
select event_id, cast(json_extract(props, '$.k') as bigint) as deep, event_id as last,
  cast(json_extract(props, '$.k') as bigint) as sliced, case when cast(json_extract(props, '$.k') as bigint) > 50
  then cast(json_extract(props, '$.k') as bigint) when event_id > 50 then event_id end as tested from events""")
def json_value_descent(spark, sf):
    from chronosift.functions.jsonpath import json_value as at
    document = F.expr(JSON_DOCUMENT)
    paths = {"deep": "$..k", "last": "$.list[-1].k", "sliced": "$.list[:1].k", "tested": "$.list[?(@.k > 50)].k"}
    return parquet(spark, sf, "events").select(
        "event_id", *[at(document, path).cast("bigint").alias(name) for name, path in paths.items()])


@query("json_cells", """
select event_id, case when event_type = 'view' then event_type else json_extract_string(props, '$.k') end
  as props from events""")
def json_cells(spark, sf):
    df = parquet(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "view", "view").otherwise(F.col("props")).alias("props"),
        F.col("event_id").alias("rowno"))
    return EventTable.of(df, row_index="rowno").result(ordered=False, paths={"props": "$.k"})


@query("time_first", "select ts, event_id, value from events where event_type = 'purchase'")
def time_first(spark, sf):
    return (events(spark, sf).filter(P.field_eq("event_type", "purchase"))
            .select("event_id", "value", "ts").time_first().result(ordered=False))


# ---------------------------------------------------------------------------
# Order, limit, pages, positions
# ---------------------------------------------------------------------------

@query("sort_columns", f"""
select event_id, row_number() over (order by trim({MIXED_SQL}) = '',
  case when regexp_full_match({MIXED_SQL}, '{NUMBER_SQL}') then try_cast({MIXED_SQL} as double) end nulls last,
  lower({MIXED_SQL}), user_id desc, event_id) - 1 as position from events""")
def sort_columns(spark, sf):
    t = mixed(spark, sf).sort("mixed", ("user_id", True))
    return t.positions(F.col("event_id")).select("event_id", "position")


@query("sort_descending", f"""
select event_id, row_number() over (order by trim({MIXED_SQL}) = '',
  case when regexp_full_match({MIXED_SQL}, '{NUMBER_SQL}') then try_cast({MIXED_SQL} as double) end
  desc nulls first, lower({MIXED_SQL}) desc, event_id) - 1 as position from events""")
def sort_descending(spark, sf):
    return mixed(spark, sf).sort(("mixed", True)).positions(F.col("event_id")).select(
        "event_id", "position")


@query("sort_then_sort", """
select event_id, row_number() over (order by event_type, user_id, event_id) - 1 as position from events""")
def sort_then_sort(spark, sf):
    return events(spark, sf).sort("user_id").sort("event_type").positions(F.col("event_id")).select(
        "event_id", "position")


@query("time_sort", """
select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) - 1 as position from orders""")
def time_sort(spark, sf):
    return table(spark, sf, "orders").sort(("O_OrderDate", True)).positions(F.col("o_orderkey")).select(
        "o_orderkey", "position")


@query("sort_json", """
select event_id, row_number() over (order by cast(json_extract_string(props, '$.k') as double) desc, event_id)
  - 1 as position from events""")
def sort_json(spark, sf):
    return events(spark, sf).sort(("props{$.k}", True)).positions(F.col("event_id")).select(
        "event_id", "position")


@query("implicit_time_sort", """
select event_id, user_id from (select * from events order by event_id limit 500)""")
def implicit_time_sort(spark, sf):
    return (events(spark, sf).limit(500).select("event_id", "user_id")
            .result(sort_by_time=True, descending=True))


@query("limit_after_sort", """
select l.event_id, l.value from (select * from events order by value desc, event_id limit 250) l""")
def limit_after_sort(spark, sf):
    return events(spark, sf).sort(("value", True)).limit(250).select("event_id", "value").result()


@query("limit_file_order", "select event_id, props from events order by event_id limit 321")
def limit_file_order(spark, sf):
    return events(spark, sf).limit(321).select("event_id", "props").result()


@query("filter_after_limit", """
select event_id from (select * from events order by value desc, event_id limit 1000) where event_type = 'error'""")
def filter_after_limit(spark, sf):
    return ids(events(spark, sf).sort(("value", True)).limit(1000).filter(P.field_eq("event_type", "error")))


@query("page", """
select event_id, value from (select * from events order by value desc, event_id limit 300 offset 700)""")
def page(spark, sf):
    return events(spark, sf).sort(("value", True)).page(700, 1000).select("event_id", "value").result()


@query("positions", """
select event_id, row_number() over (order by value, event_id) - 1 as position from events
where event_type = 'error'""")
def positions(spark, sf):
    return (events(spark, sf).filter(P.field_eq("event_type", "error")).sort("value")
            .positions(F.col("event_id")).select("event_id", "position"))


@query("position_of_row", """
select cast(event_id as int) as row_index, position from (select event_id,
  row_number() over (order by value desc, event_id) - 1 as position from events) where event_id in (0, 17, 500)""")
def position_of_row(spark, sf):
    t = events(spark, sf).sort(("value", True))
    return spark.createDataFrame([(i, t.position_of(i)) for i in (0, 17, 500)],
                                 "row_index int, position bigint")


# ---------------------------------------------------------------------------
# Distinct
# ---------------------------------------------------------------------------

@query("dedup", """
select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type
  order by event_id) as r from events) where r = 1""")
def dedup(spark, sf):
    return (events(spark, sf).dedup("user_id", "EVENT_TYPE").select("event_id", "user_id", "event_type")
            .result(ordered=False))


@query("dedup_in_order", """
select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority, o_orderstatus
  order by o_totalprice desc, o_orderkey) as r from orders) where r = 1""")
def dedup_in_order(spark, sf):
    return (table(spark, sf, "orders").sort(("o_totalprice", True)).dedup("o_orderpriority", "o_orderstatus")
            .select("o_orderkey", "o_orderpriority").result(ordered=False))


@query("dedup_shown", """
select event_type, props from (select distinct event_type, props from events)""")
def dedup_shown(spark, sf):
    return events(spark, sf).select("event_type", "props").dedup("unknown").result(ordered=False)


@query("dedup_json", """
select event_id from (select event_id, row_number() over (partition by json_extract_string(props, '$.k')
  order by event_id) as r from events) where r = 1""")
def dedup_json(spark, sf):
    return ids(events(spark, sf).dedup("props{$.k}"))


@query("dedup_lineitem", """
select l_partkey, l_suppkey, l_returnflag from lineitem group by 1, 2, 3""")
def dedup_lineitem(spark, sf):
    return (table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").dedup()
            .result(ordered=False))


# ---------------------------------------------------------------------------
# Time statistics and histograms
# ---------------------------------------------------------------------------

@query("time_stats", """
select min((epoch_us(ts) // 1000)) as min_ms, max((epoch_us(ts) // 1000)) as max_ms, count(*) as n from events
where event_type = 'error'""")
def time_stats(spark, sf):
    from chronosift.operators.histogram import time_stats_frame
    return time_stats_frame(events(spark, sf).filter(P.field_eq("event_type", "error")))


def _histogram_sql(source: str, time: str, width_ms: int) -> str:
    return f"""
with b as (select ((epoch_us({time}) // 1000) // {width_ms}) * {width_ms} as b, count(*) as n from {source} group by 1),
  e as (select min(b) as lo, max(b) as hi from b)
select s.b as bucket_start_ms, coalesce(b.n, 0) as n
from (select unnest(range(lo, hi + 1, {width_ms})) as b from e) s left join b on b.b = s.b"""


@query("histogram", _histogram_sql("events", "ts", 43200000))
def histogram(spark, sf):
    from chronosift.operators.histogram import histogram as build
    return build(events(spark, sf))


@query("histogram_lineitem", _histogram_sql("lineitem", "l_shipdate", 2592000000))
def histogram_lineitem(spark, sf):
    from chronosift.operators.histogram import histogram as build
    return build(table(spark, sf, "lineitem"))


@query("histogram_fixed_width", _histogram_sql("events", "ts", 600000))
def histogram_fixed_width(spark, sf):
    from chronosift.operators.histogram import histogram as build
    return build(events(spark, sf), width_s=600)


@query("histogram_sparse", """
select ((epoch_us(case when event_id % 1000 = 7 then ts + interval '7900 years' else ts end) // 1000) // 60000) * 60000
  as bucket_start_ms, count(*) as n from events group by 1""")
def histogram_sparse(spark, sf):
    """Minutes that have rows, with some rows dated far ahead."""
    from chronosift.operators.histogram import histogram as build
    t = events(spark, sf)
    far = F.when(F.col("event_id") % 1000 == 7, F.expr("ts + interval 7900 years")).otherwise(F.col("ts"))
    ahead = F.unix_millis(far.cast("timestamp"))
    return build(t.keeping(t.df.withColumn(t.EVENT_MS, ahead)), width_s=60, zeros=False)


WIDTHS_SQL = ("[1,2,5,10,30,60,300,600,1800,3600,7200,10800,21600,43200,86400,172800,432000,864000,"
              "2592000,15552000,31104000,62208000,155520000,311040000,622080000,1555200000]")


@query("bucket_widths", f"""
select event_type, list_filter({WIDTHS_SQL}, lambda w: ceil(greatest((hi - lo) // 1000, 1) / w) <= 100)[1] as width_s
from (select event_type, min((epoch_us(ts) // 1000)) as lo, max((epoch_us(ts) // 1000)) as hi from events group by 1)""")
def bucket_widths(spark, sf):
    from chronosift.operators.histogram import width_column
    t = events(spark, sf)
    when = F.col(t.EVENT_MS)
    spans = t.df.groupBy("event_type").agg(F.min(when).alias("lo"), F.max(when).alias("hi"))
    return spans.select("event_type", width_column(F.col("lo"), F.col("hi")).alias("width_s"))


@query("column_time_range", """
select min((epoch_us(o_orderdate) // 1000)) as min_ms, max((epoch_us(o_orderdate) // 1000)) as max_ms from orders""")
def column_time_range(spark, sf):
    from chronosift.operators.histogram import column_time_range as span
    return span(table(spark, sf, "orders"), "o_orderdate")


# ---------------------------------------------------------------------------
# Annotations
# ---------------------------------------------------------------------------

@query("annotated", "select event_id from events where value >= 100 and event_type = 'error'")
def annotated(spark, sf):
    t = events(spark, sf).filter(P.field_eq("event_type", "error"))
    return ids(A.annotated(t, marks(spark, sf)))


@query("not_annotated", "select event_id from events where value < 100 and event_type = 'error'")
def not_annotated(spark, sf):
    t = events(spark, sf).filter(P.field_eq("event_type", "error"))
    return ids(A.not_annotated(t, marks(spark, sf)))


@query("annotation_enrichment", f"""
select event_id as row_index, event_id, m.annotation_id is not null as annotated,
  coalesce(m.color, '') as color, coalesce(m.note, '') as note
from events left join {MARKS_SQL} m on m.row_index = event_id""")
def annotation_enrichment(spark, sf):
    return A.enrich(events(spark, sf).select("event_id"), marks(spark, sf))


@query("annotation_page_lookup", f"""
select event_id as row_index, m.annotation_id is not null as annotated, coalesce(m.color, '') as color,
  coalesce(m.note, '') as note
from (select * from events order by value desc, event_id limit 150 offset 50) e
left join {MARKS_SQL} m on m.row_index = event_id""")
def annotation_page_lookup(spark, sf):
    return A.lookup_page(events(spark, sf).sort(("value", True)), marks(spark, sf), 50, 200)


@query("annotation_positions", f"""
select m.annotation_id, m.row_index, m.note, m.color, coalesce(p.position, -1) as position
from {MARKS_SQL} m left join (select event_id, row_number() over (order by value, event_id) - 1 as position
  from events where event_type = 'error') p on p.event_id = m.row_index""")
def annotation_positions(spark, sf):
    t = events(spark, sf).filter(P.field_eq("event_type", "error")).sort("value")
    return A.with_positions(t, marks(spark, sf))


@query("annotations_per_file", f"select file_key, count(*) as annotations from {MARKS_SQL} group by 1")
def annotations_per_file(spark, sf):
    return A.counts_per_file(marks(spark, sf))


@query("annotate", f"""
select coalesce(m.annotation_id, 'new') as annotation_id, coalesce(m.row_index, e.event_id) as row_index,
  case when e.event_id is not null then 'checked' else m.note end as note,
  case when e.event_id is not null then 'blue' else m.color end as color,
  coalesce(case when m.annotation_id is null then 1 when e.event_id is not null then 2 end, 1) as version
from {MARKS_SQL} m full outer join (select event_id from events where event_type = 'signup') e
  on e.event_id = m.row_index""")
def annotate(spark, sf):
    t = events(spark, sf).filter(P.field_eq("event_type", "signup"))
    new = A.annotate(t, marks(spark, sf), "checked", "blue")
    known = F.col("annotation_id").startswith("ann-")
    return new.select(F.when(known, F.col("annotation_id")).otherwise("new").alias("annotation_id"),
                      "row_index", "note", "color", "version")


@query("annotate_ranges", f"""
select coalesce(m.row_index, e.event_id) as row_index,
  case when e.event_id is not null then 'range' else m.note end as note
from {MARKS_SQL} m full outer join (select event_id from (select event_id,
  row_number() over (order by value, event_id) - 1 as p from events)
  where p between 10 and 29 or p between 100 and 104) e on e.event_id = m.row_index""")
def annotate_ranges(spark, sf):
    t = events(spark, sf).sort("value")
    return A.annotate(t, marks(spark, sf), "range", ranges=[(10, 30), (100, 105)]).select(
        "row_index", "note")


@query("annotate_range_table", f"""
select coalesce(m.row_index, e.event_id) as row_index,
  case when e.event_id is not null then 'range' else m.note end as note
from {MARKS_SQL} m full outer join (select event_id from (select event_id,
  row_number() over (order by value, event_id) - 1 as p from events)
  where p in (select 3 * o_orderkey from orders)
    or p in (select 3 * o_orderkey + 1 from orders where o_custkey % 2 = 1)) e on e.event_id = m.row_index""")
def annotate_range_table(spark, sf):
    """As many ranges as there are orders."""
    start = 3 * F.col("o_orderkey")
    ranges = parquet(spark, sf, "orders").select(start, start + 1 + F.col("o_custkey") % 2)
    t = events(spark, sf).sort("value")
    return A.annotate(t, marks(spark, sf), "range", ranges=ranges).select("row_index", "note")


@query("unannotate", f"select annotation_id, row_index from {MARKS_SQL} where color <> 'red'")
def unannotate(spark, sf):
    t = events(spark, sf).filter(P.field_eq("event_type", "error"))
    return A.unannotate(t, marks(spark, sf)).select("annotation_id", "row_index")


@query("annotation_by_id", f"""
select annotation_id, note from {MARKS_SQL} where annotation_id = (select min(annotation_id) from {MARKS_SQL})""")
def annotation_by_id(spark, sf):
    all_marks = marks(spark, sf)
    first = all_marks.agg(F.min("annotation_id")).first()[0]
    return A.get_by_id(all_marks, first).select("annotation_id", "note")


@query("annotation_delete", f"""
select annotation_id from {MARKS_SQL} where annotation_id <> (select min(annotation_id) from {MARKS_SQL})""")
def annotation_delete(spark, sf):
    all_marks = marks(spark, sf)
    first = all_marks.agg(F.min("annotation_id")).first()[0]
    return A.delete_by_id(all_marks, first).select("annotation_id")


def variant_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Marks of several readings of several files, keyed by event type."""
    key = F.concat_ws("::", "event_type", F.lit(""), F.when(F.col("user_id") > 75, "true").otherwise("false"),
                      F.when(F.col("value") > 50, "UTC").otherwise("default"), F.lit("default"), F.lit("file"))
    return parquet(spark, sf, "events").select(
        F.concat(F.lit("ann-"), "event_id").alias("annotation_id"), key.alias("file_key"),
        F.col("event_id").alias("row_index"), F.col("props").alias("note"),
        F.when(F.col("value") > 100, "red").otherwise("grey").alias("color"))


@query("annotation_delete_file", """
select concat('ann-', event_id) as annotation_id from events where event_type <> 'view'""")
def annotation_delete_file(spark, sf):
    return A.delete_by_file(variant_marks(spark, sf), "view").select("annotation_id")


@query("annotation_delete_variant", """
select concat('ann-', event_id) as annotation_id from events
where not (event_type = 'view' and user_id > 75 and value <= 50)""")
def annotation_delete_variant(spark, sf):
    return A.delete_by_variant(variant_marks(spark, sf), "view", no_header_row=True).select("annotation_id")


@query("annotation_list", """
select concat('ann-', event_id) as annotation_id, 'file' as listed from events where event_type = 'click'
union all select concat('ann-', event_id), 'color' from events where value > 100""")
def annotation_list(spark, sf):
    all_marks = variant_marks(spark, sf)
    by_file = A.list_annotations(all_marks, file_hash="click", color="red")
    by_color = A.list_annotations(all_marks, color="red")
    return by_file.select("annotation_id", F.lit("file").alias("listed")).union(
        by_color.select("annotation_id", F.lit("color").alias("listed")))


@query("annotation_batch_update", f"""
select annotation_id, row_index, 'batch' as note, color from {MARKS_SQL}""")
def annotation_batch_update(spark, sf):
    all_marks = marks(spark, sf)
    updates = all_marks.select("annotation_id", F.lit("batch").alias("note"), F.lit("").alias("color"))
    return A.batch_update(all_marks, updates)[0].select("annotation_id", "row_index", "note", "color")


@query("annotation_batch_counts", f"""
select count(*) as succeeded, count(*) as failed from {MARKS_SQL}""")
def annotation_batch_counts(spark, sf):
    all_marks = marks(spark, sf)
    known = all_marks.select("annotation_id", F.lit("n").alias("note"), F.lit("").alias("color"))
    unknown = known.withColumn("annotation_id", F.concat(F.lit("no-"), "annotation_id"))
    return A.batch_update(all_marks, known.union(unknown))[1]


@query("annotation_batch_create", f"""
select row_index, note, color from {MARKS_SQL}
union all select unnest([5, 6, 7]), 'batch', 'grey'""")
def annotation_batch_create(spark, sf):
    return A.batch_create(marks(spark, sf), "events::v1", [5, 6, 7], "batch", batch="b1").select(
        "row_index", "note", "color")


@query("annotation_validate", """
select event_id, case when event_type = 'error' then 'row_index negative'
  when event_type = 'click' then 'color too long' else '' end as problem from events""")
def annotation_validate(spark, sf):
    kind = F.col("event_type")
    records = parquet(spark, sf, "events").select(
        "event_id", F.col("props").alias("note"),
        F.when(kind == "click", F.repeat(F.lit("red"), 9)).otherwise("red").alias("color"),
        A.annotation_id(F.col("event_id")).alias("annotation_id"),
        F.sha2("props", 256).alias("file_hash"),
        F.when(kind == "error", -1 - F.col("event_id")).otherwise(F.col("event_id")).alias("row_index"))
    return A.validate(records).select("event_id", F.array_join("problems", ";").alias("problem"))


@query("reconcile_annotations", """
select concat('ann-', event_id) as annotation_id, event_id as row_index from events
where event_type in ('error', 'view')""")
def reconcile_annotations(spark, sf):
    store = variant_marks(spark, sf).withColumn("file_key", F.split_part(
        "file_key", F.lit("::"), F.lit(1))).withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    older = store.filter("color = 'red'").withColumns({
        "created_at": F.timestamp_seconds(F.lit(-1)), "annotation_id": F.concat(F.lit("old-"), "annotation_id")})
    files = parquet(spark, sf, "events").filter(F.col("event_type").isin("error", "view")).select(
        F.col("event_type").alias("file_key")).distinct()
    return A.reconcile(store.unionByName(older), files).select("annotation_id", "row_index")


# ---------------------------------------------------------------------------
# Registry, locations, audit: customers stand for files, nations for instances
# ---------------------------------------------------------------------------

def registry(spark: SparkSession, sf: str) -> DataFrame:
    return parquet(spark, sf, "customer").select(
        F.col("c_name").alias("file_key"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("/logs/"), "c_mktsegment")).otherwise("").alias("file_path"),
        F.col("c_custkey").cast("string").alias("file_hash"), F.col("c_mktsegment").alias("description"))


@query("file_register", """
select c_name as file_key, case when c_nationkey = 3 then 'new' else c_mktsegment end as description from customer""")
def file_register(spark, sf):
    known = registry(spark, sf)
    new = (parquet(spark, sf, "customer").filter("c_nationkey = 3").select(F.col("c_name").alias("file_key"))
           .join(known, "file_key").withColumn("description", F.lit("new")))
    from chronosift.operators.registry import register
    return register(known, new).select("file_key", "description")


@query("file_remove", """
select 'file' as kind, count(*) as n from customer where c_nationkey <> 3
union all select 'annotation', count(*) from orders join customer on c_custkey = o_custkey where c_nationkey <> 3""")
def file_remove(spark, sf):
    from chronosift.operators.registry import remove
    customers = parquet(spark, sf, "customer")
    notes = parquet(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("file_key"), F.col("o_orderkey").alias("row_index"))
    gone = customers.filter("c_nationkey = 3").select(F.col("c_name").alias("file_key"))
    files, left = remove(registry(spark, sf), notes, gone)
    counted = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return counted(files, "file").union(counted(left, "annotation"))


@query("file_list", """
select c_name as file_key, c_custkey as hash, count(o_orderkey) as annotations
from customer left join orders on o_custkey = c_custkey group by 1, 2""")
def file_list(spark, sf):
    from chronosift.operators.registry import list_files
    notes = parquet(spark, sf, "orders").select(
        F.format_string("Customer#%09d", "o_custkey").alias("file_key"), F.col("o_orderkey").alias("row_index"))
    return list_files(registry(spark, sf), notes).select(
        "file_key", F.col("file_hash").cast("bigint").alias("hash"), "annotations")


@query("file_describe", """
select c_name as file_key, case when c_custkey = 7 then 'seen' else c_mktsegment end as description from customer""")
def file_describe(spark, sf):
    from chronosift.operators.registry import describe
    return describe(registry(spark, sf), "Customer#000000007", "seen").select("file_key", "description")


@query("file_locate", """
select c_name as file_key, concat('/scan/', lpad(cast(min(o_orderkey) as varchar), 9, '0')) as located_path
from customer join orders on o_custkey = c_custkey group by 1""")
def file_locate(spark, sf):
    from chronosift.operators.registry import locate
    scanned = parquet(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("file_hash"),
        F.format_string("/scan/%09d", "o_orderkey").alias("path"))
    return locate(registry(spark, sf), scanned).select("file_key", "located_path")


@query("file_paths", """
select c_name as file_key, coalesce(arg_max(cast(o_orderkey as varchar), o_orderkey),
  case when any_value(c_acctbal) > 0 then concat('/logs/', any_value(c_mktsegment)) else '' end) as file_path
from customer left join (select * from orders where o_orderpriority = '1-URGENT') on o_custkey = c_custkey
group by 1""")
def file_paths(spark, sf):
    from chronosift.operators.registry import resolve_paths
    locations = parquet(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("instance_id"), F.col("o_custkey").cast("string").alias("file_hash"),
        F.lit("w").alias("workspace_id"), F.col("o_orderkey").cast("string").alias("file_path"),
        F.timestamp_seconds("o_orderkey").alias("updated_at"))
    return resolve_paths(registry(spark, sf), locations, "1-URGENT", "w").select("file_key", "file_path")


@query("reconcile_files", """
select c_name as file_key, case when c_acctbal > 0 and c_nationkey < 10 then concat('/logs/', c_mktsegment)
  else '' end as file_path from customer""")
def reconcile_files(spark, sf):
    from chronosift.operators.registry import reconcile_files as merge
    store = registry(spark, sf)
    near = parquet(spark, sf, "customer").filter("c_nationkey < 10").select(F.col("c_name").alias("file_key"))
    return merge(store, store.join(near, "file_key", "left_semi")).select("file_key", "file_path")


@query("audit_log", """
select event_id as audit_id, props as description from events where event_type = 'error'
  and ts + interval 90 day > timestamp '2024-04-10' order by ts desc, event_id limit 500""")
def audit_log(spark, sf):
    from chronosift.operators.registry import AUDIT_DAYS, latest_audit
    log = parquet(spark, sf, "events").select(
        F.col("event_id").alias("audit_id"), F.col("event_type").alias("workspace_id"),
        F.col("user_id").cast("string").alias("email"), F.col("props").alias("description"),
        F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp").alias("created_at"))
    log = log.withColumn("ttl", F.unix_seconds(F.col("created_at") + F.make_dt_interval(F.lit(AUDIT_DAYS))))
    now = F.timestamp_seconds(F.lit(1712707200 - 1))
    return latest_audit(log, "error", 500, now).select("audit_id", "description")


# ---------------------------------------------------------------------------
# Search
# ---------------------------------------------------------------------------

def _find_sql(cells: dict[int, tuple[str, str]], source: str, position: str, needle: str) -> str:
    parts = [f"select {position} as row_pos, {i} as column_index, '{name}' as column_name, {cell} as cell from {source}"
             for i, (name, cell) in cells.items()]
    return f"""
select row_pos, column_index, column_name, s as match_start, s + {len(needle)} as match_end,
  concat(case when lo > 0 then '…' else '' end, substring(cell, lo + 1, hi - lo),
         case when hi < length(cell) then '…' else '' end) as snippet
from (select *, greatest(s - 30, 0) as lo, least(s + {len(needle)} + 30, length(cell)) as hi
  from (select *, instr(lower(cell), '{needle}') - 1 as s from ({' union all '.join(parts)})) where s >= 0)
"""


@query("find_text", _find_sql({0: ("doc_id", "cast(doc_id as varchar)"), 1: ("text", "text"), 2: ("lang", "lang"),
                               3: ("source", "source"), 4: ("n_chars", "cast(n_chars as varchar)")},
                              "documents", "doc_id", "the in"))
def find_text(spark, sf):
    from chronosift.operators.search import find
    return find(table(spark, sf, "documents"), "The In")


@query("find_in_result", _find_sql(
    {0: ("event_id", "cast(event_id as varchar)"), 1: ("ts", "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
     2: ("user_id", "cast(user_id as varchar)"), 3: ("event_type", "event_type"),
     4: ("value", "cast(value as varchar)"), 5: ("props", "props")},
    "(select *, row_number() over (order by value desc, event_id) - 1 as p from events where event_type <> 'view')",
    "p", "12"))
def find_in_result(spark, sf):
    from chronosift.operators.search import find
    return find(events(spark, sf).filter(P.field_ne("event_type", "view")).sort(("value", True)), "12")


@query("find_regex", """
select page_id as row_pos, 1 as column_index, 'url' as column_name,
  instr(url, regexp_extract(url, '[a-z]+[.]example[.](com|org)')) - 1 as match_start,
  instr(url, regexp_extract(url, '[a-z]+[.]example[.](com|org)')) - 1
    + length(regexp_extract(url, '[a-z]+[.]example[.](com|org)')) as match_end
from pages where regexp_matches(url, '[a-z]+[.]example[.](com|org)')""")
def find_regex(spark, sf):
    from chronosift.operators.search import find
    t = EventTable.of(parquet(spark, sf, "pages").select(
        "page_id", "url", F.col("page_id").alias("rowno")), row_index="rowno")
    return find(t, "[a-z]+[.]example[.](com|org)", regex=True, max_hits=None).drop("snippet")


@query("find_page", """
select row_pos, column_index from (select event_id as row_pos, 5 as column_index from events
  where contains(props, '"k": 1') order by event_id limit 1000 offset 1000)""")
def find_page(spark, sf):
    from chronosift.operators.search import find, hit_page
    hits = find(events(spark, sf), '"K": 1')
    return hit_page(hits, 1).select("row_pos", "column_index")


@query("highlight", """
with c as (select row_number() over (order by conv_id, turn) - 1 as row_index, * from conversations),
cells as (select row_index, 0 as column_index, cast(conv_id as varchar) as cell from c
  union all select row_index, 1, cast(turn as varchar) from c
  union all select row_index, 2, lower(role) from c union all select row_index, 3, lower(text) from c),
places as (select row_index, column_index, i as s, i + length(t) as e
  from (select *, unnest(range(length(cell))) as i from cells), (select unnest(['en', 'nte', 'the ']) as t)
  where substring(cell, i + 1, length(t)) = t),
reached as (select *, max(e) over (partition by row_index, column_index order by s, e
  rows between unbounded preceding and 1 preceding) as reach from places),
islands as (select *, sum(case when s <= reach then 0 else 1 end) over (partition by row_index, column_index
  order by s, e rows unbounded preceding) as island from reached)
select row_index, column_index, min(s) as span_start, max(e) as span_end from islands
group by row_index, column_index, island""")
def highlight(spark, sf):
    from chronosift.operators.search import highlight as spans
    return spans(table(spark, sf, "conversations"), ["en", "nte", "the "])


# ---------------------------------------------------------------------------
# Sinks
# ---------------------------------------------------------------------------

@query("timeline", f"""
select strftime(ts, '%Y-%m-%d %H:%M:%S') as _TT_timestamp, '/logs/events' as _TT_filepath,
  'event log' as _TT_file_description, m.note as _TT_note, cast(event_id as varchar) as event_id, event_type,
  '' as o_custkey, '' as o_orderkey, '' as o_orderpriority, '' as o_orderstatus, props,
  cast(user_id as varchar) as user_id
from events join {MARKS_SQL} m on m.row_index = event_id
union all
select strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '/logs/orders', 'orders', 'urgent', '', '',
  cast(o_custkey as varchar), cast(o_orderkey as varchar), o_orderpriority, o_orderstatus, '', ''
from orders where o_orderpriority = '1-URGENT'""")
def timeline(spark, sf):
    from chronosift.sinks.timeline import timeline as build
    orders = parquet(spark, sf, "orders")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select(
        F.concat(F.lit("ann-o"), "o_orderkey").alias("annotation_id"), F.lit("orders::v1").alias("file_key"),
        F.col("o_orderkey").alias("row_index"), F.lit("urgent").alias("note"), F.lit("red").alias("color"),
        F.timestamp_seconds(F.lit(0)).alias("created_at"))
    notes = marks(spark, sf).unionByName(urgent, allowMissingColumns=True)
    files = spark.createDataFrame(
        [("events::v1", "/logs/events", "event log"), ("orders::v1", "/logs/orders", "orders")],
        "file_key string, file_path string, description string")
    log = EventTable.of(parquet(spark, sf, "events").drop("value").withColumn(
        "rowno", F.col("event_id")), row_index="rowno", file_key="events::v1")
    book = EventTable.of(orders.drop("o_totalprice").withColumn(
        "rowno", F.col("o_orderkey")), row_index="rowno", file_key="orders::v1")
    return build([log, book], notes, files)


@query("selection_range_table", """
select p as position, event_type from (select row_number() over (order by value desc, event_id) - 1 as p, event_type from events)
where exists (select 1 from customer where p >= 11 * c_custkey - 20 and p < 11 * c_custkey - 20 + c_nationkey)""")
def selection_range_table(spark, sf):
    """Overlapping ranges, also below the first and beyond the last row."""
    from chronosift.sinks.selection import selection as pick
    start = 11 * F.col("c_custkey") - 20
    ranges = parquet(spark, sf, "customer").select(start, start + F.col("c_nationkey"))
    return pick(events(spark, sf).sort(("value", True)), ranges, ["event_type"])


@query("selection", """
select p as position, user_id as user, coalesce(k, '') as props, '' as nope from (select
  row_number() over (order by value desc, event_id) - 1 as p, cast(user_id as varchar) as user_id,
  json_extract_string(props, '$.k') as k from events) where p between 5 and 24 or p between 90 and 99""")
def selection(spark, sf):
    from chronosift.sinks.selection import selection as pick
    return pick(events(spark, sf).sort(("value", True)), [(5, 25), (90, 100)],
                ["USER_ID", "props", "nope"], ["user", "props", "nope"], {"props": "$.k"})
