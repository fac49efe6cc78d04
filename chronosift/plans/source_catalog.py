"""Queries over sources, sinks and streams. The files they read are written from the
given tables into the shared folder first, so their size follows the tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronosift.functions import predicates as P
from chronosift.operators.search import find
from chronosift.plans.catalog import MARKS_SQL, _histogram_sql, events, marks, parquet, query
from chronosift.plans.event_table import EventTable
from chronosift.session import scratch_path
from chronosift.sources.open import open_events
from chronosift.sources.options import FileOptions
from chronosift.sources.registry import Sources, load_syslog
from chronosift.sources.splits import at_home, cut_layout, in_order

CSV = {"header": True, "escape": '"'}
# Events that a document nests.
NESTED = 10_000


def _log(spark, sf) -> DataFrame:
    """Events as text cells, the way a log file holds them."""
    return parquet(spark, sf, "events").select(
        F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        F.col("user_id").cast("string"), "event_type", "props")


def _directory(pattern: str, **options) -> FileOptions:
    return FileOptions(is_directory=True, file_pattern=pattern, **options)


LOG_SQL = """select cast(event_id as varchar) as event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts,
  cast(user_id as varchar) as user_id, event_type, props, epoch_us(ts) // 1000 as event_ms from events"""


def _cells(t: EventTable) -> DataFrame:
    return t.df.select("event_id", "ts", "user_id", "event_type", "props",
                       F.col(t.EVENT_MS).alias("event_ms"))


@query("source_csv", LOG_SQL)
def source_csv(spark, sf):
    path = scratch_path(spark, "csv")
    _log(spark, sf).write.options(**CSV).csv(path)
    return _cells(open_events(spark, path, _directory("*.csv")))


@query("source_csv_row_index", """
select cast(event_id as varchar) as event_id, event_id as row_index from events""")
def source_csv_row_index(spark, sf):
    """Sorted before writing, so that file order is event order."""
    path = scratch_path(spark, "ordered")
    _log(spark, sf).orderBy(F.col("event_id").cast("bigint")).write.options(**CSV).csv(path)
    t = open_events(spark, path, _directory("*.csv"))
    return t.df.select("event_id", F.col(t.ROW_INDEX).alias("row_index"))


@query("source_csv_multiline", """
select cast(conv_id as varchar) as conv_id, cast(turn as varchar) as turn, role, text from conversations""")
def source_csv_multiline(spark, sf):
    """Texts with line breaks and quotes inside cells."""
    path = scratch_path(spark, "multiline")
    parquet(spark, sf, "conversations").select(
        F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text"
    ).write.options(**CSV).csv(path)
    return open_events(spark, path, _directory("*.csv")).result(ordered=False)


@query("source_csv_ragged", """
select cast(event_id as varchar) as event_id, event_type from events
where event_type <> 'click' and 'seen, by "u' || user_id || '"' like '%seen, by "u1%'""")
def source_csv_ragged(spark, sf):
    """Rows longer than the header: their surplus cells are found by free text."""
    path = scratch_path(spark, "ragged")
    more = F.when(F.col("event_type") == "click", "").otherwise(
        F.concat(F.lit(',x,"seen, by ""u'), "user_id", F.lit('"""')))
    parquet(spark, sf, "events").select(
        F.concat(F.col("event_id"), F.lit(","), "event_type", more).alias("event_id,event_type")).write.options(
        header=True, sep="\x01", quote="\x00").csv(path)
    found = open_events(spark, path, _directory("*.csv")).filter(P.term('seen, by "u1'))
    return found.result(ordered=False)


@query("source_csv_headerless", """
select cast(o_orderkey as varchar) as Unnamed_A, o_orderstatus as Unnamed_B, o_orderpriority as Unnamed_C from orders""")
def source_csv_headerless(spark, sf):
    path = scratch_path(spark, "headerless")
    parquet(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").write.csv(path)
    return open_events(spark, path, _directory("*.csv", no_header_row=True)).result(ordered=False)


@query("source_csv_gzip", LOG_SQL)
def source_csv_gzip(spark, sf):
    path = scratch_path(spark, "gzip")
    _log(spark, sf).write.options(**CSV).option("compression", "gzip").csv(path)
    return _cells(open_events(spark, path, _directory("*.csv.gz")))


@query("source_csv_bzip2", LOG_SQL)
def source_csv_bzip2(spark, sf):
    path = scratch_path(spark, "bzip2")
    _log(spark, sf).write.options(**CSV).option("compression", "bzip2").csv(path)
    return _cells(open_events(spark, path, _directory("*.csv.bz2")))


@query("source_directory_union", """
select cast(c_custkey as varchar) as id, c_name as name, c_mktsegment as segment, '' as nation, 'a_customers' as source
from customer union all
select cast(s_suppkey as varchar), s_name, '', cast(s_nationkey as varchar), 'b_suppliers' from supplier""")
def source_directory_union(spark, sf):
    """Two folders of files with different headers as one table, with a source column."""
    path = scratch_path(spark, "union")
    parquet(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment")).write.options(**CSV).csv(f"{path}/a_customers")
    parquet(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name")).write.options(**CSV).csv(f"{path}/b_suppliers")
    t = open_events(spark, path, _directory("**/*.csv", include_source=True))
    cell = lambda name: F.coalesce(name, F.lit("")).alias(name)
    return t.df.select("id", "name", cell("segment"), cell("nation"),
                       F.split_part("__source_file__", F.lit("/"), F.lit(1)).alias("source"))


@query("union_by_name", """
select c_name as name, c_nationkey as nationkey, c_mktsegment as segment from customer
union all select s_name, s_nationkey, null from supplier""")
def union_by_name(spark, sf):
    customers = parquet(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"))
    suppliers = parquet(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


@query("source_json_lines", LOG_SQL)
def source_json_lines(spark, sf):
    path = scratch_path(spark, "jsonl")
    _log(spark, sf).write.json(path)
    return _cells(open_events(spark, path, _directory("*.json")))


def _arrays(spark, sf, item, label: str) -> str:
    """Files with one JSON document each, a thousand records per document."""
    path = scratch_path(spark, label)
    chunk = F.floor(F.col("event_id").cast("bigint") / 1000).alias("chunk")
    documents = _log(spark, sf).groupBy(chunk).agg(F.sort_array(F.collect_list(item)).alias("records"))
    (documents.select("chunk", F.to_json(F.struct(F.struct("records").alias("data"))).alias("value"))
     .write.partitionBy("chunk").option("compression", "none").text(path))
    return path


@query("source_json_objects", """
select cast(event_id as varchar) as event_id, event_type, cast(user_id as varchar) as user_id, props from events""")
def source_json_objects(spark, sf):
    path = _arrays(spark, sf, F.struct("event_id", "event_type", "user_id", "props"), "objects")
    t = open_events(spark, path, _directory("**/*.txt", jpath="$.data.records", plugin_id=""),
                    kind="json")
    return t.result(ordered=False)


@query("source_json_preview", """
select cast(event_id as varchar) as event_id, event_type, props, cast(user_id as varchar) as user_id from events
where event_id < 1000 order by cast(event_id as varchar) limit 5""")
def source_json_preview(spark, sf):
    """First records of one of the documents."""
    from chronosift.sources.jsonfiles import preview
    path = _arrays(spark, sf, F.struct("event_id", "event_type", "user_id", "props"), "peek")
    return preview(spark, f"{path}/chunk=0/*.txt", "$.data.records")


@query("source_json_arrays", """
select cast(event_id as varchar) as id, event_type as type, props as detail from events""")
def source_json_arrays(spark, sf):
    """The first inner array of each document names the columns."""
    path = scratch_path(spark, "arrays")
    chunk = F.floor(F.col("event_id").cast("bigint") / 1000).alias("chunk")
    rows = _log(spark, sf).groupBy(chunk).agg(
        F.collect_list(F.array("event_id", "event_type", "props")).alias("rows"))
    names = F.array(F.array(F.lit("id"), F.lit("type"), F.lit("detail")))
    (rows.select("chunk", F.to_json(F.concat(names, F.col("rows"))).alias("value"))
     .write.partitionBy("chunk").text(path))
    return open_events(spark, path, _directory("**/*.txt", jpath="$"), kind="json").result(ordered=False)


@query("source_json_shapes", """
select cast(event_id as varchar) as event_id, event_type, case when event_id // 500 % 2 = 1 then props else '' end as detail,
  false as rejected, event_id as row_index from events
union all select '', '', '', true, (select count(*) from events) + i from range(2) t(i)""")
def source_json_shapes(spark, sf):
    """Documents of objects, documents of arrays, and two that hold neither, in one folder."""
    path = scratch_path(spark, "shapes")
    chunk = F.floor(F.col("event_id").cast("bigint") / 500)
    log = _log(spark, sf).withColumn("odd", chunk % 2 == 1).withColumn("chunk", F.lpad(chunk.cast("string"), 12, "0"))

    def documents(odd: bool, item, names) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct(F.col("event_id").cast("bigint"), item.alias("item"))))
        items = F.transform(rows, lambda r: r["item"])
        return log.filter(F.col("odd") == odd).groupBy("chunk").agg(
            F.to_json(items if names is None else F.concat(names, items)).alias("value"))

    names = F.array(F.array(F.lit("event_id"), F.lit("event_type"), F.lit("detail")))
    neither = spark.createDataFrame([("x1", '{"event_id": 1}'), ("x2", "[1, 2]")], "chunk string, value string")
    for part in (documents(False, F.struct("event_id", "event_type"), None),
                 documents(True, F.array("event_id", "event_type", "props"), names), neither):
        part.write.mode("append").partitionBy("chunk").text(path)
    t = open_events(spark, path, _directory("**/*.txt", jpath="$"), kind="json")
    cell = lambda name: F.coalesce(name, F.lit("")).alias(name)
    return t.df.select(cell("event_id"), cell("event_type"), cell("detail"),
                       (F.coalesce("_rejected", F.lit("")) != "").alias("rejected"), F.col(t.ROW_INDEX).alias("row_index"))


@query("source_upper_lines", "select upper(props) as content, count(*) as n from events group by 1")
def source_upper_lines(spark, sf):
    path = scratch_path(spark, "lines")
    parquet(spark, sf, "events").select("props").write.text(path)
    t = open_events(spark, path, FileOptions(plugin_id="upper"))
    return t.df.groupBy("content").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Log lines
# ---------------------------------------------------------------------------

def _lines(spark, sf, line) -> DataFrame:
    return parquet(spark, sf, "events").select("event_id", line.alias("value"))


@query("source_syslog", """
select event_id, case when event_type = 'signup' then '' when event_type in ('error', 'view', 'click')
    then strftime(ts, '%Y-%m-%d %H:%M:%S') else concat('Jan 32 ', strftime(ts, '%H:%M:%S')) end as timestamp,
  case when event_type = 'signup' then '' else concat('host', user_id) end as hostname,
  case event_type when 'error' then 'kernel' when 'click' then 'app[7]' else '' end as facility,
  case event_type when 'error' then '12345.678' else '' end as uptime,
  case event_type when 'signup' then concat('?? ', user_id) when 'view' then 'no facility here'
    else props end as message from events""")
def source_syslog(spark, sf):
    """ISO, classic, facility-less, impossible and unknown lines."""
    from chronosift.sources import syslog
    kind, host = F.col("event_type"), F.concat(F.lit(" host"), "user_id")
    classic = F.date_format("ts", "MMM d HH:mm:ss")
    line = (F.when(kind == "error", F.concat(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+13:00"), host,
                F.lit(" kernel: [12345.678] "), F.col("props")))
            .when(kind == "click", F.concat(classic, host, F.lit(" app[7]: "), F.col("props")))
            .when(kind == "view", F.concat(classic, host, F.lit(" no facility here")))
            .when(kind == "signup", F.concat(F.lit("?? "), "user_id"))
            .otherwise(F.concat(F.lit("Jan 32 "), F.date_format("ts", "HH:mm:ss"), host, F.lit(" "),
                                F.regexp_replace("props", ":", ":"))))
    parsed = syslog.parse(_lines(spark, sf, line), year=2024)
    # Purchases have a colon only inside the JSON text, which the line shape takes as facility.
    odd = (F.col("facility") != "") & F.col("facility").startswith("{")
    return parsed.select(
        "event_id", "timestamp", "hostname", F.when(odd, "").otherwise(F.col("facility")).alias("facility"),
        "uptime", F.when(odd, F.concat("facility", F.lit(": "), "message")).otherwise(F.col("message")).alias("message"))


@query("source_log_controls", """
select * from (select strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp, concat('ho', chr(31), 'st', user_id) as hostname,
  concat('app', chr(30)) as facility, '' as uptime, concat('a', chr(31), event_id, chr(30), '1') as message from events)
union all
select '', '', '', '', concat('?', chr(31), event_id) from events where event_type = 'error'""")
def source_log_controls(spark, sf):
    """Control characters in lines of an opened log can't move cells."""
    path = scratch_path(spark, "controls")
    line = F.concat(F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" ho\x1fst"), "user_id", F.lit(" app\x1e: a\x1f"), "event_id", F.lit("\x1e1"))
    rows = parquet(spark, sf, "events")
    rows.select(line).union(rows.filter("event_type = 'error'").select(F.concat(F.lit("?\x1f"), "event_id"))).write.text(path)
    sources = Sources()
    sources.register("syslog", ["txt"], partial(load_syslog, year=2024))
    return open_events(spark, path, _directory("*.txt"), sources=sources).result(ordered=False)


@query("source_ncsa_controls", """
select strftime(ts, '%Y-%m-%dT%H:%M:%S-08:00') as timestamp, concat('bob', chr(31), user_id) as username,
  event_id - (select min(event_id) from events) as row_index from events""")
def source_ncsa_controls(spark, sf):
    path = scratch_path(spark, "controls")
    rows = parquet(spark, sf, "events").orderBy("event_id")
    rows.select(F.concat(F.lit("10.0.0.1 - bob\x1f"), "user_id", F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
                         F.lit(' -0800] "GET /x HTTP/1.1" 200 5'))).write.text(path)
    t = open_events(spark, path, FileOptions(is_directory=True, file_pattern="*.txt", plugin_id="weblog"))
    return t.df.select("timestamp", "username", F.col(t.ROW_INDEX).alias("row_index"))


@query("find_surplus", """
select event_id as row_pos, case when event_type = 'error' then 2 else 3 end as column_index, '' as column_name,
  case when event_type = 'error' then 0 else 1 end as match_start, case when event_type = 'error' then 6 else 7 end as match_end,
  case when event_type = 'error' then concat('Needle ', event_id) else concat('"needle"') end as snippet
from events where event_type in ('error', 'click')""")
def find_surplus(spark, sf):
    """Cells beyond the header are searched too; they have places and no names."""
    path = scratch_path(spark, "surplus")
    kind = F.col("event_type")
    more = F.when(kind == "error", F.concat(F.lit(",Needle "), "event_id")).when(kind == "click", ',,"""needle"""').otherwise("")
    parquet(spark, sf, "events").orderBy("event_id").select(
        F.concat(F.col("event_id"), F.lit(","), "event_type", more).alias("event_id,event_type")).write.options(
        header=True, sep="\x01", quote="\x00").csv(path)
    return find(open_events(spark, path, _directory("*.csv")), "needle")


@query("source_json_concatenated", """
select cast(conv_id as varchar) as conv_id, cast(turn as varchar) as turn, role, text,
  row_number() over (order by conv_id, turn) - 1 as row_index from conversations""")
def source_json_concatenated(spark, sf):
    """Values one after another without a path: over several lines, several in a line, cut by splits anywhere."""
    path = scratch_path(spark, "values")
    rows = parquet(spark, sf, "conversations").select(
        F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text").orderBy(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"))
    pretty = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"pretty": "true"})
    flat = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    in_order(rows).select(F.when(F.col("turn") == "0", flat).otherwise(pretty)).write.option(
        "lineSep", " ").text(path)
    cut = cut_layout(spark, path, 20_000)
    t = open_events(cut, path, _directory("*.txt"), kind="json")
    return at_home(spark, t.df.select("conv_id", "turn", "role", "text", F.col(t.ROW_INDEX).alias("row_index")))


@query("source_json_root_array", """
select cast(event_id as varchar) as event_id, props, row_number() over (order by event_id) - 1 as row_index from events""")
def source_json_root_array(spark, sf):
    """One array over all lines of a file; nested values stay JSON text."""
    path = scratch_path(spark, "root")
    rows = in_order(parquet(spark, sf, "events").select("event_id", "props").orderBy("event_id"))
    item = F.concat(F.lit('{"event_id": "'), "event_id", F.lit('",\n  "props": '), "props", F.lit("}"))
    rows.withColumn("n", F.monotonically_increasing_id()).select(
        F.concat(F.when(F.col("n") == 0, "[").otherwise(","), item)).union(
        spark.range(1).select(F.lit("]"))).coalesce(1).write.text(path)
    cut = cut_layout(spark, path, 50_000)
    t = open_events(cut, path, FileOptions(is_directory=True, file_pattern="*.txt", jpath="$"), kind="json")
    return at_home(spark, t.df.select("event_id", F.regexp_replace("props", '":', '": ').alias("props"),
                                      F.col(t.ROW_INDEX).alias("row_index")))


@query("source_csv_splits", """
select cast(conv_id as varchar) as conv_id, cast(turn as varchar) as turn, role, text,
  row_number() over (order by conv_id, turn) - 1 as row_index from conversations""")
def source_csv_splits(spark, sf):
    """One file with line breaks and quotes in cells, read in many splits."""
    path = scratch_path(spark, "splits")
    in_order(parquet(spark, sf, "conversations").select(
        F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text").orderBy(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"))).write.options(**CSV).csv(path)
    cut = cut_layout(spark, path, 20_000)
    t = open_events(cut, path, _directory("*.csv"))
    return at_home(spark, t.df.select(*t.columns, F.col(t.ROW_INDEX).alias("row_index")))


@query("source_w3c", """
select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as timestamp, event_type as "cs-method",
  case when event_type = 'view' then '' else concat('/u/', user_id) end as "cs-uri-stem",
  case when event_type = 'click' then '' else '200' end as "sc-status" from events""")
def source_w3c(spark, sf):
    from chronosift.sources import weblogs
    kind = F.col("event_type")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), kind,
                       F.when(kind == "view", "-").otherwise(F.concat(F.lit("/u/"), "user_id")),
                       F.when(kind == "click", F.lit(None)).when(kind == "error", "200 surplus").otherwise("200"))
    return weblogs.parse_w3c(_lines(spark, sf, line), ["date", "time", "cs-method", "cs-uri-stem", "sc-status"])


@query("source_iis_native", """
select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as timestamp, concat('10.0.0.', user_id) as client_ip,
  case when event_type = 'view' then '' else event_type end as username, 'W3SVC2' as service, 'S1' as server,
  '10.9.9.9' as server_ip, '4502' as time_taken, '163' as bytes_received, '3223' as bytes_sent,
  '200' as status_code, '0' as win32_status, 'GET' as method, concat('/e/', event_id) as uri, '' as parameters
from events""")
def source_iis_native(spark, sf):
    from chronosift.sources import weblogs
    kind = F.col("event_type")
    line = F.concat_ws(", ", F.concat(F.lit("10.0.0."), "user_id"), F.when(kind == "view", "-").otherwise(kind),
                       F.date_format("ts", "M/dd/yy"), F.date_format("ts", "HH:mm:ss"), F.lit("W3SVC2"), F.lit("S1"),
                       F.lit("10.9.9.9"), F.lit("4502"), F.lit("163"), F.lit("3223"), F.lit("200"), F.lit("0"),
                       F.lit("GET"), F.concat(F.lit("/e/"), "event_id"), F.lit("-"))
    return weblogs.parse_iis(_lines(spark, sf, line))


@query("source_ncsa", """
select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S-08:00') as timestamp, concat('10.0.0.', user_id) as client_ip,
  '' as ident, case when event_type = 'view' then '' else event_type end as username, 'GET' as method,
  concat('/e/', event_id) as uri, 'HTTP/1.1' as protocol, '200' as status_code,
  case when event_type = 'error' then '' else '3401' end as bytes_sent from events where event_type <> 'click'""")
def source_ncsa(spark, sf):
    """Clicks are written as lines of another shape, which are dropped."""
    from chronosift.sources import weblogs
    kind = F.col("event_type")
    line = F.when(kind == "click", "# no request").otherwise(F.concat(
        F.lit("10.0.0."), "user_id", F.lit(" - "), F.when(kind == "view", "-").otherwise(kind), F.lit(" ["),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' -0800] "GET /e/'), "event_id", F.lit(' HTTP/1.1" 200 '),
        F.when(kind == "error", "-").otherwise("3401")))
    return weblogs.parse_ncsa(_lines(spark, sf, line))


@query("source_many_files", LOG_SQL)
def source_many_files(spark, sf):
    """More than five hundred files, none of which is left out."""
    path = scratch_path(spark, "many")
    _log(spark, sf).repartition(520).write.options(**CSV).csv(path)
    return _cells(open_events(spark, path, _directory("*.csv")))


@query("source_json_rejects", """
select case when event_type <> 'error' then cast(event_id as varchar) else '' end as event_id,
  case when event_type <> 'error' then event_type else '' end as event_type,
  case when event_type = 'error' then concat('{"event_id": ', event_id) else '' end as rejected from events""")
def source_json_rejects(spark, sf):
    """Lines that are no JSON are rows with their text."""
    path = scratch_path(spark, "rejects")
    good = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "event_type"))
    parquet(spark, sf, "events").select(F.when(
        F.col("event_type") == "error", F.concat(F.lit('{"event_id": '), "event_id")).otherwise(good)).write.text(path)
    t = open_events(spark, path, _directory("*.txt"), kind="json")
    return t.df.select("event_id", "event_type", F.col("_rejected").alias("rejected"))


@query("timeline_many", """
select strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as _TT_timestamp, concat('part=', part) as _TT_filepath,
  concat('file ', part) as _TT_file_description, case o_orderpriority when '1-URGENT' then 'urgent' else '' end as _TT_note,
  cast(o_orderkey as varchar) as o_orderkey, case when part % 2 = 0 then o_orderstatus else '' end as o_orderstatus,
  case when part % 2 = 1 then o_orderpriority else '' end as o_orderpriority
from (select *, o_orderkey % 200 as part from orders) where o_orderpriority in ('1-URGENT', '2-HIGH')""")
def timeline_many(spark, sf):
    """Annotated rows of two hundred files with two headers, found by file and row in the file."""
    from chronosift.operators.annotations import annotation_id
    from chronosift.sinks.timeline import PATH, folder_timeline
    from chronosift.sources.directory import listing
    path = scratch_path(spark, "many")
    part = F.col("o_orderkey") % 200
    orders = parquet(spark, sf, "orders").withColumn("part", part)
    time = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    for rest, name in ((0, "o_orderstatus"), (1, "o_orderpriority")):
        (orders.filter(part % 2 == rest).select(time, "o_orderkey", name, "part").repartition("part")
         .sortWithinPartitions("part", "o_orderkey").write.partitionBy("part").mode("append").options(**CSV).csv(path))
    number = F.row_number().over(Window.partitionBy("part").orderBy("o_orderkey")) - 1
    key = F.concat(F.lit("file"), F.col("part"))
    notes = orders.withColumn("row_index", number.cast("bigint")).filter("o_orderpriority in ('1-URGENT', '2-HIGH')").select(
        annotation_id(F.col("o_orderkey")).alias("annotation_id"), key.alias("file_key"), "row_index",
        F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").alias("note"),
        F.timestamp_seconds(F.lit(0)).alias("created_at"))
    number_of = F.regexp_extract("relative_path", r"part=(\d+)", 1)
    files = listing(spark, path, "**/*.csv").select(
        F.concat(F.lit("file"), number_of).alias("file_key"), F.col("path").alias("file_path"),
        F.concat(F.lit("file "), number_of).alias("description"))
    t = open_events(spark, path, _directory("**/*.csv", include_source=True))
    found = folder_timeline(t, path, notes, files)
    return found.withColumn(PATH, F.regexp_extract(PATH, r"part=\d+", 0))


@query("source_mixed_directory", """
select cast(c_custkey as varchar) as id, c_name as name, '' as nation, 'a' as source from customer union all
select cast(s_suppkey as varchar), s_name, '', 'b' from supplier union all
select '', n_name, cast(n_nationkey as varchar), 'c' from nation""")
def source_mixed_directory(spark, sf):
    """CSV, compressed JSON lines and Parquet in one folder."""
    path = scratch_path(spark, "mixed")
    parquet(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).write.options(
        **CSV).csv(f"{path}/a")
    parquet(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).write.option(
        "compression", "gzip").json(f"{path}/b")
    parquet(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name")).write.parquet(f"{path}/c")
    t = open_events(spark, path, _directory("**/*.{csv,json.gz,parquet}", include_source=True))
    cell = lambda name: F.coalesce(name, F.lit("")).alias(name)
    return t.df.select(cell("id"), cell("name"), cell("nation"),
                       F.split_part("__source_file__", F.lit("/"), F.lit(1)).alias("source"))


@query("source_log_directory", """
select strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as timestamp, event_type as method, '' as client_ip,
  row_number() over (order by event_id) - 1 as row_index from events union all
select strftime(ts, '%Y-%m-%dT%H:%M:%S-08:00'), 'GET', concat('10.0.0.', user_id),
  (select count(*) from events) + row_number() over (order by event_id) - 1 from events where event_type <> 'click'""")
def source_log_directory(spark, sf):
    """A folder of web server logs of two formats, one of them compressed; lines that hold no
    request are dropped, and row indexes have no gaps."""
    path = scratch_path(spark, "logs")
    log = parquet(spark, sf, "events").orderBy("event_id")
    kind = F.col("event_type")
    log.select(F.concat(F.lit("#Fields: date time cs-method\n"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss "), kind)).write.text(
        f"{path}/a")
    log.select(F.when(kind == "click", "# no request").otherwise(F.concat(
        F.lit("10.0.0."), "user_id", F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
        F.lit(' -0800] "GET /e HTTP/1.1" 200 34')))).write.option("compression", "gzip").text(f"{path}/b")
    t = open_events(spark, path, _directory("**/*.txt*", plugin_id="weblog"))
    return t.df.select("timestamp", F.coalesce("cs-method", "method").alias("method"),
                       F.coalesce("client_ip", F.lit("")).alias("client_ip"), F.col(t.ROW_INDEX).alias("row_index"))


@query("weblog_vote", """
select user_id as file, case when user_id % 4 = 0 then 'w3c' when user_id % 4 = 1 then 'ncsa'
  when user_id % 4 = 2 then 'iis_native' else 'unknown' end as format from events group by 1""")
def weblog_vote(spark, sf):
    """One log file per user, the formats by user; all lines of a file decide."""
    from chronosift.sources import weblogs
    style = F.col("user_id") % 4
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = (F.when(style == 0, F.concat(stamp, F.lit(" GET /x 200")))
            .when(style == 1, F.lit('1.2.3.4 - - [08/Apr/2024:17:39:04 -0800] "GET / HTTP/1.1" 200 34'))
            .when(style == 2, F.concat_ws(", ", *[F.lit("f")] * 12)).otherwise("plain words"))
    lines = parquet(spark, sf, "events").select(
        line.alias("value"), F.col("user_id").alias("_file"), F.col("event_id").alias("_seq"))
    return weblogs.vote(lines).select(F.col("_file").alias("file"), "format")


# ---------------------------------------------------------------------------
# Stores, fingerprints
# ---------------------------------------------------------------------------

@query("annotation_store", f"""
select annotation_id, row_index, note, color from {MARKS_SQL} where color <> 'red'""")
def annotation_store(spark, sf):
    from chronosift.operators.annotations import SCHEMA
    from chronosift.sinks import store
    path = scratch_path(spark, "store")
    store.save(marks(spark, sf), path)
    store.save(store.load(spark, path, SCHEMA).filter("color <> 'red'"), path)
    return store.load(spark, path, SCHEMA).select("annotation_id", "row_index", "note", "color")


@query("saved_events", "select event_id from events where ts >= timestamp '2024-01-20' and event_type = 'error'")
def saved_events(spark, sf):
    """A table saved once and queried again; the time bound reaches the Parquet scan."""
    from chronosift.sources.open import load_events, save_events
    path = scratch_path(spark, "saved")
    save_events(events(spark, sf), path)
    return load_events(spark, path).filter(P.field_eq("event_type", "error"), after="2024-01-20").df.select("event_id")


@query("timeline_export", f"""
select strftime(ts, '%Y-%m-%d %H:%M:%S') as _TT_timestamp, 'p' as _TT_filepath, 'd' as _TT_file_description,
  m.note as _TT_note, event_type, props from events join {MARKS_SQL} m on m.row_index = event_id""")
def timeline_export(spark, sf):
    """Written as CSV and read back."""
    from chronosift.sinks.timeline import export_timeline, timeline
    log = EventTable.of(parquet(spark, sf, "events").select(
        "ts", "event_type", "props", F.col("event_id").alias("rowno")), row_index="rowno", file_key="events::v1")
    files = spark.createDataFrame([("events::v1", "p", "d")], "file_key string, file_path string, description string")
    path = scratch_path(spark, "timeline")
    export_timeline(timeline([log], marks(spark, sf), files), path)
    return spark.read.options(header=True, escape='"').csv(path)


@query("selection_export", """
select cast(user_id as varchar) as user_id, props from (select * from events order by value desc, event_id limit 400)""")
def selection_export(spark, sf):
    from chronosift.sinks.selection import export_selection, selection
    path = scratch_path(spark, "selection")
    rows = selection(events(spark, sf).sort(("value", True)), [(0, 400)], ["user_id", "props"])
    export_selection(rows, path)
    return spark.read.options(header=True, sep="\t", quote="\0").csv(path)


@query("file_fingerprints", """
select s_suppkey, sha256(s_name || chr(10)) as file_hash, length(s_name) + 1 as length from supplier""")
def file_fingerprints(spark, sf):
    """One text file per supplier."""
    from chronosift.operators.fingerprints import file_hashes
    from chronosift.sources.directory import listing
    path = scratch_path(spark, "named")
    # A file takes longer to make and to move than to fill, so that all cores make and move them.
    parquet(spark, sf, "supplier").select("s_suppkey", "s_name").repartition(
        spark.sparkContext.defaultParallelism, "s_suppkey").write.partitionBy("s_suppkey").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    files = listing(spark, path, "**/*.txt")
    key = F.regexp_extract("relative_path", r"s_suppkey=(\d+)/", 1).cast("bigint")
    return file_hashes(files, ["relative_path", "length"]).select(key.alias("s_suppkey"), "file_hash", "length")


@query("directory_fingerprint")
def directory_fingerprint(spark, sf):
    from chronosift.operators.fingerprints import directory_changed, directory_hash
    found = directory_hash(spark, sf, "*.parquet")
    return spark.createDataFrame([(found, directory_changed(spark, sf, "*.parquet", found))],
                                 "directory_hash string, changed boolean")


@query("directory_locate", """
select distinct event_type as file_key, 'deep/copy/event_type=' || event_type as located_path from events""")
def directory_locate(spark, sf):
    """Directories registered by hash and pattern, found again below another root."""
    from chronosift.operators.fingerprints import directory_hashes
    from chronosift.operators.registry import locate_directories
    path = scratch_path(spark, "locate")
    parquet(spark, sf, "events").select("event_type", "props").write.partitionBy("event_type").text(f"{path}/deep/copy")
    known = directory_hashes(spark, f"{path}/deep/copy", ["*.txt"]).select(
        F.split_part("path", F.lit("="), F.lit(2)).alias("file_key"), F.lit("").alias("file_path"), "file_hash",
        F.struct(*[F.lit(v).alias(n) for n, v in (
            ("jpath", ""), ("no_header_row", True), ("ingest_tz", ""), ("plugin_id", ""), ("is_directory", True),
            ("file_pattern", "*.txt"), ("include_source", False))]).alias("options"), F.lit("").alias("description"))
    found = directory_hashes(spark, path, ["*.txt", "*.csv"])
    return locate_directories(known, found).select("file_key", "located_path")


@query("source_json_descent", """
select cast(event_id as varchar) as event_id, event_type from events where event_type <> 'click'""")
def source_json_descent(spark, sf):
    """Records picked by descent and a test from documents that nest them."""
    path = scratch_path(spark, "nested")
    item = F.to_json(F.struct("event_id", "event_type"))
    rows = parquet(spark, sf, "events")
    # A document is read as one cell: with more events there are more documents, not longer ones.
    documents = max(4, -(-rows.count() // NESTED))
    rows.groupBy((F.col("event_id") % documents).alias("_part")).agg(F.concat(
        F.lit('{"a":[{"list":['), F.array_join(F.collect_list(item), ","), F.lit("]}]}")).alias("value")).repartition(
        max(8, documents), "_part").select("value").write.text(path)
    found = open_events(spark, path, FileOptions(is_directory=True, file_pattern="*.txt",
                                                 jpath="$..list[?(@.event_type != 'click')]"), kind="json")
    return found.result(ordered=False)


@query("directory_preview", """
select 'event_id,event_type' as header, 4 as files,
  4 * 20 + sum(length(cast(event_id as varchar)) + length(event_type) + 2) as bytes from events""")
def directory_preview(spark, sf):
    from chronosift.sources.directory import preview
    path = scratch_path(spark, "preview")
    parquet(spark, sf, "events").select("event_id", "event_type").repartitionByRange(4, "event_id").write.options(
        **CSV).csv(path)
    _, header, n, size = preview(spark, path, "*.csv")
    return spark.createDataFrame([(",".join(header), n, size)], "header string, files long, bytes long")


# ---------------------------------------------------------------------------
# Streams, run over what is there and compared with the batch answer
# ---------------------------------------------------------------------------

def _stream(spark, sf) -> EventTable:
    from chronosift.streaming.live import stream_files, stream_table
    schema = parquet(spark, sf, "events").schema
    rows = stream_files(spark, sf, schema, pathGlobFilter="events.parquet", files_per_trigger=1)
    return stream_table(rows.withColumn("rowno", F.col("event_id")), "rowno", file_key="events::v1")


def _landed(spark, rows: DataFrame, label: str) -> DataFrame:
    from chronosift.streaming.live import append_files
    path = scratch_path(spark, label)
    append_files(rows, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


@query("stream_filter", """
select event_id, event_type from events where event_type like 'p%' and contains(props, '5')
  and ts >= timestamp '2024-01-10'""")
def stream_filter(spark, sf):
    t = _stream(spark, sf).filter(P.field_eq("event_type", "p*"), P.field_contains("props", "5"), after="2024-01-10")
    return _landed(spark, t.df.select("event_id", "event_type"), "stream-filter")


@query("stream_histogram", _histogram_sql("events", "ts", 3600000))
def stream_histogram(spark, sf):
    from chronosift.streaming.live import fill_buckets, live_histogram, settled_histogram, write_updates
    path = scratch_path(spark, "stream-histogram")
    write_updates(live_histogram(_stream(spark, sf), 3600, "1 hour"), f"{path}/out", f"{path}/state").awaitTermination()
    return fill_buckets(settled_histogram(spark, f"{path}/out"), 3600)


@query("stream_dedup", "select distinct event_type, cast(user_id as varchar) as user_id from events")
def stream_dedup(spark, sf):
    from chronosift.streaming.live import live_dedup
    rows = live_dedup(_stream(spark, sf), ["event_type", "user_id"], "40 days")
    return _landed(spark, rows.select("event_type", F.col("user_id").cast("string").alias("user_id")), "stream-dedup")


@query("stream_annotated", "select event_id from events where value >= 100 and event_type = 'click'")
def stream_annotated(spark, sf):
    from chronosift.streaming.live import live_annotated
    t = live_annotated(_stream(spark, sf).filter(P.field_eq("event_type", "click")), marks(spark, sf))
    return _landed(spark, t.df.select("event_id"), "stream-annotated")
