from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from chronosift.functions import timeparse as tp

# Input, epoch ms with zone-less values read as UTC, Auckland, New York (None = no time).
CASES = [
    ("2024-01-15 09:30:00", 1705311000000, 1705264200000, 1705329000000),
    ("2024-01-15 14:45:30", 1705329930000, 1705283130000, 1705347930000),
    ("2024-01-15 00:00:00", 1705276800000, 1705230000000, 1705294800000),
    ("2024-01-15 23:59:59", 1705363199000, 1705316399000, 1705381199000),
    ("2024-06-15 12:00:00", 1718452800000, 1718409600000, 1718467200000),
    ("2024-12-15 12:00:00", 1734264000000, 1734217200000, 1734282000000),
    ("2024-01-15T09:30:00Z", 1705311000000, 1705311000000, 1705311000000),
    ("2024-01-15T09:30:00+13:00", 1705264200000, 1705264200000, 1705264200000),
    ("2024-01-15T09:30:00-05:00", 1705329000000, 1705329000000, 1705329000000),
    ("2024-01-15T09:30:00+05:30", 1705291200000, 1705291200000, 1705291200000),
    ("2024-01-15T09:30:00-03:30", 1705323600000, 1705323600000, 1705323600000),
    ("2024-01-15T09:30:00.123456Z", 1705311000123, 1705311000123, 1705311000123),
    ("2024-01-15T09:30:00.5+0300", 1705300200500, 1705300200500, 1705300200500),
    ("2024-01-15 09:30:00Z", 1705311000000, 1705311000000, 1705311000000),
    ("2024-01-15 09:30:00 UTC", 1705311000000, 1705311000000, 1705311000000),
    ("2024-01-15T09:30:00.25 UTC", 1705311000250, 1705311000250, 1705311000250),
    ("2024-01-15 9:30", 1705311000000, 1705264200000, 1705329000000),
    ("2024-01-15T09:30", 1705311000000, 1705264200000, 1705329000000),
    ("2024-01-15", 1705276800000, 1705230000000, 1705294800000),
    ("  2024-01-15\t", 1705276800000, 1705230000000, 1705294800000),
    ("15/01/2024 9:30am", 1705311000000, 1705264200000, 1705329000000),
    ("15/01/2024 12:15 pm", 1705320900000, 1705274100000, 1705338900000),
    ("15/01/2024 12:15am", 1705277700000, 1705230900000, 1705295700000),
    ("1705311000", 1705311000000, 1705311000000, 1705311000000),
    ("1705311000123", 1705311000123, 1705311000123, 1705311000123),
    ("-5", -5000, -5000, -5000),
    ("2024", 2024000, 2024000, 2024000),
    *[(v, None, None, None) for v in (
        "01/15/2024 09:30:00", "15/01/2024 09:30:00", "Jan 15 2024 09:30:00",
        "15 Jan 2024 09:30:00", "2024-01", "2024-1-5", "2024-02-30", "2024-01-15 24:00:00",
        "2024-01-15T09:30:00 UTC", "2024-01-15 09:30:00 EST", "2024-01-15 09:30:00+0300",
        "13/01/2024 13:00pm", "noon", "", "99999999999999999999")],
    (None, None, None, None),
]


@pytest.mark.parametrize("zone,place", [("UTC", 1), ("Pacific/Auckland", 2), ("America/New_York", 3)])
def test_ladder(spark, zone, place):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, v string")
    got = {r.i: r.ms for r in df.select("i", tp.text_millis(F.col("v"), zone).alias("ms")).collect()}
    for i, case in enumerate(CASES):
        assert got[i] == case[place], case[0]
        if case[0]:
            assert tp.literal_millis(case[0], zone) == case[place] or case[0].startswith("9999"), case[0]


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_typed_columns_do_not_depend_on_the_session_zone(spark, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        df = spark.sql("select timestamp_ntz'2024-07-15 09:30:00' n, timestamp'2024-07-15 09:30:00Z' t")
        row = df.select(
            tp.millis(F.col("n"), df.schema["n"].dataType, "Pacific/Auckland", session_zone),
            tp.millis(F.col("n"), df.schema["n"].dataType, "UTC", session_zone),
            tp.millis(F.col("t"), df.schema["t"].dataType, "Pacific/Auckland", session_zone),
            tp.display_time(F.lit(1721035800000), "Asia/Tokyo", session_zone=session_zone),
            tp.text_millis(F.lit("2024-07-15 09:30:00"), "UTC")).first()
        assert list(row) == [1720992600000, 1721035800000, 1721035800000,
                             "2024-07-15 18:30:00", 1721035800000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_display_pattern(spark):
    ms = F.lit(1705311000123).cast("bigint")
    row = spark.range(1).select(
        tp.display_time(ms, "UTC", "yy/MM/dd HH:mm:ss.SSS zzz"),
        tp.display_time(ms, "America/New_York", "yyyy-MM-dd HH:mm zzz"),
        tp.display_time(F.lit(1720000000000), "America/New_York", "HH zzz"),
        tp.display_time(ms, "UTC", "  ")).first()
    assert list(row) == ["24/01/15 09:30:00.123 UTC", "2024-01-15 04:30 EST", "05 EDT",
                         "2024-01-15 09:30:00"]


def test_detection():
    pick = tp.time_column
    assert pick(["a", "TS", "Time"]) == "Time"
    assert pick(["time", "@timestamp"]) == "@timestamp"
    assert pick(["event_date", "mytimestamp"]) == "mytimestamp"
    assert pick(["hits", "b"]) == "hits"
    assert pick(["a", "b"]) is None
    assert pick(["a", "timestamp"], chosen=" A ") == "a"
    assert pick(["a", "timestamp"], chosen="zz") == "timestamp"


NOW = datetime(2024, 1, 15, 9, 30, tzinfo=timezone.utc)


@pytest.mark.parametrize("value,back", [
    ("now", 0), ("15m", 900), ("2h ago", 7200), ("3 days", 259200), ("5 minutes ago", 300),
    ("1w", 604800), ("2mo", 5184000), ("1 year ago", 31536000), ("10 secs", 10)])
def test_relative(value, back):
    assert tp.bound_millis(value, now=NOW) == 1705311000000 - back * 1000


@pytest.mark.parametrize("value", ["soon", "3 fortnights", "-2h", ""])
def test_unreadable_bound(value):
    with pytest.raises(ValueError):
        tp.bound_millis(value, now=NOW)


def test_absolute_bound():
    assert tp.bound_millis("2024-01-15 09:30:00", "America/New_York") == 1705329000000
    assert tp.bound_millis(1705311000) == 1705311000000


def test_zone_names():
    assert tp.zone_id("utc") == tp.zone_id("") == tp.zone_id("Local") == tp.zone_id("No/Where") == "UTC"
    assert tp.zone_id(" Asia/Tokyo ") == "Asia/Tokyo"


@pytest.mark.parametrize("value,hit", [
    ("2024-01-15 09:30:00", ["a"]), ("2024-01-15", ["a", "b"]), ("2024-01-15T09", ["a", "b"]),
    ("2024-01-15 09:30", ["a", "b"]), ("2024-01-15 09:30:0*", ["a"]), ("2024-01*", ["a", "b", "c"]),
    ("2024-01-1*", ["a", "b"]), ("1705311000", ["a"]), ("nonsense", [])])
@pytest.mark.parametrize("zone", ["UTC", "Etc/GMT"])
def test_time_equality(make, value, hit, zone):
    from chronosift.functions.predicates import field_eq
    table = make(["timestamp", "name"], [
        ("2024-01-15T09:30:00Z", "a"), ("2024-01-15 09:30:59.999", "b"),
        ("2024-01-20 00:00:00", "c"), ("unknown", "d")], display_zone=zone)
    got = [r["name"] for r in table.filter(field_eq("timestamp", value)).result().collect()]
    assert got == hit


def test_profile_and_validation(make):
    from chronosift.operators.histogram import time_profile, validate_time_column
    table = make(["when", "x"], [("1705311000", "q"), ("2024-01-15", ""), ("?", ""), ("17", "")])
    got = {r.rung: r.n for r in time_profile(table, "when").collect()}
    assert got == {"epoch": 2, "zoneless": 1, None: 1}
    assert validate_time_column(table, " WHEN ")[0]
    assert not validate_time_column(table, "x")[0]
    assert not validate_time_column(table, "nope")[0]
