import pytest

from chronosift.functions import predicates as P
from chronosift.functions.text import split_column_path

term, phrase, eq, ne, has, lacks = (
    P.term, P.phrase, P.field_eq, P.field_ne, P.field_contains, P.field_not_contains)
both, either, no = P.all_of, P.any_of, P.negate


def passes(make, header, row, test):
    return make(header, [row]).filter(test).total() == 1


TWO = ["username", "action"]
THREE = ["username", "action", "status"]
NESTED = either(both(no(term("scrappy")), either(term("bob"), term("admin"))), term("error"))


@pytest.mark.parametrize("test,row,expected", [
    (no(term("scrappy")), ("bob", "login"), True),
    (no(term("scrappy")), ("scrappy", "login"), False),
    (either(term("scrappy"), term("bob")), ("scrappy", "login"), True),
    (either(term("scrappy"), term("bob")), ("bob", "login"), True),
    (either(term("scrappy"), term("bob")), ("alice", "login"), False),
    (both(term("scrappy"), term("login")), ("scrappy", "login"), True),
    (both(term("scrappy"), term("login")), ("scrappy", "logout"), False),
    (both(either(term("scrappy"), term("bob")), term("login")), ("bob", "login"), True),
    (both(either(term("scrappy"), term("bob")), term("login")), ("scrappy", "logout"), False),
    (either(term("scrappy"), no(term("bob"))), ("alice", "login"), True),
    (either(term("scrappy"), no(term("bob"))), ("bob", "login"), False),
    (either(eq("username", "scrappy"), eq("username", "bob")), ("bob", "login"), True),
    (either(eq("username", "scrappy"), eq("username", "bob")), ("alice", "login"), False),
    (eq("USERNAME", " Bob".strip()), (" bob ", "x"), True),
    (term("err*"), ("x", "Error 5"), True), (term("err*"), ("x", "an error"), False),
    (term("*"), ("", "x"), True), (term("*"), (" ", None), False),
    (phrase('"a=b"'), ("A=B!", ""), True), (term("ab"), ("a", "b"), False),
    (ne("username", "bob"), (None, "x"), True), (ne("nope", "x"), ("a", "b"), True),
    (ne("username", "bo*"), ("bobby", "x"), False), (eq("username", "*"), ("  ", "x"), False),
    (eq("username", "*"), ("x", "x"), True), (eq("nope", "x"), ("x", "x"), False)])
def test_boolean(make, test, row, expected):
    assert passes(make, TWO, row, test) == expected


@pytest.mark.parametrize("row,expected", [
    (("scrappy", "login", "error"), True), (("bob", "login", "success"), True),
    (("admin", "login", "success"), True), (("scrappy", "login", "success"), False)])
def test_deep_nesting(make, row, expected):
    assert passes(make, THREE, row, NESTED) == expected


@pytest.mark.parametrize("test,expected", [
    (has("username", "scrap"), True), (has("username", "admin"), False), (has("username", "SCRAP"), True),
    (has("action", "log"), True), (has("status", "success"), True), (lacks("username", "admin"), True),
    (lacks("username", "scrap"), False), (lacks("username", "ADMIN"), True), (has("nonexistent", "value"), False),
    (lacks("nonexistent", "value"), True),
    (both(has("username", "scrap"), eq("status", "success")), True),
    (both(has("username", "scrap"), eq("status", "error")), False),
    (either(has("username", "admin"), eq("status", "success")), True),
    (either(has("username", "scrap"), has("action", "out")), True),
    (both(lacks("username", "admin"), eq("status", "success")), True),
    (both(either(has("username", "admin"), has("username", "bob")), eq("status", "success")), False)])
def test_contains(make, test, expected):
    assert passes(make, THREE, ("scrappy", "login", "success"), test) == expected


@pytest.mark.parametrize("name,row,expected", [
    ("user name", ("scrappy", "login"), True), ("user name", ("xray123", "login"), True),
    ("user name", ("alice", "login"), False), ("a.b`c (d)", ("scrappy", "x"), True)])
def test_odd_names(make, name, row, expected):
    test = either(eq(name, "scrappy"), eq(name.upper(), "xray*"))
    from chronosift.plans.event_table import EventTable
    table = make(["x", "action"], [row])
    df = table.df.withColumnRenamed("x", name).drop(table.EVENT_MS)
    assert (EventTable.of(df).filter(test).total() == 1) == expected


JSON = '{"durationSeconds":3600,"roleArn":"arn:aws:iam::123:role/Admin","user":{"name":"admin"},"n":null}'


@pytest.mark.parametrize("test,cell,expected", [
    (eq("rp{$.durationSeconds}", "3600"), JSON, True), (eq("RP{$.durationSeconds}", "7200"), JSON, False),
    (eq("rp{$.user.name}", "ADMIN"), JSON, True), (eq("rp{$.roleArn}", "arn:aws:IAM*"), JSON, True),
    (eq("rp{$.key}", "v"), "not json", False), (eq("rp{$.missing}", "v"), JSON, False),
    (ne("rp{$.durationSeconds}", "7200"), JSON, True), (ne("rp{$.durationSeconds}", "3600"), JSON, False),
    (ne("rp{$.key}", "v"), "not json", True), (has("rp{$.roleArn}", "ADMIN"), JSON, True),
    (has("rp{$.roleArn}", "superuser"), JSON, False), (lacks("rp{$.roleArn}", "superuser"), JSON, True),
    (lacks("rp{$.roleArn}", "admin"), JSON, False), (lacks("rp{$.key}", "v"), "not json", True),
    (eq("rp{$.n}", ""), JSON, True), (eq("rp{$.n}", "*"), JSON, False), (eq("rp{$.user}", "*"), JSON, True),
    (no(eq("rp{$.durationSeconds}", "7200")), JSON, True),
    (both(eq("rp{$.durationSeconds}", "3600"), eq("action", "x")), JSON, True)])
def test_json_fields(make, test, cell, expected):
    assert passes(make, ["rp", "action"], (cell, "x"), test) == expected


@pytest.mark.parametrize("spec,expected", [
    ("username", ("username", None)), ("data{$.user.name}", ("data", "$.user.name")),
    ("items{$[0].id}", ("items", "$[0].id")), ("field{}", ("field{}", None)),
    ("field{$.key", ("field{$.key", None)), ("field$.key}", ("field$.key}", None)),
    ("  data  {$.key}", ("data", "$.key")), ("c{$['a}b']}", ("c", "$['a}b']"))])
def test_column_path(spec, expected):
    assert split_column_path(spec) == expected


def test_time_bounds(make):
    rows = [("2024-01-01", "a"), ("2024-01-02", "b"), ("2024-01-03 00:00:00.001", "c"), ("?", "d")]
    table = make(["timestamp", "x"], rows)
    names = lambda t: [r["x"] for r in t.result().collect()]
    assert names(table.after("2024-01-02")) == ["b", "c"]
    assert names(table.before("2024-01-03")) == ["a", "b"]
    assert names(table.filter(term("a"), after="2023-01-01")) == ["a"]
    assert names(table.after("2024-01-02").time_range(table, 0, 1704067200000)) == ["a"]
    no_time = make(["x"], [("a",), ("b",)])
    assert no_time.after("2024-01-02").total() == 2


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Pacific/Auckland"])
def test_typed_bounds_are_exact(spark, zone):
    from chronosift.plans.event_table import EventTable
    df = spark.sql("""select id as rowno, make_timestamp_ntz(2024, 3, 9, 12, 0, 0) + make_dt_interval(0, id) as ts
                      from range(0, 60)""")
    table = EventTable.of(df, row_index="rowno", ingest_zone=zone)
    every = {r["_row_index"]: r["_event_ms"] for r in table.df.collect()}
    low, high = sorted(every.values())[10], sorted(every.values())[40]
    got = {r["_row_index"] for r in table.filter(after=low, before=high).df.collect()}
    assert got == {i for i, ms in every.items() if low <= ms <= high}
