import pytest
from pyspark.sql import functions as F

from chronosift.operators import ordinal
from chronosift.plans import event_table
from chronosift.plans.event_table import EventTable, SortKey

PEOPLE = [("Alice", "Engineering", "100000"), ("Bob", "Engineering", "90000"), ("Charlie", "Sales", "80000"),
          ("David", "Engineering", "95000"), ("Eve", "Sales", "95000")]


def col(table, name, **options):
    return [r[name] for r in table.result(**options).collect()]


def test_multi_key(make):
    table = make(["name", "department", "salary"], PEOPLE)
    assert col(table.sort("department", ("salary", True)), "name") == ["Alice", "David", "Bob", "Eve", "Charlie"]
    # Sorting twice: the earlier sort breaks ties.
    assert col(table.sort(SortKey("salary", True)).sort("DEPARTMENT"), "name") == [
        "Alice", "David", "Bob", "Eve", "Charlie"]
    assert col(table.sort("unknown"), "name") == [p[0] for p in PEOPLE]


def test_time_sort(make):
    table = make(["message", "timestamp"], [("log3", "2024-01-03 10:00:00"), ("none", "?"),
                                            ("log1", "2024-01-01 10:00:00"), ("log2", "1704189600")])
    assert col(table.sort("timestamp"), "message") == ["log1", "log2", "log3", "none"]
    assert col(table.sort(("timestamp", True)), "message") == ["log3", "log2", "log1", "none"]
    assert col(table, "message", sort_by_time=True) == ["log1", "log2", "log3", "none"]
    assert col(table.sort("message"), "message", sort_by_time=True) == ["log1", "log2", "log3", "none"]
    # The implicit sort comes after a limit.
    assert col(table.limit(3), "message", sort_by_time=True, descending=True) == ["log3", "log1", "none"]


MIXED = ["b", "10", "", "9", "A", " ", "-1.5", "1e2", "nan", None, "0x10", "9"]


def test_mixed_values(make):
    table = make(["v"], [(v,) for v in MIXED])
    up = ["-1.5", "9", "9", "10", "1e2", "0x10", "A", "b", "nan", "", " ", None]
    assert col(table.sort("v"), "v") == up
    assert col(table.sort(("v", True)), "v") == ["nan", "b", "A", "0x10", "1e2", "10", "9", "9", "-1.5", "", " ", None]


DOCS = [('{"count":30}', "row1"), ('{"count":10}', "row2"), ('{"count":20}', "row3"), ('{"count":5}', "row4")]


def test_json_sort(make):
    table = make(["data", "name"], DOCS)
    assert col(table.sort("data{$.count}"), "name") == ["row4", "row2", "row3", "row1"]
    assert col(table.sort(("data{$.count}", True)), "name") == ["row1", "row3", "row2", "row4"]
    bad = make(["data", "name"], [DOCS[0], ("not json", "row2"), ('{"count":10}', "row3"), ('{"missing":5}', "row4")])
    assert col(bad.sort("data{$.count}"), "name") == ["row3", "row1", "row2", "row4"]
    assert col(bad.sort(("data{$.count}", True)), "name") == ["row1", "row3", "row2", "row4"]


def test_dedup(make):
    table = make(["data", "name"], [('{"type":"admin"}', "user1"), ('{"type":"user"}', "user2"), (
        '{"type":"admin"}', "user3"), ('{"type":"guest"}', "user4"), ('{"type":"user"}', "user5")])
    assert col(table.dedup("data{$.type}"), "name") == ["user1", "user2", "user4"]
    assert col(table.sort(("name", True)).dedup("data{$.type}"), "name") == ["user5", "user4", "user3"]
    cells = make(["a", "b"], [("X ", "1"), ("x", "2"), (None, "3"), ("", "4"), ("y", "1")])
    assert col(cells.dedup("A"), "b") == ["1", "3", "1"]
    assert cells.dedup().total() == 5
    assert col(cells.select("b").dedup("nope"), "b") == ["1", "2", "3", "4"]


def test_dedup_after_columns(make):
    rows = [(f"2024-01-0{i}", "AssumeRole", f'{{"roleSessionName":"session-{s}"}}')
            for i, s in enumerate("abacb", 1)]
    table = make(["eventTime", "eventName", "requestParameters"], rows)
    kept = table.select("requestParameters").dedup("requestParameters{$.roleSessionName}")
    assert kept.display == ("requestParameters",)
    assert [r["eventTime"] for r in kept.df.orderBy("_row_index").collect()] == [
        "2024-01-01", "2024-01-02", "2024-01-04"]


@pytest.fixture(params=[1_000_000, 0])
def slicing(request, monkeypatch):
    """Both ways to cut rows out of an order: top-k in one task, and by positions."""
    monkeypatch.setattr(event_table, "SINGLE_TASK_ROWS", request.param)


def test_limit_and_pages(make, slicing):
    table = make(["n"], [(str(i * 7 % 50),) for i in range(50)]).sort("n")
    assert col(table.limit(3), "n") == ["0", "1", "2"]
    assert col(table.page(10, 13), "n") == ["10", "11", "12"]
    assert col(table.page(48, 99), "n") == ["48", "49"]
    assert table.limit(0).total() == table.limit(-1).total() == 50
    assert table.page(5, 5).total() == 0
    assert col(table.limit(10).sort(("n", True)).limit(2), "n") == ["9", "8"]


def test_positions_of_a_hot_value(spark):
    """A third of all rows share one value and still spread over partitions."""
    df = spark.range(30_000).select(
        F.col("id").alias("rowno"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") * 7919 % 1000).alias("v"))
    table = EventTable.of(df, row_index="rowno").sort("v")
    got = {r.row_index: r.position for r in table.positions().collect()}
    want = {i: n for n, (v, i) in enumerate(sorted((r.v, r.rowno) for r in df.collect()))}
    assert got == want
    spread = ordinal.with_position(df, [F.col("v"), F.col("rowno")], "p", 8)
    assert spread.agg(F.max("p")).first()[0] == 29_999


def test_position_of(make):
    table = make(["v"], [(v,) for v in MIXED])
    for keys in ([], ["v"], [("v", True)]):
        ordered = table.sort(*keys) if keys else table
        place = {r.row_index: r.position for r in ordered.positions().collect()}
        assert place == {i: ordered.position_of(i) for i in range(len(MIXED))}
    assert table.position_of(99) is None


def test_columns_and_strip(make):
    table = make(["a", "B", "c", "d"], [("1", "", " ", "x"), ("2", None, "\t", "")])
    assert table.select("b", "zz", "A", "b").display == ("B", "a")
    assert table.select("a", "B").select("c", "B").display == ("B",)
    assert table.select("zz").display == table.display
    assert table.strip().display == ("a", "d")
    assert table.select("B", "c").strip().display == ()
    from chronosift.functions.predicates import field_eq
    assert table.filter(field_eq("a", "9")).strip().display == table.display
    assert table.filter(field_eq("a", "2")).strip().display == ("a",)
    timed = make(["a", "timestamp"], [("1", "2024-01-01")])
    assert timed.time_first().display == ("timestamp", "a")
