import re

import pytest
from pyspark.sql import functions as F

from chronosift.functions.predicates import field_eq
from chronosift.operators import annotations as A
from chronosift.operators import registry as R
from chronosift.sinks import store
from chronosift.sources.options import FileOptions, file_key

KEY = file_key("abc123", FileOptions())
SHAPE = re.compile(f"ann_{A.UUID_SHAPE}")


@pytest.fixture
def table(make):
    return make(["timestamp", "name"], [(f"2024-01-0{i}", n) for i, n in enumerate("abcdef", 1)], file_key=KEY)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], A.SCHEMA)


def names(t):
    return [r["name"] for r in t.result().collect()]


def notes(df):
    return {r.row_index: (r.note, r.color) for r in df.collect()}


def test_life_of_annotations(table, none):
    first = A.annotate(table.filter(field_eq("name", "b")), none, "look", "")
    assert notes(first) == {1: ("look", "grey")}
    assert all(SHAPE.fullmatch(r.annotation_id) for r in first.collect())
    more = A.annotate(table.sort(("name", True)), first, "late", "red", ranges=[(0, 2), (4, 5), (3, 3)])
    assert notes(more) == {1: ("late", "red"), 4: ("late", "red"), 5: ("late", "red")}
    kept = {r.row_index: r for r in more.collect()}
    assert kept[1].annotation_id == first.first().annotation_id and kept[1].version == 2
    assert len({r.annotation_id for r in kept.values()}) == 3
    assert names(A.annotated(table, more)) == ["b", "e", "f"]
    assert names(A.not_annotated(table, more)) == ["a", "c", "d"]
    assert names(A.not_annotated(table, none)) == list("abcdef")
    less = A.unannotate(table.filter(field_eq("name", "b")), more)
    assert set(notes(less)) == {4, 5}
    with pytest.raises(LookupError):
        A.unannotate(table.filter(field_eq("name", "b")), less)
    gone = A.delete_by_id(less, kept[4].annotation_id)
    assert set(notes(gone)) == {5}
    with pytest.raises(LookupError):
        A.delete_by_id(gone, "ann_none")


def test_other_readings_of_a_file_keep_their_own(table, make, none):
    other = make(["timestamp", "name"], [("2024-01-01", "x")], file_key=file_key("abc123", FileOptions(no_header_row=True)))
    both = A.annotate(other, A.annotate(table.limit(1), none, "n"), "m")
    assert both.count() == 2
    assert names(A.annotated(table, both)) == ["a"]
    assert A.delete_by_variant(both, "abc123", no_header_row=True).count() == 1
    assert A.delete_by_variant(both, "abc123", ingest_tz="UTC").count() == 2
    assert A.delete_by_file(both, "abc123").count() == 0
    assert {r.annotations for r in A.counts_per_file(both).collect()} == {1}


def test_enrichment_and_positions(table, none):
    marks = A.annotate(table.filter(field_eq("name", "b*")), none, "n", "blue")
    rows = A.enrich(table.select("name"), marks).orderBy("row_index").collect()
    assert [(r.name, r.annotated, r.color, r.note) for r in rows][:2] == [("a", False, "", ""), ("b", True, "blue", "n")]
    page = A.lookup_page(table.sort(("name", True)), marks, 3, 5).orderBy("row_index").collect()
    assert [(r.row_index, r.note) for r in page] == [(1, "n"), (2, "")]
    where = lambda t: [(r.row_index, r.position) for r in A.with_positions(t, marks).collect()]
    assert where(table) == [(1, 1)]
    assert where(table.sort(("name", True))) == [(1, 4)]
    assert where(table.filter(field_eq("name", "a"))) == [(1, -1)]


def test_batches(table, none):
    made = A.batch_create(none, KEY, [3, 3, 0], "n", "", batch="b")
    assert len({r.annotation_id for r in made.collect()}) == 3
    assert A.latest_per_row(made).count() == 2
    some = made.limit(2).select("annotation_id", F.lit("").alias("note"), F.lit("red").alias("color"))
    unknown = table.df.sparkSession.createDataFrame([("ann_x", "n", "")], some.schema)
    changed, counts = A.batch_update(made, some.union(unknown))
    assert sorted(r.color for r in changed.collect()) == ["grey", "red", "red"]
    assert {r.note for r in changed.collect()} == {"n"}
    assert tuple(counts.first()) == (2, 1)
    assert A.batch_create(none, KEY, list(range(1000)), "n").count() == 1000
    with pytest.raises(ValueError):
        A.batch_create(none, KEY, [], "n")
    with pytest.raises(ValueError):
        A.batch_create(none, KEY, [-1], "n")
    with pytest.raises(ValueError):
        A.batch_update(made, some.limit(0))


def test_validation(spark):
    good = "ann_00000000-0000-4000-8000-000000000000"
    rows = spark.createDataFrame([
        (good, "n", "red", "ab12", 0), ("ann_1", "n", "red", "ab12", 0), (good, "n" * 513, "red", "ab12", 0),
        (good, "n", "r" * 17, "ab12", 0), (good, "n", "red", "?", 0), (good, "n", "red", "YWJj", -1),
        (good[4:], "n", "red", "YWI=", 5)], "annotation_id string, note string, color string, file_hash string, row_index bigint")
    got = [r.problems for r in A.validate(rows).collect()]
    assert [len(p) for p in got] == [0, 1, 1, 1, 1, 1, 0]
    valid, rejected = A.split_valid(rows)
    assert (valid.count(), rejected.count()) == (2, 5)


def test_file_tables(spark):
    files = spark.createDataFrame([("k1", "/b", "h1", "one"), ("k2", "", "h2", "two"), ("k3", "/a", "h3", "three")],
                                  "file_key string, file_path string, file_hash string, description string")
    notes_ = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 5)], "file_key string, row_index bigint")
    listed = [(r.file_key, r.annotations) for r in R.list_files(files, notes_).collect()]
    assert listed == [("k3", 0), ("k1", 2), ("k2", 1)]
    changed = R.register(files, files.limit(1).withColumn("description", F.lit("new")))
    assert changed.count() == 3 and changed.filter("description = 'new'").count() == 1
    assert R.describe(files, "k2", "x").filter("description = 'x'").count() == 1
    left, kept = R.remove(files, notes_, files.filter("file_key = 'k1'"))
    assert (left.count(), kept.count()) == (2, 1)
    found = spark.createDataFrame([("h2", "/z"), ("h2", "/y"), ("h9", "/q")], "file_hash string, path string")
    assert [(r.file_key, r.located_path) for r in R.locate(files, found).collect()] == [("k2", "/y")]
    merged = R.reconcile_files(files.withColumn("description", F.lit("d")), files.filter("file_key = 'k1'"))
    assert {r.file_key: r.file_path for r in merged.collect()} == {"k1": "/b", "k2": "", "k3": ""}


def test_audit(spark):
    rows = spark.createDataFrame([(f"a{i}", "w" if i else "v", "e", "d") for i in range(5)],
                                 "audit_id string, workspace_id string, email string, description string")
    at = F.timestamp_seconds(F.lit(1000000))
    log = R.audit_entries(rows, at)
    assert log.first().ttl == 1000000 + 90 * 86400
    day = lambda n: F.timestamp_seconds(F.lit(1000000 + n * 86400))
    assert [r.audit_id for r in R.latest_audit(log, "w", 2, day(1)).collect()] == ["a1", "a2"]
    assert R.latest_audit(log, "w", 0, day(91)).count() == 0


def test_store(spark, tmp_path, table, none):
    path = str(tmp_path / "notes")
    assert store.load(spark, path, A.SCHEMA).count() == 0
    assert store.save(A.annotate(table, none, "n"), path) == 1
    assert store.save(store.load(spark, path, A.SCHEMA).filter("row_index > 2"), path) == 2
    assert store.load(spark, path, A.SCHEMA).count() == 3
    assert store.load(spark, path, A.SCHEMA, version=1).count() == 6
    assert A.list_annotations(store.load(spark, path, A.SCHEMA), color="grey").count() == 3
    (tmp_path / "notes" / "table_version=3").mkdir()        # a save that is not done
    (tmp_path / "notes" / "_claims" / "4").touch()          # and one that has only begun
    assert store.versions(spark, path) == [1, 2] and store.load(spark, path, A.SCHEMA).count() == 3
    assert store.save(store.load(spark, path, A.SCHEMA), path) == 5 and store.versions(spark, path) == [1, 2, 5]
    with pytest.raises(LookupError):
        store.load(spark, path, A.SCHEMA, version=3)


def test_options_key():
    assert FileOptions().key() == "::false::default::default::file"
    assert FileOptions("$.a", True, "UTC", "p", True, "*.csv", True).key() == "$.a::true::UTC::p::dir:*.csv:src"
