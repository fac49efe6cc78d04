"""Rows of text files read in splits, against Python's own readers."""

import csv
import io
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from chronosift import open_events
from chronosift.sources import csvfiles
from chronosift.sources.options import FileOptions


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def cut(size):
        for name in names:
            spark.conf.set(name, str(size))
    yield cut
    for name in names:
        spark.conf.unset(name)


def content(seed, rows):
    """Cells with line breaks, quotes, commas, blank lines; some cells longer than several splits."""
    rng = random.Random(seed)
    pieces = ["a", "b c", "", 'say "x"', "1,2", "two\\nlines", "\\n\\n", '"', "é日", "long " * 30, ',"\\n",', 'end"', "\\n" * 12]
    pieces = [p.replace("\\\\n", "\\n").replace("\\n", "\n") for p in pieces]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "x", "y"])
    for i in range(rows):
        writer.writerow([i, rng.choice(pieces), "".join(rng.choice(pieces) for _ in range(3))])
        if rng.random() < 0.1:
            out.write("\n")
    return out.getvalue()


def wanted(text):
    return [tuple(r) for r in csv.reader(io.StringIO(text)) if r][1:]


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_records_over_splits(spark, tmp_path, small_splits, size):
    small_splits(size)
    texts = {f"f{i}.csv": content(i, 25 if size < 20 else 60) for i in range(2)}
    texts["plain.csv"] = "id,x,y\n" + "".join(f"{i},x{i},y\n" for i in range(40))
    os.makedirs(f"{tmp_path}/d")
    for name, text in texts.items():
        with open(f"{tmp_path}/d/{name}", "w", newline="") as file:
            file.write(text)
    table = open_events(spark, f"{tmp_path}/d", FileOptions(is_directory=True, file_pattern="*.csv", include_source=True))
    got = table.df.orderBy("_row_index").collect()
    assert [r["_row_index"] for r in got] == list(range(len(got)))
    want = [(name, *row) for name in sorted(texts) for row in wanted(texts[name])]
    assert [(r["__source_file__"], r["id"], r["x"] or "", r["y"] or "") for r in got] == want
    assert table.total() == len(want)


def test_unclosed_and_bare_quotes(spark, tmp_path, small_splits):
    small_splits(9)
    path = f"{tmp_path}/x.csv"
    with open(path, "w", newline="") as file:
        file.write('a,b\r\n5" pipe,1\r\n"x"y,2\r\n3,"open\r\nto the end\r\n')
    got = open_events(spark, path).df.orderBy("_row_index").collect()
    assert [r["a"] for r in got] == ['5" pipe', '"x"y', "3"]
    assert [r["b"] for r in got[:2]] == ["1", "2"] and "to the end" in got[2]["b"]


def test_state_after_a_line():
    assert [csvfiles.after(line, False) for line in
            ("a,b", '"a",b', '"a', 'a"', 'a,"b', '"a""', '"a"""', '"a","', '"",', '"a"b', '"a"b,"c')] == [
                False, False, True, False, True, True, False, True, False, False, True]
    assert [csvfiles.after(line, True) for line in ("", "a", 'a"', 'a",', 'a","', 'a""', 'a"b', '"')] == [
        True, True, False, False, True, True, False, False]


def test_opening_writes_nothing(spark, tmp_path, small_splits):
    """Neither does looking at rows; a query without positions doesn't count lines."""
    small_splits(500)
    folder = spark.conf.get("spark.checkpoint.dir")
    os.makedirs(f"{tmp_path}/d")
    for i in range(3):
        with open(f"{tmp_path}/d/{i}.csv", "w") as file:
            file.write("id,x\n" + "".join(f"{i}{j},v\n" for j in range(200)))
        with open(f"{tmp_path}/d/{i}.syslog", "w") as file:
            file.write("".join(f"Jan 15 10:30:0{j % 10} host app: message {j}\n" for j in range(200)))
    before = set(os.listdir(folder))
    for pattern, n in (("*.csv", 600), ("*.syslog", 600)):
        table = open_events(spark, f"{tmp_path}/d", FileOptions(is_directory=True, file_pattern=pattern))
        assert [r[0] for r in table.df.select("_row_index").orderBy("_row_index").collect()] == list(range(n))
        first = table.columns[0]
        plan = table.df.select(first).filter(F.col(f"`{first}`") != "")._jdf.queryExecution().optimizedPlan().toString()
        assert "_shift" not in plan
    assert set(os.listdir(folder)) == before


def values(seed, n):
    rng = random.Random(seed)
    strings = ["a", "x}y", "[{", 'q"uote\\', "é日", ",", "long " * 40, ""]
    return [{"id": i, "s": rng.choice(strings), "list": [rng.choice(strings), {"k": i}], "deep": {"a": {"b": [1, [2]]}}} for i in range(n)]


@pytest.mark.parametrize("size", [30, 300, 1 << 20])
def test_json_values_over_splits(spark, tmp_path, small_splits, size):
    small_splits(size)
    found = values(1, 10 if size < 100 else 40)
    rng = random.Random(size)
    texts = [json.dumps(v, indent=rng.choice([None, 2]), ensure_ascii=False) for v in found]
    forms = {"one.json": (rng.choice([" ", "\n", "\n\n", ""]).join(texts), ""), "lines.json": ("\n".join(json.dumps(v) for v in found), ""),
             "root.json": ("[" + ",\n".join(texts) + "]", "$"), "many.json": (" ".join(texts), "$"),
             "pretty.json": (json.dumps(found, indent=1), "$")}
    for name, (text, path) in forms.items():
        with open(f"{tmp_path}/{name}", "w", newline="") as file:
            file.write(text)
        table = open_events(spark, f"{tmp_path}/{name}", FileOptions(jpath=path))
        got = [(r["id"], r["s"], json.loads(r["list"]), json.loads(r["deep"]), r["_row_index"])
               for r in table.df.orderBy("_row_index").collect()]
        assert got == [(str(v["id"]), v["s"], v["list"], v["deep"], i) for i, v in enumerate(found)], name


def test_json_that_is_none(spark, tmp_path, small_splits):
    """Lines stand alone where brackets don't match; strays between values are rows of their own."""
    small_splits(16)
    for name, text, want in (
            ("a.json", '{"a": 1}\n{"a": 2\n\n{"a": 3}\nno json\n', [("1", ""), ("", '{"a": 2'), ("3", ""), ("", "no json")]),
            ("b.json", '{"a": 1} stray {"a":\n 2}\n 5 \n[1]', [("1", ""), ("", "stray"), ("2", ""), ("", "5"), ("", "[1]")])):
        with open(f"{tmp_path}/{name}", "w") as file:
            file.write(text)
        got = open_events(spark, f"{tmp_path}/{name}").df.orderBy("_row_index").collect()
        assert [(r["a"], r["_rejected"]) for r in got] == want
    with open(f"{tmp_path}/c.json", "w") as file:
        file.write('[["h", "i"],\n ["1", "2"], 7, {"x": 1},\n["3"]]')
    got = open_events(spark, f"{tmp_path}/c.json", FileOptions(jpath="$")).df.orderBy("_row_index").collect()
    assert [(r["h"], r["i"]) for r in got] == [("1", "2"), ("3", None)]      # others are no records of such a file


def test_small_cuts_do_not_grow_in_number(spark, tmp_path, monkeypatch):
    from chronosift.sources import splits
    monkeypatch.setattr(splits, "MOST_SPLITS", 32)
    spark.range(60_000).select(F.col("id").cast("string")).coalesce(1).write.text(f"{tmp_path}/d")
    few, many = (splits.cut_layout(spark, f"{tmp_path}/d", least).read.text(f"{tmp_path}/d") for least in (100_000, 100))
    assert few.rdd.getNumPartitions() == 4 and 32 <= many.rdd.getNumPartitions() <= 34
    assert many.count() == 60_000


def test_task_results_do_not_grow_with_a_file_that_is_cut_small(spark, tmp_path, monkeypatch):
    """Each task sends its result to the driver, so passes over a larger file have as many tasks."""
    from chronosift.plans.source_catalog import source_csv_splits
    from chronosift.sources import splits
    monkeypatch.setattr(splits, "MOST_SPLITS", 16)
    tracker, tasks = spark.sparkContext.statusTracker(), {}
    for n in (1_500, 6_000):
        sf = f"{tmp_path}/{n}"
        spark.range(n).select(
            F.floor(F.col("id") / 2).alias("conv_id"), (F.col("id") % 2).alias("turn"), F.lit("user").alias("role"),
            F.concat(F.lit('a "word"\n'), F.repeat(F.lit("x, "), 60), "id").alias("text")).write.parquet(f"{sf}/conversations.parquet")
        spark.sparkContext.setJobGroup(f"splits {n}", "")
        try:
            got = source_csv_splits(spark, sf).agg(
                F.count(F.lit(1)), F.count_if((F.col("row_index") == 2 * F.col("conv_id").cast("long") + F.col("turn").cast("long"))
                                              & F.col("text").endswith(F.concat(F.lit("x, "), F.col("row_index"))))).first()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert tuple(got) == (n, n)
        stages = {s for job in tracker.getJobIdsForGroup(f"splits {n}") for s in tracker.getJobInfo(job).stageIds}
        tasks[n] = max(info.numTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert 16 <= tasks[1_500] <= 20 and tasks[6_000] <= 20


def test_one_task_reads_sorted_ranges_in_order(spark, tmp_path):
    from chronosift.sources.splits import in_order
    rows = in_order(spark.range(0, 20_000, 1, 8).orderBy(F.col("id").desc()))
    assert rows.rdd.getNumPartitions() == 1 and "Sort" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in rows.collect()] == list(range(19_999, -1, -1))
    assert in_order(spark.range(0).orderBy("id")).count() == 0


def test_items_of_one_file_do_not_meet_in_a_task(spark, tmp_path):
    from chronosift.sources import jsonfiles
    with open(f"{tmp_path}/a.txt", "w") as file:
        file.write('[{"a": 1},\n{"a": 2}]\n')
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = jsonfiles._root_items(spark, [f"{tmp_path}/a.txt"])
        plan = items._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"SortMergeJoin \[_file#\d+\]", plan)
    assert [r["_pos"] for r in items.orderBy("_pos").collect()] == [0, 1]
