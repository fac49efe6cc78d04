import bz2
import gzip
import json
import lzma
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from chronosift.functions.predicates import starts, term
from chronosift.sources import csvfiles, heads, jsonfiles, syslog, weblogs
from chronosift.sources.directory import glob_regex, listing, preview
from chronosift.sources.headers import normal_names, unnamed
from chronosift.sources.open import load_events, open_events, save_events
from chronosift.sources.options import FileOptions
from chronosift.sources.registry import standard_sources


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode() if isinstance(text, str) else text)
    return str(path)


def rows(table):
    return [tuple(r) for r in table.result().collect()]


def test_names():
    assert normal_names(["name", "", "age", "  ", None]) == ["name", "Unnamed_A", "age", "Unnamed_B", "Unnamed_C"]
    assert unnamed(28)[25:] == ["Unnamed_Z", "Unnamed_AA", "Unnamed_AB"]
    assert normal_names(["a", "A", "a", "a_2"]) == ["a", "A_2", "a_3", "a_2_2"]


@pytest.mark.parametrize("multiline", [None, True])
def test_csv(spark, tmp_path, multiline):
    path = write(f"{tmp_path}/x.csv", 'timestamp,,"na,me"\n2024-01-15,1,"say ""hi"""\n\n2024-01-16,2\n3,"two\nlines",c,surplus\n')
    table = open_events(spark, path, multiline=multiline)
    assert table.columns == ("timestamp", "Unnamed_A", "na,me")
    assert rows(table) == [("2024-01-15", "1", 'say "hi"'), ("2024-01-16", "2", None), ("3", "two\nlines", "c")]
    assert [r._event_ms for r in table.df.orderBy("_row_index").collect()] == [1705276800000, 1705363200000, 3000]
    assert table.total() == 3
    bare = open_events(spark, path, FileOptions(no_header_row=True), multiline=multiline)
    assert bare.columns == ("Unnamed_A", "Unnamed_B", "Unnamed_C") and bare.total() == 4


def test_line_breaks_in_some_files(spark, tmp_path):
    for i in range(4):
        write(f"{tmp_path}/d/f {i}.csv", "a,b\n" + ('1,"x\ny"\n' if i == 2 else f"{i},z\n") * 3)
    table = open_events(spark, f"{tmp_path}/d", FileOptions(is_directory=True, file_pattern="*.csv"))
    got = [(r._row_index, r.a, r.b) for r in table.df.orderBy("_row_index").collect()]
    want = [(str(i) if i != 2 else "1", "x\ny" if i == 2 else "z") for i in range(4) for _ in range(3)]
    assert got == [(i, *w) for i, w in enumerate(want)]
    write(f"{tmp_path}/d/g+%.csv", "a\n1\n")
    named = open_events(spark, f"{tmp_path}/d", FileOptions(is_directory=True, file_pattern="*.csv", include_source=True))
    assert {r[0] for r in named.df.select("__source_file__").distinct().collect()} == {f"f {i}.csv" for i in range(4)} | {"g+%.csv"}


def test_surplus_cells(spark, tmp_path):
    path = write(f"{tmp_path}/x.csv", 'a,b\n1,2,,"x, ""y""",z\n3\n4,"p\nq",5\n6,7,\n')
    table = open_events(spark, path)
    assert table.columns == ("a", "b") and table.total() == 4
    more = {r.a: r["__surplus__"] for r in table.df.collect()}
    assert more == {"1": ["", 'x, "y"', "z"], "3": None, "4": ["5"], "6": [""]}
    hits = lambda *tests: [r[0] for r in rows(table.filter(*tests))]
    assert hits(term('x, "Y')) == ["1"] and hits(starts("z")) == ["1"] and hits(term("5")) == ["4"]
    assert hits(term("q,5")) == []
    write(f"{tmp_path}/d/a.csv", "a,b\n1,2,found\n")
    with gzip.open(f"{tmp_path}/d/b.csv", "wb") as f:
        f.write(b"b,c\n1,2,found\n3\n")
    both = open_events(spark, f"{tmp_path}/d", FileOptions(is_directory=True, file_pattern="*"))
    assert both.columns == ("a", "b", "c")
    assert rows(both.filter(term("found"))) == [("1", "2", None), (None, "1", "2")]


def test_heads_of_small_and_large_files(spark, tmp_path, monkeypatch):
    paths = [write(f"{tmp_path}/{n}.csv", text) for n, text in (
        ("a", '\n\n"x\ny",z\n1,2\n'), ("b", ""), ("c", "one\n" + "1\n" * 50), ("d", "\n\n"))]
    for size in (1 << 20, 10):
        monkeypatch.setattr(heads, "SMALL_FILE", size)
        found = heads.first_records(spark, paths)
        assert [found[p].record for p in paths] == [["x\ny", "z"], None, ["one"], None]
        assert not any(h.streamed for h in found.values())
    with pytest.raises(Exception, match="(?i)not_found|not exist"):
        heads.first_records(spark, [f"{tmp_path}/none.csv"])


def test_head_of_a_file_cut_into_splits(spark, tmp_path, monkeypatch):
    """A session may hold the size of splits at its own value."""
    paths = [write(f"{tmp_path}/{n}.csv", f'id,"{n}\nx"\n' + "1,a.b\n" * 500) for n in "ab"]
    for settings in ("LARGE_FILES", "SMALL_FILES"):
        cut = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
        monkeypatch.setattr(heads, settings, {**getattr(heads, settings), **cut})
    assert heads.first_records(spark, paths[:1])[paths[0]].record == ["id", "a\nx"]
    assert [heads.first_records(spark, paths)[p].record for p in paths] == [["id", "a\nx"], ["id", "b\nx"]]
    monkeypatch.setattr(heads, "SMALL_FILE", 10)
    assert [heads.first_records(spark, paths)[p].record for p in paths] == [["id", "a\nx"], ["id", "b\nx"]]


def test_row_index_over_many_splits(spark, tmp_path):
    path = write(f"{tmp_path}/big.csv", "n,pad\n" + "".join(f"{i},{'x' * 40}\n" for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        table = open_events(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        assert table.df.filter("_row_index != cast(n as bigint)").count() == 0
        assert table.total() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("suffix,pack", [(".gz", gzip.compress), (".bz2", bz2.compress), (".xz", lzma.compress), (
    "", gzip.compress), ("", lzma.compress)])
def test_compressed(spark, tmp_path, suffix, pack):
    body = "a,b\n" + "".join(f"{i},\"v\n{i}\"\n" for i in range(100))
    path = write(f"{tmp_path}/x.csv{suffix}", pack(body.encode()))
    table = open_events(spark, path)
    assert table.columns == ("a", "b")
    assert rows(table) == [(str(i), f"v\n{i}") for i in range(100)]


@pytest.mark.parametrize("suffix,pack", [(".gz", gzip.compress), (".xz", lzma.compress)])
def test_broken_tail(spark, tmp_path, suffix, pack):
    """An error, unless Spark is told to keep the readable part."""
    import random
    rng = random.Random(1)
    body = "a,b\n" + "".join(f"{i},{rng.random()}\n" for i in range(200000))
    whole = pack(body.encode())
    path = write(f"{tmp_path}/x.csv{suffix}", whole[:len(whole) // 2])
    with pytest.raises(Exception):
        open_events(spark, path).total()
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        got = open_events(spark, path)
        assert 1000 < got.total() < 200000
        assert got.df.filter("_row_index <> cast(a as bigint) and b is not null").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")


def test_directories_of_logs_and_mixed_kinds(spark, tmp_path):
    write(f"{tmp_path}/d/a.log", W3C)
    write(f"{tmp_path}/d/b.log.gz", gzip.compress(NCSA.encode()))
    logs = open_events(spark, f"{tmp_path}/d", FileOptions(is_directory=True, file_pattern="*.log*", include_source=True))
    assert logs.total() == 6
    assert [r._row_index for r in open_events(spark, f"{tmp_path}/d/a.log").df.collect()] == [0, 1, 2]
    assert {r["__source_file__"]: r["count"] for r in logs.df.groupBy("__source_file__").count().collect()} == {
        "a.log": 3, "b.log.gz": 3}
    assert sorted(r._row_index for r in logs.df.collect()) == list(range(6))
    assert open_events(spark, f"{tmp_path}/d/b.log.gz").total() == 3
    write(f"{tmp_path}/d/c.csv", "a,b\n1,2\n")
    write(f"{tmp_path}/d/e.json", '{"a": 5}\n{"b": 6}\n')
    spark.range(2).withColumn("a", F.lit("p")).coalesce(1).write.parquet(f"{tmp_path}/d/p.parquet")
    mixed = open_events(spark, f"{tmp_path}/d", FileOptions(is_directory=True, file_pattern="**/*.{csv,json,parquet}"))
    assert sorted((r.a or "", r.b or "", r.id or "") for r in mixed.df.collect()) == [
        ("", "6", ""), ("1", "2", ""), ("5", "", ""), ("p", "", "0"), ("p", "", "1")]
    assert sorted(r._row_index for r in mixed.df.collect()) == list(range(5))


def test_more_than_five_hundred_files(spark, tmp_path):
    for i in range(520):
        write(f"{tmp_path}/d/{i:04}.csv", f"a\n{i}\n")
    table = open_events(spark, f"{tmp_path}/d", FileOptions(is_directory=True, file_pattern="*.csv"))
    assert table.total() == 520


def test_json_rejects(spark, tmp_path):
    write(f"{tmp_path}/d/a.json", '[{"a": 1}]')
    write(f"{tmp_path}/d/b.json", '[{"a": 2')
    table = open_events(spark, f"{tmp_path}/d", FileOptions(is_directory=True, file_pattern="*.json", jpath="$"))
    assert sorted(rows(table)) == [("", '[{"a": 2'), ("1", "")] and table.columns == ("a", "_rejected")


def test_directory(spark, tmp_path):
    write(f"{tmp_path}/d/a.csv", "x,y\n1,2\n3,4\n")
    write(f"{tmp_path}/d/sub/b.csv", "y,z\n5,6\n")
    write(f"{tmp_path}/d/sub/c.csv.xz", lzma.compress(b"z,w\n7,8\n"))
    write(f"{tmp_path}/d/skip.csv", "q\n1\n")
    write(f"{tmp_path}/d/e.txt", "no")
    options = FileOptions(is_directory=True, file_pattern="**/*.csv*", include_source=True)
    table = open_events(spark, f"{tmp_path}/d", options, exclude=("skip*",))
    assert table.columns == ("x", "y", "z", "w", "__source_file__")
    assert rows(table) == [("1", "2", None, None, "a.csv"), ("3", "4", None, None, "a.csv"),
                           (None, "5", "6", None, "sub/b.csv"), (None, None, "7", "8", "sub/c.csv.xz")]
    top = FileOptions(is_directory=True, file_pattern="*.csv")
    assert open_events(spark, f"{tmp_path}/d", top).columns == ("x", "y", "q")
    assert open_events(spark, f"{tmp_path}/d", top, max_files=1).total() == 2
    files, header, n, size = preview(spark, f"{tmp_path}/d", "**/*.csv")
    assert [r[0] for r in files.collect()] == ["a.csv", "skip.csv", "sub/b.csv"]
    assert (header, n, size) == (["x", "y", "q", "z"], 3, 24)
    with pytest.raises(ValueError):
        open_events(spark, f"{tmp_path}/d", FileOptions(is_directory=True, file_pattern="*.none"))


def test_headerless_directory(spark, tmp_path):
    write(f"{tmp_path}/h/1.csv", "a,b,c\n")
    write(f"{tmp_path}/h/2.csv", "d,e,f\n")
    table = open_events(spark, f"{tmp_path}/h", FileOptions(is_directory=True, file_pattern="*.csv", no_header_row=True))
    assert table.columns == ("Unnamed_A", "Unnamed_B", "Unnamed_C")
    assert rows(table) == [("a", "b", "c"), ("d", "e", "f")]


@pytest.mark.parametrize("pattern,path,hit", [
    ("*.csv", "a.csv", True), ("*.csv", "s/a.csv", False), ("**/*.csv", "a.csv", True), ("**/*.csv", "s/t/a.csv", True),
    ("s/**", "s/t/a", True), ("?.{csv,log}", "a.log", True), ("[!a].x", "a.x", False), ("a.b", "aXb", False)])
def test_globs(pattern, path, hit):
    import re
    assert bool(re.match(glob_regex(pattern), path)) == hit


OBJECTS = [{"b": 1, "a": "x"}, 5, {"c": {"k": [1, 2]}, "a": None}, {"b": 1.5, "": True}]


def test_json_objects(spark, tmp_path):
    path = write(f"{tmp_path}/o.json", json.dumps({"data": {"items": OBJECTS}}))
    table = open_events(spark, path, FileOptions(jpath="$.data.items"))
    assert table.columns == ("Unnamed_A", "a", "b", "c")
    assert rows(table) == [("", "x", "1", ""), ("", "", "", '{"k":[1,2]}'), ("true", "", "1.5", "")]
    assert [r[0] for r in jsonfiles.preview(spark, path, "$.data").collect()] == ["items"]
    assert jsonfiles.preview(spark, path, "$.data.items", 1).count() == 1


def test_json_arrays(spark, tmp_path):
    path = write(f"{tmp_path}/a.json", json.dumps([["ts", "", "v"], ["2024-01-15", None, [1]], ["x", 2]]))
    table = open_events(spark, path, FileOptions(jpath="$"))
    assert table.columns == ("ts", "Unnamed_A", "v")
    assert rows(table) == [("2024-01-15", None, "[1]"), ("x", "2", None)]


def test_json_values_one_after_another(spark, tmp_path):
    text = '{"m": "a}{b", "n": 1}{"m":\n "]["}\n\n [ ] '.replace("[ ]", '{"n": {"q": "} {"}}')
    path = write(f"{tmp_path}/c.json", text)
    table = open_events(spark, path, FileOptions(jpath="$"))
    assert rows(table) == [("a}{b", "1"), ("][", ""), ("", '{"q":"} {"}')]
    lines = write(f"{tmp_path}/l.json", '{"a":1,"b":"x"}\nbroken\n{"b":"y"}\n')
    assert sorted(rows(open_events(spark, lines))) == sorted([("", "1", "x"), ("broken", "", ""), ("", "", "y")])


def test_json_shape_of_each_file(spark, tmp_path):
    for name, value in (("a", [{"k": 1}, 5, {"k": 2, "only": "x"}]), ("b", [["k", "v"], [3, "y"], [4]]), ("c", {"k": 9}),
                        ("d", [1, 2]), ("e", []), ("g", [["v"], {"k": 7}, ["z"]])):
        write(f"{tmp_path}/d/{name}.json", json.dumps({"data": value}))
    write(f"{tmp_path}/d/f.json", "no json")
    options = FileOptions(is_directory=True, file_pattern="*.json", jpath="$.data", include_source=True)
    table = open_events(spark, f"{tmp_path}/d", options).df.fillna("")
    got = [tuple(r) for r in table.select("_row_index", "__source_file__", "k", "v", "only", "_rejected").orderBy("_row_index").collect()]
    assert got == [
        (0, "a.json", "1", "", "", ""), (1, "a.json", "2", "", "x", ""), (2, "b.json", "3", "y", "", ""), (3, "b.json", "4", "", "", ""),
        (4, "c.json", "", "", "", '{"data": {"k": 9}}'), (5, "d.json", "", "", "", '{"data": [1, 2]}'),
        (6, "f.json", "", "", "", "no json"), (7, "g.json", "", "z", "", "")]
    with pytest.raises(ValueError, match="gives no array"):
        open_events(spark, f"{tmp_path}/d/c.json", FileOptions(jpath="$.data"))


def workbook(path, sheet, shared=None):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/'
                   'relationships"><sheets><sheet name="S" sheetId="1" r:id="rId7"/><sheet name="T" sheetId="2" r:id="rId8"/>'
                   '</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/'
                   'relationships"><Relationship Id="rId8" Target="worksheets/two.xml"/><Relationship Id="rId7" '
                   'Target="worksheets/one.xml"/></Relationships>')
        z.writestr("xl/worksheets/one.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")


def test_workbook(spark, tmp_path):
    path = f"{tmp_path}/w.xlsx"
    workbook(path, '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>v</t></is></c></row>'
             '<row r="3"><c r="A3"><v>2024</v></c><c r="B3" t="b"><v>1</v></c><c r="C3" t="s"><v>1</v></c></row>'
             '<row r="4"><c r="B4" t="str"><v>f</v></c></row>', ["<t>time</t>", "<r><t>ri</t></r><r><t>ch</t></r>"])
    table = open_events(spark, path)
    assert table.columns == ("time", "Unnamed_A", "v")
    assert rows(table) == [("2024", "TRUE", "rich"), ("", "f", None)]
    both = open_events(spark, str(tmp_path), FileOptions(is_directory=True, file_pattern="*.xlsx", include_source=True))
    assert both.columns[-1] == "__source_file__" and both.total() == 2


LINES = """Jan 15 10:30:00 myhost kernel: [12345.678901] USB device connected
Jan  3 10:30:04 myhost systemd[1]: Started Session 42

2025-12-14T02:45:09.954130+13:00 userpc kernel: audit: type=1400
2025-12-14T03:45:19Z userpc kernel: [12345.678] USB
Feb 30 10:30:00 h no facility text
Foo 5 10:30:00 h f:m
something else"""


def test_syslog(spark, tmp_path):
    path = write(f"{tmp_path}/kern.log", LINES.replace("\n", "\r\n"))
    table = open_events(spark, path)
    assert table.columns == syslog.COLUMNS
    lines = spark.createDataFrame([(i, s) for i, s in enumerate(LINES.split("\n"))], "i int, value string")
    got = [tuple(r)[1:] for r in syslog.parse(lines, year=2024).orderBy("i").collect()]
    assert got == [
        ("2024-01-15 10:30:00", "myhost", "kernel", "12345.678901", "USB device connected"),
        ("2024-01-03 10:30:04", "myhost", "systemd[1]", "", "Started Session 42"),
        ("2025-12-14 02:45:09", "userpc", "kernel", "", "audit: type=1400"),
        ("2025-12-14 03:45:19", "userpc", "kernel", "12345.678", "USB"),
        ("Feb 30 10:30:00", "h", "", "", "no facility text"),
        ("2024-01-05 10:30:00", "h", "f", "", "m"), ("", "", "", "", "something else")]
    assert [r[4] for r in rows(table)] == [g[4] for g in got]


W3C = """#Software: x
#Version: 1.0
#Fields: date time c-ip cs(User-Agent) sc-status
2024-01-15 10:30:01 10.0.0.1 Mozilla/5.0 200
2024-01-15 - 10.0.0.2 -
#Fields: other
2024-01-15 10:30:03 10.0.0.3 a 404 surplus"""
IIS = "192.168.114.201, -, 03/20/24, 7:55:20, W3SVC2, SALES1, 172.21.13.45, 4502, 163, 3223, 200, 0, GET, /Logo.gif, -\n" \
      "10.0.0.1, bob, 3/2/99, 1:02:03, A, B, C, 1, 2, 3, 4, 5, GET, /x\nshort, line"
NCSA = '172.21.13.45 - - [08/Apr/2024:17:39:04 -0800] "GET /index.html HTTP/1.1" 200 3401\nbroken\n' \
       '10.0.0.1 id bob [9/May/2024:01:02:03] "GET" 404 -\n10.0.0.1 - - [odd time] "" 1 2 rest\n'


def test_weblogs(spark, tmp_path):
    w3c = open_events(spark, write(f"{tmp_path}/1.log", W3C))
    assert w3c.columns == ("timestamp", "c-ip", "cs(User-Agent)", "sc-status")
    assert rows(w3c) == [("2024-01-15T10:30:01Z", "10.0.0.1", "Mozilla/5.0", "200"), ("2024-01-15 -", "10.0.0.2", "", ""),
                         ("2024-01-15T10:30:03Z", "10.0.0.3", "a", "404")]
    iis = open_events(spark, write(f"{tmp_path}/2.log", IIS))
    assert iis.columns == weblogs.IIS_COLUMNS
    assert [r[:3] + r[11:] for r in rows(iis)] == [
        ("2024-03-20T7:55:20", "192.168.114.201", "", "GET", "/Logo.gif", ""),
        ("1999-03-02T1:02:03", "10.0.0.1", "bob", "GET", "/x", ""), ("", "short", "line", "", "", "")]
    ncsa = open_events(spark, write(f"{tmp_path}/3.log", NCSA))
    assert rows(ncsa) == [
        ("2024-04-08T17:39:04-08:00", "172.21.13.45", "", "", "GET", "/index.html", "HTTP/1.1", "200", "3401"),
        ("2024-05-09T01:02:03", "10.0.0.1", "id", "bob", "GET", "", "", "404", ""),
        ("odd time", "10.0.0.1", "", "", "", "", "", "1", "2")]
    everything = open_events(spark, f"{tmp_path}", FileOptions(plugin_id="weblog"))
    assert everything.total() == 9 and "cs(User-Agent)" in everything.columns and "ident" in everything.columns


def test_weblog_vote_counts_all_lines(spark, tmp_path):
    good = {"1.log": NCSA, "2.log": "\n".join(IIS.split("\n")[:1] * 3)}
    for name, text in good.items():
        for first in ("cut off", "2024-01-15 10:30:01 a line of another log"):
            table = open_events(spark, write(f"{tmp_path}/{name}", f"{first}\n{text}"))
            assert "client_ip" in table.columns and "GET" in {r.method for r in table.df.collect()}
    lines = [("a", "2024-01-15 x y"), ("a", ", ".join("f" * 12)), ("b", ", ".join("f" * 12)), ("b", "2024-01-15 x y"),
             ("c", "words"), ("c", "more words"), ("d", ""), ("e", "words"), ("e", "#Version: 1"), ("e", ", ".join("f" * 12))]
    df = spark.createDataFrame([(f, s, i) for i, (f, s) in enumerate(lines)], "_file string, value string, _seq bigint")
    assert {r._file: r.format for r in weblogs.vote(df).collect()} == {
        "a": "w3c", "b": "iis_native", "c": "unknown", "d": "unknown", "e": "w3c"}


def test_weblog_field_lists_change_in_a_file(spark, tmp_path):
    block = "#Fields: date time c-ip\n" + "2024-01-15 10:30:01 {i}\n" * 200 + "#Fields: time sc-status date cs-method\n" + \
        "10:30:02 {i} 2024-01-15 GET\n" * 300
    text = "2024-01-15 10:30:00 early\n" + "".join(block.replace("{i}", str(i)) for i in range(40))
    write(f"{tmp_path}/d/b.log", text)
    write(f"{tmp_path}/d/a.log", "#Fields: date time c-ip\n2024-01-15 10:30:03 steady\n")
    with gzip.open(f"{tmp_path}/d/c.log.gz", "wb") as f:
        f.write(block.replace("{i}", "7").encode())
    want = [("2024-01-15T10:30:03Z", "steady", "", ""), ("2024-01-15T10:30:00Z", "early", "", "")]
    for i in [*range(40), 7]:
        want += [("2024-01-15T10:30:01Z", str(i), "", "")] * 200 + [("2024-01-15T10:30:02Z", "", str(i), "GET")] * 300
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert spark.read.text(f"{tmp_path}/d/b.log").rdd.getNumPartitions() > 5
        table = open_events(spark, f"{tmp_path}/d", FileOptions(is_directory=True, file_pattern="*.log*"))
        got = table.df.fillna("").orderBy("_row_index").select("_row_index", "timestamp", "c-ip", "sc-status", "cs-method").collect()
        assert [tuple(r) for r in got] == [(i, *w) for i, w in enumerate(want)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_registered_sources(spark, tmp_path):
    def pipes(spark, path, options):
        from chronosift.operators.ordinal import located, with_file_ordinal
        return with_file_ordinal(located(spark.read.option("sep", "|").option("header", True).csv(path)), "_row_index").drop("_file")

    sources = standard_sources()
    sources.register("pipes", ["PSV"], pipes)
    sources.register("late", ["psv"], lambda *a: pytest.fail("the first one keeps the ending"))
    path = write(f"{tmp_path}/x.psv", "a|b\n1|2\n")
    assert rows(open_events(spark, path, sources=sources)) == [("1", "2")]
    upper = open_events(spark, path, FileOptions(plugin_id="upper"), sources=sources)
    assert rows(upper) == [("1", "A|B"), ("2", "1|2")]
    with pytest.raises(LookupError):
        open_events(spark, path, FileOptions(plugin_id="none"), sources=sources)
    # Without a loader an unknown ending is read as CSV.
    assert open_events(spark, path).columns == ("a|b",)


def test_saved_tables(spark, tmp_path):
    path = write(f"{tmp_path}/x.csv", "timestamp,v\n2024-01-15,a\nx,b\n")
    save_events(open_events(spark, path), f"{tmp_path}/saved")
    back = load_events(spark, f"{tmp_path}/saved")
    assert rows(back) == [("2024-01-15", "a"), ("x", "b")] and back.after("2024-01-01").total() == 1
    spark.read.parquet(f"{tmp_path}/saved").select("v").repartition(3).write.parquet(f"{tmp_path}/many")
    from chronosift.plans.event_table import EventTable
    many = EventTable.from_parquet(spark, f"{tmp_path}/many")
    assert sorted(r._row_index for r in many.df.collect()) == [0, 1]


def test_vote_sorts_no_lines(spark):
    from chronosift.sources import weblogs
    rows = [("a", 0, i, "2024-01-01 00:00:00 GET /x") for i in range(3)] + [("a", 0, 3, "#Fields: date time x"), ("b", 0, None, "1.2.3.4 - - [x] \"GET /\" 200 1"), ("b", 0, 1, "2024-01-01 a b")]
    lines = spark.createDataFrame(rows, "_file string, _start long, _seq long, value string")
    found = weblogs.vote(lines, order=("_start", "_seq"))
    aggregates = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(" in line]
    assert "HashAggregate" in aggregates[-1]
    assert {(r["_file"], r["format"], r["varies"]) for r in found.collect()} == {("a", "w3c", False), ("b", "ncsa", False)}


def test_nested_documents_grow_in_number(spark, tmp_path, monkeypatch):
    from chronosift.plans import source_catalog
    monkeypatch.setattr(source_catalog, "NESTED", 10)
    written = []
    monkeypatch.setattr(source_catalog, "open_events", lambda spark, path, *a, **k: written.append(path) or open_events(spark, path, *a, **k))
    spark.range(200).selectExpr("id as event_id", "if(id % 3 = 0, 'click', 'view') as event_type").write.parquet(f"{tmp_path}/events.parquet")
    found = source_catalog.source_json_descent(spark, str(tmp_path))
    assert sorted(int(r["event_id"]) for r in found.collect()) == [i for i in range(200) if i % 3]
    assert spark.read.text(written[0]).count() == 20
