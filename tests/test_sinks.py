import glob
import hashlib
import os

from chronosift.operators import annotations as A
from chronosift.operators import fingerprints
from chronosift.operators.fingerprints import directory_changed, directory_hash, file_hashes
from chronosift.sinks.selection import export_selection, selection
from chronosift.sinks.timeline import export_timeline, folder_timeline, timeline
from chronosift.sources.directory import listing


def lines(path):
    return [line for part in sorted(glob.glob(f"{path}/part-*")) for line in open(part, newline="").read().splitlines()]


def test_timeline(spark, make, tmp_path):
    one = make(["time", "msg", "zz"], [("2024-01-03", 'say "x", y', None), ("2024-01-01", "b", "1"), ("2024-01-02", "c", "2")],
               file_key="one")
    two = make(["alpha", "ts"], [("q", "1704164645"), ("r", "soon"), ("s", "")], file_key="two")
    none = make(["alpha"], [("q",)], file_key="none")
    empty = spark.createDataFrame([], A.SCHEMA)
    notes = A.annotate(none, A.annotate(two.limit(2), A.annotate(one.page(0, 2), empty, "n1"), "n2"), "n3")
    files = spark.createDataFrame([("one", "/1", "first"), ("two", "/2", None)],
                                  "file_key string, file_path string, description string")
    rows = timeline([one, two, none], notes, files)
    assert rows.columns == ["_TT_timestamp", "_TT_filepath", "_TT_file_description", "_TT_note", "alpha", "msg", "zz"]
    assert [tuple(r) for r in rows.collect()] == [
        ("2024-01-01 00:00:00", "/1", "first", "n1", "", "b", "1"),
        ("2024-01-02 03:04:05", "/2", "", "n2", "q", "", ""),
        ("2024-01-03 00:00:00", "/1", "first", "n1", "", 'say "x", y', ""),
        ("soon", "/2", "", "n2", "r", "", "")]
    export_timeline(rows.coalesce(1), f"{tmp_path}/t")
    out = lines(f"{tmp_path}/t")
    assert out[0] == "_TT_timestamp,_TT_filepath,_TT_file_description,_TT_note,alpha,msg,zz"
    assert out[1] == "2024-01-01 00:00:00,/1,first,n1,,b,1" and '"say ""x"", y"' in out[3]


def test_folder_timeline(spark, tmp_path):
    import contextlib
    import io
    import pytest
    from chronosift.sources.open import open_events
    from chronosift.sources.options import FileOptions

    def folder(n):
        root = tmp_path / f"n{n}"
        root.mkdir()
        for i in range(n):
            head = "ts,msg" if i % 2 else "host,ts"
            body = [f"2024-01-0{1 + (i + r) % 9},m{i}{r}" if i % 2 else f"h{i}{r},2024-02-0{1 + (i + r) % 9}" for r in range(3)]
            (root / f"f{i:02}.csv").write_text("\n".join([head, *body]) + "\n")
        t = open_events(spark, str(root), FileOptions(is_directory=True, file_pattern="*.csv", include_source=True))
        files = spark.createDataFrame([(f"k{i}", f"{root}/f{i:02}.csv", None if i else "first") for i in range(n)],
                                      "file_key string, file_path string, description string")
        return str(root), t, files

    def depth(df):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain()
        return out.getvalue().count("Join"), out.getvalue().count("Scan")

    # An older note of a row, a row beyond its file, one before it, and an unknown file.
    notes = spark.createDataFrame([("a", "k0", 2, "old", 0), ("b", "k0", 2, "new", 5), ("c", "k1", 0, None, 0), ("d", "k2", 3, "no", 0),
                                   ("e", "k2", -1, "no", 0), ("f", "kx", 0, "no", 0)],
                                  "annotation_id string, file_key string, row_index bigint, note string, s bigint").selectExpr(
        "annotation_id", "file_key", "row_index", "note", "timestamp_seconds(s) as created_at")
    root, t, files = folder(4)
    rows = folder_timeline(t, root, notes, files)
    assert [tuple(r) for r in rows.collect()] == [
        ("2024-01-02 00:00:00", f"{root}/f01.csv", "", "", "", "m10"),
        ("2024-02-03 00:00:00", f"{root}/f00.csv", "first", "new", "h02", "")]
    assert rows.columns[4:] == ["host", "msg"]
    with pytest.raises(ValueError, match="whole"):
        folder_timeline(t.filter(after="2024-01-01"), root, notes, files)
    more_root, more, more_files = folder(24)
    assert depth(folder_timeline(more, more_root, notes, more_files)) == depth(folder_timeline(t, root, notes, files))


def test_selection(make, tmp_path):
    table = make(["time", "a", "j"], [(f"2024-01-0{i}", f"v\t{i}\nw", '{"k":"x\\ty"}') for i in range(1, 6)])
    rows = selection(table.sort(("time", True)), [(0, 1), (3, 9)], ["A", "time", "none", "j"], None, {"J": "$.k"})
    got = [tuple(r) for r in rows.orderBy("position").collect()]
    assert got[0] == (0, "v 5 w", "2024-01-05 00:00:00", "", "x y") and [g[0] for g in got] == [0, 3, 4]
    export_selection(rows, f"{tmp_path}/s")
    out = lines(f"{tmp_path}/s")
    assert out[0] == "A\ttime\tnone\tj" and out[1] == "v 5 w\t2024-01-05 00:00:00\t\tx y"
    assert selection(table).count() == 5


def test_fingerprints(spark, tmp_path, monkeypatch):
    os.makedirs(f"{tmp_path}/d/s")
    data = {"a.bin": b"one", "s/b.bin": b"two" * 100000, "s/b c.bin": b"3"}
    for name, body in data.items():
        with open(f"{tmp_path}/d/{name}", "wb") as f:
            f.write(body)
    sha = lambda b: hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()
    for cell in (fingerprints.CELL, 5):
        monkeypatch.setattr(fingerprints, "CELL", cell)
        got = {r.path[-5:]: r.file_hash for r in file_hashes(listing(spark, f"{tmp_path}/d", "**/*.bin")).collect()}
        assert got == {n[-5:]: sha(b) for n, b in data.items()}
    level = sorted((sha(n), sha(sha(b) + n)) for n, b in data.items())
    for digits in (4, 2, 0):
        level = [(mark, sha("".join(h for m, h in level if m[:digits] == mark)))
                 for mark in sorted({m[:digits] for m, _ in level})]
    want = level[0][1]
    assert directory_hash(spark, f"{tmp_path}/d", "**/*.bin") == want
    assert not directory_changed(spark, f"{tmp_path}/d", "**/*.bin", want)
    assert directory_changed(spark, f"{tmp_path}/d", "*.bin", want)
    assert directory_changed(spark, f"{tmp_path}/d", "*.none", want)
    assert not directory_changed(spark, f"{tmp_path}/d", "*.bin", None)


def test_hashes_keep_columns_and_need_no_join(spark, tmp_path, monkeypatch):
    import hashlib
    from chronosift.operators import fingerprints
    from chronosift.sources.directory import listing
    os.makedirs(f"{tmp_path}/d")
    for i in range(3):
        with open(f"{tmp_path}/d/{i}.bin", "wb") as file:
            file.write(b"x" * (i + 1))
    monkeypatch.setattr(fingerprints, "CELL", 2)
    found = fingerprints.file_hashes(listing(spark, f"{tmp_path}/d", "*.bin"), ["relative_path", "length"])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r)[1:] for r in found.collect()} == {
        (f"{i}.bin", i + 1, hashlib.sha256(b"x" * (i + 1)).hexdigest()) for i in range(3)}
