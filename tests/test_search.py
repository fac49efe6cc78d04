import random
import re

import pytest

from chronosift.functions.predicates import field_ne
from chronosift.operators.search import find, highlight, hit_page


def brute(rows, header, needle, regex=False):
    hits = []
    for pos, row in enumerate(rows):
        for i, cell in enumerate(row):
            cell = cell or ""
            if regex:
                m = re.search(needle, cell)
                span = (m.start(), m.end()) if m and cell else None
            else:
                at = cell.lower().find(needle.lower())
                span = (at, at + len(needle)) if at >= 0 else None
            if span:
                lo, hi = max(span[0] - 30, 0), min(span[1] + 30, len(cell))
                hits.append((pos, i, header[i], *span, ("…" if lo else "") + cell[lo:hi] + ("…" if hi < len(cell) else "")))
    return hits


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["alpha", "Été", "naïve", "beta", "GAMMA", "aaaa", "x"]
    cell = lambda: " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))
    return [(cell(), None if i % 5 == 0 else cell(), cell()) for i in range(60)]


HEADER = ["a", "b", "c"]


@pytest.mark.parametrize("needle,regex", [("ALPHA", False), ("été", False), ("a", False), ("aaa", False), (
    "[A-Z]+|na", True), ("nothing", False), ("x$", True)])
def test_find(make, texts, needle, regex):
    table = make(HEADER, texts)
    got = [tuple(r) for r in find(table, needle, regex=regex).select(
        "row_pos", "column_index", "column_name", "match_start", "match_end", "snippet").collect()]
    assert sorted(got) == brute(texts, HEADER, needle, regex)
    down = table.sort(("a", True)).filter(field_ne("b", "x"))
    order = down.result().collect()
    got = [tuple(r) for r in find(down, needle, regex=regex).select(
        "row_pos", "column_index", "column_name", "match_start", "match_end", "snippet").collect()]
    assert sorted(got) == brute([tuple(r) for r in order], HEADER, needle, regex)


def test_find_searches_displayed_time(make):
    table = make(["timestamp", "m"], [("1705311000", "1705311000")])
    assert [(r.column_index, r.snippet) for r in find(table, "2024-01-15").collect()] == [(0, "2024-01-15 09:30:00")]
    assert [r.column_index for r in find(table, "17053").collect()] == [1]
    assert find(table, "").count() == 0


def test_hit_limits_and_pages(make, texts):
    table = make(HEADER, texts)
    everything = find(table, "a", max_hits=None)
    n = everything.count()
    assert find(table, "a", max_hits=10).count() == 10 < n
    pages = [hit_page(everything, p, 25).collect() for p in range(n // 25 + 1)]
    assert sum(map(len, pages)) == n
    flat = [(r.row_pos, r.column_index) for page in pages for r in page]
    assert flat == sorted(flat)


@pytest.mark.parametrize("terms", [["alpha"], ["aa"], ["a", "al", "TA"], ["é", "t"], ["a.", "(", ""], ["zzz"]])
def test_highlight(make, texts, terms):
    got = sorted(tuple(r) for r in highlight(make(HEADER, texts), terms).select(
        "row_index", "column_index", "span_start", "span_end").collect())
    want = []
    for pos, row in enumerate(texts):
        for i, cell in enumerate(row):
            cell, covered = (cell or "").lower(), []
            for term in filter(None, (t.lower() for t in terms)):
                covered += [(m, m + len(term)) for m in range(len(cell)) if cell.startswith(term, m)]
            merged = []
            for s, e in sorted(covered):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            want += [(pos, i, s, e) for s, e in merged]
    assert got == sorted(want)
