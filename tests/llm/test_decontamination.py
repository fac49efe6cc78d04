"""Decontamination against a search of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronosift.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    out = []
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    hit.update(range(i, i + n))
                    named |= found
        ids = ",".join(sorted(named))
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(13)
    vocabulary = ["w%d" % i for i in range(40)] + ["é", "日本", "ÀB", "x"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(rng.choice([10, 11, 30, 60])))) for i in range(20)]
    common = " ".join(prose(25))
    items += [(100 + i, f"{' '.join(prose(5))} {common} {' '.join(prose(i))}") for i in range(12)]
    items += [(200, " ".join(prose(9))), (201, " ".join(prose(6))), (202, "unusual pair"), (203, "solitary"),
              (204, None), (205, ""), (206, " ,.- "), (None, "no id has this item"), (207, items[0][1]), (0, items[0][1]),
              (0, "second text of the same id and it is long enough for windows of its own"), (208, "again " * 30)]
    docs = []
    for i in range(60):
        body = prose(rng.randrange(3, 80))
        for _ in range(rng.randrange(3)):
            part = (rng.choice(items)[1] or "").split()
            cut = rng.randrange(len(part)) if part else 0
            at = rng.randrange(len(body))
            body[at:at] = part[cut:cut + rng.choice([5, 9, 10, 12, 40])]
        docs.append((i, (rng.choice([" ", ", ", "\n"])).join(body).upper() if i % 3 else " ".join(body)))
    docs += [(100 + i, f"{' '.join(prose(9))} {common}") for i in range(30)]
    docs += [(200, None), (201, ""), (202, "..."), (203, "again " * 200), (204, "Solitary; UNUSUAL-pair"), (204, "solitary"),
             (None, "no id HAS this: item"), (205, " ".join(prose(20_000))), (206, "y" * 100_000)]
    return docs, items


@pytest.mark.parametrize("bits", [24, 7])
def test_report(spark, monkeypatch, bits):
    """A filter that is full lets all through, and nothing else changes."""
    monkeypatch.setattr(decontamination, "FILTER_BITS", bits)
    docs, items = sample()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("number", F.lit(1)).withColumn("items", F.lit(2)).withColumn("kind", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1)).withColumn("salt", F.lit(0))
    got = sorted((tuple(r) for r in decontamination.report(d, b).collect()), key=repr)
    assert got == brute(docs, items)
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontamination.report(docs, items).collect()] == [(2, 0, 0)]
    assert decontamination.report(docs.limit(0), items).count() == 0


def test_winnowing_keeps_every_shared_span():
    """Texts that share ten words share a fingerprint, and few of all runs are kept."""
    gen = np.random.default_rng(3)
    a, b = gen.integers(0, 1 << 62, 5000, dtype=np.uint64), gen.integers(0, 1 << 62, 300, dtype=np.uint64)
    for at in range(0, 280, 7):
        b2 = b.copy()
        b2[at:at + 10] = a[at * 5:at * 5 + 10]
        mine, theirs = decontamination.fingerprints(a, 10), decontamination.fingerprints(b2, 10)
        assert mine[at * 5] == theirs[at]
    assert len(np.unique(decontamination.fingerprints(a, 10))) < 0.4 * 4996
