"""Conversation repair against a search that keeps whole edit strings."""

import hashlib
import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronosift.llm import conversations

WHITE = " \t\n\x0b\x0c\r"
GO = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen
                   else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_edits(rows):
    """Least (cost, edits, lines) over all ways, position by position."""
    marks = faults(rows)
    best = {("", 0): (0, "", ())}
    for at in range(len(rows) + 1):
        for _ in range(3):
            for state in ("", "s", "u", "a"):
                if (state, at) in best:
                    cost, text, lines = best[state, at]
                    key, way = (NEXT[state], at), (cost + 3, text + "I", lines + (NAME[NEXT[state]] + ":",))
                    best[key] = min(best.get(key, way), way)
        if at == len(rows):
            return min(best[s, at] for s in ("", "a") if (s, at) in best)
        role, body = rows[at]
        for state in ("", "s", "u", "a"):
            if (state, at) not in best:
                continue
            cost, text, lines = best[state, at]
            ways = [(state, (cost + 4, text + "D", lines))]
            if marks[at] not in ("blank", "duplicate"):
                more = 3 if marks[at] == "truncated" else 0
                ways.append((NEXT[state], (cost + 3 + more, text + "R", lines + (f"{NAME[NEXT[state]]}:{body}",))))
                if (state, role[:1]) in GO:
                    ways.append((GO[state, role[:1]], (cost + more, text + "K", lines + (f"{role}:{body}",))))
            for after, way in ways:
                best[after, at + 1] = min(best.get((after, at + 1), way), way)


def brute(table):
    out = {}
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        groups[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    for conv, rows in groups.items():
        rows.sort()
        said = [r[2:] for r in rows]
        turns = {r[1] for r in rows if r[0]}
        marks = faults(said)
        cost, audit, lines = brute_edits(said)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                     *[marks.count(k) for k in ("blank", "duplicate", "truncated")],
                     sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_edits_of_all_short_sequences():
    """Every sequence of up to four rows, cut anywhere by the recursion."""
    letters = [chr(97 + n) for n in range(16)]
    roles = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}
    for length in (1, 2, 3):
        for codes in itertools.product(letters, repeat=length):
            rows = []
            for i, c in enumerate(codes):
                initial, fault = conversations._decoded(c)
                rows.append((initial, fault, roles[initial], i))
            text = "".join(codes)
            total, costs, ranks = conversations.forward(text, 0)
            last = conversations.crossing(costs, ranks, conversations.END)
            got = conversations.edits(text, 0, last) + conversations.ENDINGS[last]
            assert (total + costs[last] + conversations.END[last], got) == cheapest(rows), codes


def cheapest(rows):
    best = {("", 0): (0, "")}
    for at in range(len(rows) + 1):
        for _ in range(3):
            for state in ("", "s", "u", "a"):
                if (state, at) in best:
                    cost, text = best[state, at]
                    key, way = (NEXT[state], at), (cost + 3, text + "I")
                    best[key] = min(best.get(key, way), way)
        if at == len(rows):
            return min(best[s, at] for s in ("", "a") if (s, at) in best)
        initial, fault, _, _ = rows[at]
        for state in ("", "s", "u", "a"):
            if (state, at) in best:
                cost, text = best[state, at]
                ways = [(state, (cost + 4, text + "D"))]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    ways.append((NEXT[state], (cost + 3 + more, text + "R")))
                    if (state, initial) in GO:
                        ways.append((GO[state, initial], (cost + more, text + "K")))
                for after, way in ways:
                    best[after, at + 1] = min(best.get((after, at + 1), way), way)


def sample():
    rng = random.Random(11)
    texts = ["Hello.", "What now?", "Yes!", "No", "cut off here", "", " \t", "é 日本. ", "Done.\n", None, "Hello."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "agent"]
    table = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([1, 2, 3, 8, 20])):
            table.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(roles),
                          rng.choice(texts) if rng.random() < 0.4 else f"Number {rng.randrange(10**6)}" + rng.choice([".", "?", ""])))
    for turn in range(400):                     # one conversation much longer than a bucket
        table.append((1000, turn // 2 * 2, ["user", "assistant"][turn % 2], f"Turn {turn}." if turn % 7 else "Same again."))
    table += [(2000, None, "user", "Only null turns."), (2000, None, "assistant", "Here.")]
    table += [(3000, 5, "user", "x" * 200_000 + "."), (3000, 6, "assistant", "Long?"), (3000, 6, "assistant", "Long?")]
    return table


@pytest.mark.parametrize("bucket,chunk", [(4096, 1 << 20), (7, 40), (1, 1)])
def test_report(spark, monkeypatch, bucket, chunk):
    monkeypatch.setattr(conversations, "BUCKET", bucket)
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    table = sample()
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    rows = rows.withColumn("at", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("codes", F.lit("x")).withColumn("first", F.lit(3))
    ids = spark.createDataFrame([(r[0],) for r in table] + [(4000,)], "conv_id long")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.report(rows, ids=ids).collect()}
    want = brute(table)
    want[4000] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_edited_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BUCKET", 3)
    rows = spark.createDataFrame([(1, 0, "system", "Be nice."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", " "),
                                  (1, 3, "user", "Bye.")], "conv_id long, turn int, role string, text string")
    got = conversations.Repair(rows).edited().orderBy("at", "nth").select("edit", "role", "text").collect()
    assert [tuple(r) for r in got] == [
        ("K", "system", "Be nice."), ("I", "user", ""), ("K", "assistant", "Hi."), ("D", "assistant", " "),
        ("K", "user", "Bye."), ("I", "assistant", "")]


def test_empty(spark):
    rows = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversations.report(rows).count() == 0


def test_text_ids(spark):
    rows = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho."), (None, 1, "user", "x")],
                                 "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in conversations.report(rows).collect()}
    assert got == {"a": (0, "KK"), None: (4, "D")}
