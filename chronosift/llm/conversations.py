"""Conversation structure repair by Hirschberg's divide and conquer.

The rows of a conversation are a sequence whose role initials should read ``(s?(ua)+)?``. That
is an automaton of four states, and a repair is a cheapest sequence of edits: Keep a row,
Rerole it to user or assistant, Delete it, Insert an empty one. Between two rows all that
matters of the rows before is a vector of four costs, and so is all of the rows after. Where
the two vectors meet, a cheapest repair crosses in a state of the least sum. Of several such
states the one is taken whose edits so far are least in ASCII order: each state carries the rank
of its least edits beside the cost, and the part up to a row ends with what was done to that
row, so that no such part begins another and ranks decide. The two sides are then solved alone.

Rows are numbered by a range partitioning and cut into buckets of ``BUCKET`` rows. The rows of
one conversation in one bucket are a segment, a string of one character a row. A segment
is first summed up as a four by four matrix of costs and ranks. Passes over the matrices of a
conversation, forward and backward, tell in which state it enters and leaves each segment,
and segments are then solved apart from one another. A conversation of any length is so never
in one task with its rows; one of few rows is one segment, and its passes are trivial.

Faults. A row's first one counts: ``blank`` (nothing but white space), ``duplicate`` (role and
text of an earlier row), ``truncated`` (last character that isn't white space is none of
``.!?``). Blank and duplicate rows have to be deleted; a truncated row that stays costs more.

Edge cases. Null ids are one conversation. Rows are in order of turn, null turns first; rows of
one turn are in order of role and text. A null role or text is one space. An empty role or one
of another initial than s, u, a can't be kept. Repeated rows are duplicates. An empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.operators.ordinal import with_position
from chronosift.session import pinned

WHITE = " \t\n\x0b\f\r"
BUCKET = 4096
# Bytes of repaired text that are put together before they are hashed.
CHUNK = 1 << 20
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# States: nothing yet, after system, after user, after assistant. Nothing and assistant may be last.
STATES = 4
START, SYSTEM, USER, ASSISTANT = range(STATES)
# Where a state goes by an inserted or reroled row, and that row's role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
INITIALS, FAULTS = "sua-", ("", "truncated", "blank", "duplicate")
NEVER = 1 << 40


def _decoded(char: str) -> tuple[str, str]:
    number = ord(char) - 97
    return INITIALS[number // len(FAULTS)], FAULTS[number % len(FAULTS)]


@lru_cache(maxsize=None)
def words(char: str) -> list[tuple[int, int, str, int]]:
    """All ways to get over a row: state before, state after, edits (inserts, then one edit of the
    row), cost. Cheapest ones of the least edits only."""
    initial, fault = _decoded(char)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(STATES):
        state = before
        for inserted in range(3):       # a third one would come back to a state already seen
            cost, edits = INSERT * inserted, "I" * inserted
            ways = [(state, cost + DELETE, edits + "D")]
            if fault not in ("blank", "duplicate"):
                stays = TRUNCATED if fault == "truncated" else 0
                ways.append((NEXT[state], cost + REROLE + stays, edits + "R"))
                if (state, initial) in KEPT:
                    ways.append((KEPT[state, initial], cost + stays, edits + "K"))
            for after, spent, text in ways:
                best[before, after] = min(best.get((before, after), (NEVER, "")), (spent, text))
            state = NEXT[state]
    return [(b, a, text, cost) for (b, a), (cost, text) in best.items()]


@lru_cache(maxsize=None)
def word(char: str, before: int, after: int) -> str:
    return next(text for b, a, text, _ in words(char) if (b, a) == (before, after))


# Inserts after the last row, by state.
ENDINGS = tuple("I" * n for n in (0, 2, 1, 0))
END = tuple(INSERT * len(e) for e in ENDINGS)


def _ranked(found: list[tuple]) -> tuple[int, ...]:
    """Ranks of comparable keys; a key of None ranks last."""
    order = sorted({f for f in found if f is not None})
    return tuple(order.index(f) if f is not None else STATES for f in found)


@lru_cache(maxsize=1 << 16)
def _forward(costs: tuple, ranks: tuple, char: str) -> tuple[int, tuple, tuple]:
    best: list = [None] * STATES
    for before, after, text, cost in words(char):
        if costs[before] < NEVER:
            way = (costs[before] + cost, ranks[before], text)
            if best[after] is None or way < best[after]:
                best[after] = way
    least = min(b[0] for b in best if b)
    return (least, tuple(b[0] - least if b else NEVER for b in best),
            _ranked([b[1:] if b else None for b in best]))


@lru_cache(maxsize=1 << 16)
def _backward(costs: tuple, char: str) -> tuple:
    best = [NEVER] * STATES
    for before, after, _, cost in words(char):
        best[before] = min(best[before], costs[after] + cost)
    least = min(best)
    return tuple(b - least if b < NEVER else NEVER for b in best)


def only(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else NEVER for s in range(STATES))


def forward(codes: str, state: int) -> tuple[int, tuple, tuple]:
    """What all but the costs share, costs and ranks by state after ``codes``, from ``state``."""
    total, costs, ranks = 0, only(state), (0,) * STATES
    for char in codes:
        more, costs, ranks = _forward(costs, ranks, char)
        total += more
    return total, costs, ranks


def backward(codes: str, costs: tuple) -> tuple:
    """Costs by state before ``codes``, up to what all share, from those after."""
    for char in reversed(codes):
        costs = _backward(costs, char)
    return costs


def crossing(costs: tuple, ranks: tuple, rest: tuple) -> int:
    """The state in which the cheapest repair of the least edits crosses."""
    return min(range(STATES), key=lambda s: (costs[s] + rest[s], ranks[s]))


def edits(codes: str, before: int, after: int) -> str:
    """The cheapest edits of rows between two states, least in ASCII order: Hirschberg's recursion."""
    if len(codes) == 1:
        return word(codes, before, after)
    middle = len(codes) // 2
    left, right = codes[:middle], codes[middle:]
    _, costs, ranks = forward(left, before)
    state = crossing(costs, ranks, backward(right, only(after)))
    return edits(left, before, state) + edits(right, state, after)


def matrix(codes: str) -> list[int]:
    """Costs and ranks from each state to each: 4 costs and 4 ranks a row."""
    out: list[int] = []
    for state in range(STATES):
        total, costs, ranks = forward(codes, state)
        out += [c + total if c < NEVER else NEVER for c in costs] + list(ranks)
    return out


def after_segment(costs: list[int], ranks: list[int], step: list[int]) -> tuple[list[int], list[int]]:
    """Costs and ranks after a segment of matrix ``step``."""
    spent, keys = [], []
    for after in range(STATES):
        way = min((costs[b] + step[8 * b + after], ranks[b], step[8 * b + 4 + after]) for b in range(STATES))
        spent.append(min(way[0], NEVER))
        keys.append(way[1:] if way[0] < NEVER else None)
    return spent, list(_ranked(keys))


def before_segment(costs: list[int], step: list[int]) -> list[int]:
    return [min(NEVER, *(costs[a] + step[8 * b + a] for a in range(STATES))) for b in range(STATES)]


def _character(role: Column, fault: Column) -> Column:
    """One character for all that matters of a row; ``fault`` is a place in ``FAULTS``."""
    first = F.substring(role, 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return F.char(F.lit(97) + initial * len(FAULTS) + fault)


def numbered(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """All rows as ``conv_id, turn, role, text, at``: numbers in order of conversation and turn."""
    plain = rows.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("_row"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_row")]
    return with_position(plain, order, "at").drop("_row")


def segments(lines: DataFrame) -> DataFrame:
    """The rows of ``numbered`` as ``at`` (the first row's), ``conv_id``, ``bucket``, ``codes``
    and the least, greatest and number of different turns."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    facts = lines.select(
        "conv_id", "turn", "role", "at", F.md5(F.to_json(F.struct("role", "text"))).alias("what"),
        (bare != "").alias("filled"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))
    # The first row of each text is found by its number, which no two rows share.
    first = facts.groupBy("conv_id", "what").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = (F.when(~F.col("filled"), FAULTS.index("blank")).when(F.col("first").isNull(), FAULTS.index("duplicate"))
             .when(F.col("truncated"), FAULTS.index("truncated")).otherwise(0))
    coded = facts.join(first, "at", "left").select(
        "conv_id", "turn", "at", F.floor(F.col("at") / BUCKET).alias("bucket"), _character(F.col("role"), fault).alias("code"))
    one = F.sort_array(F.collect_list(F.struct("at", "code")))       # BUCKET rows at most
    return coded.groupBy("bucket", "conv_id").agg(
        F.min("at").alias("at"), F.array_join(F.transform(one, lambda r: r["code"]), "").alias("codes"),
        F.min("turn").alias("least"), F.max("turn").alias("most"), F.size(F.collect_set("turn")).alias("turns"))


def _batches(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrix of each segment, its outer rows' initials, and its own counts."""
    for batch in batches:
        steps, ends, counts = [], [], []
        for codes in batch.column("codes").to_pylist():
            steps.append(matrix(codes))
            initials = [_decoded(c)[0] for c in codes]
            faults = [_decoded(c)[1] for c in codes]
            ends.append(initials[0] + initials[-1])
            counts.append([faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                           sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))])
        names = ["conv_id", "bucket", "at", "least", "most", "turns"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(steps, pa.list_(pa.int64())), pa.array(ends, pa.string()),
                                                pa.array(counts, pa.list_(pa.int64()))],
            names=[*names, "step", "ends", "counts"])


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order: costs and ranks before each, and what its seam with the one before adds."""
    known, conv, costs, ranks, before = False, None, [], [], None
    for batch in batches:
        lefts, seams, turns, firsts = [], [], [], []
        for row in batch.to_pylist():
            if not known or row["conv_id"] != conv:
                known, conv, before = True, row["conv_id"], None
                costs, ranks = list(only(START)), [0] * STATES
            lefts.append(costs + ranks)
            firsts.append(before is None)
            seams.append(int(before is not None and before["ends"][1] + row["ends"][0] not in ("su", "ua", "au")))
            shared = before is not None and row["least"] is not None and before["most"] == row["least"]
            turns.append(row["turns"] - int(shared))
            costs, ranks = after_segment(costs, ranks, row["step"])
            before = row
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(lefts, pa.list_(pa.int64())), pa.array(seams, pa.int64()), pa.array(turns, pa.int64()),
             pa.array(firsts, pa.bool_())], names=[*batch.schema.names, "left", "seam", "own_turns", "first"])


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments, the last one first: states before and after each, and the whole cost at the last one."""
    known, conv, rest = False, None, []
    for batch in batches:
        enters, leaves, lasts, wholes, spent = [], [], [], [], []
        for row in batch.to_pylist():
            last = not known or row["conv_id"] != conv
            if last:
                known, conv, rest = True, row["conv_id"], list(END)
            left, step = row["left"], row["step"]
            costs, ranks = after_segment(left[:STATES], left[STATES:], step)
            leaves.append(crossing(costs, ranks, rest))
            spent.append(min(c + r for c, r in zip(costs, rest)) if last else 0)
            rest = before_segment(rest, step)
            enters.append(crossing(left[:STATES], left[STATES:], rest))
            lasts.append(last)
            wholes.append(last and row["first"])
        names = ["conv_id", "bucket", "at", "least", "most", "counts", "seam", "own_turns"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(enters, pa.int32()), pa.array(leaves, pa.int32()),
                                                pa.array(lasts, pa.bool_()), pa.array(wholes, pa.bool_()), pa.array(spent, pa.int64())],
            names=[*names, "enter", "leave", "last", "whole", "cost"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, str] = {}
    for batch in batches:
        texts = []
        for key in zip(*[batch.column(n).to_pylist() for n in ("codes", "enter", "leave", "last")]):
            if key not in known:
                if len(known) > 100_000:
                    known.clear()
                codes, enter, leave, last = key
                known[key] = edits(codes, enter, leave) + (ENDINGS[leave] if last else "")
            texts.append(known[key])
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in ("conv_id", "bucket", "at", "enter", "whole")], pa.array(texts, pa.string())],
            names=["conv_id", "bucket", "at", "enter", "whole", "edits"])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket in order, each segment's edits before its rows, to edited rows."""
    names = ["conv_id", "at", "nth", "whole", "edit", "role", "text"]
    state, todo, place, whole = START, "", 0, False
    for batch in batches:
        out = []

        def inserted(row: dict, nth: int, state: int) -> int:
            out.append((row["conv_id"], row["at"], nth, whole, "I", ROLE[NEXT[state]], ""))
            return NEXT[state]

        for row in batch.to_pylist():
            if row["edits"] is not None:
                todo, place, state, whole = row["edits"], 0, row["enter"], row["whole"]
                continue
            nth = 0
            while todo[place] == "I":
                state = inserted(row, nth, state)
                place, nth = place + 1, nth + 1
            edit, role = todo[place], row["role"]
            place += 1
            if edit == "R":
                state, role = NEXT[state], ROLE[NEXT[state]]
            elif edit == "K":
                state = KEPT[state, role[0]]
            out.append((row["conv_id"], row["at"], nth, whole, edit, role, row["text"]))
            if len(todo) - place <= 2 and set(todo[place:]) == {"I"}:        # after the last row
                while place < len(todo):
                    place, nth = place + 1, nth + 1
                    state = inserted(row, nth, state)
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], t) for i, t in enumerate(
                [batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string()])],
            names=names)


def _hashable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edited rows in order to a row for each segment of a whole conversation, hashed, and to pieces
    of about ``CHUNK`` bytes of the others."""
    names = ["conv_id", "at", "audit", "lines", "piece", "sha256"]
    group, out, audit, lines, held, kind = None, [], [], [], 0, None

    def closed() -> None:
        text = "\n".join(lines).encode("utf-8", "surrogatepass")
        digest = hashlib.sha256(text).hexdigest() if group[3] else None
        out.append((group[0], group[2], "".join(audit), len(lines), None if digest else text, digest))

    def packed() -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, at, whole, edit, role, text in zip(
                *[batch.column(n).to_pylist() for n in ("conv_id", "at", "whole", "edit", "role", "text")]):
            if group is None or (conv, at // BUCKET) != group[:2] or (held > CHUNK and not whole):
                if group is not None:
                    closed()
                group, audit, lines, held = (conv, at // BUCKET, at, whole), [], [], 0
            audit.append(edit)
            if edit != "D":
                lines.append(f"{role}:{text}")
                held += len(lines[-1])
        yield packed()
        out = []
    if group is not None:
        closed()
        yield packed()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one row a conversation."""
    known, conv, audit, digest, lines, kind = False, None, [], None, 0, None

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])],
            names=["conv_id", "audit", "sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if not known or row["conv_id"] != conv:
                if known:
                    yield packed()
                known, conv, audit, digest, lines = True, row["conv_id"], [], hashlib.sha256(), 0
            audit.append(row["audit"])
            if row["lines"]:
                digest.update((b"\n" if lines else b"") + row["piece"])
                lines += row["lines"]
    if known:
        yield packed()


class Repair:
    """The repair of a table of conversations: its faults and costs, and its edited rows."""

    def __init__(self, rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.lines = numbered(rows, conv_id, turn, role, text)
        self.kind = self.lines.schema["conv_id"].dataType.simpleString()
        self.segments = pinned(segments(self.lines))
        turns = self.segments.schema["least"].dataType.simpleString()
        shape = f"conv_id {self.kind}, bucket long, at long, least {turns}, most {turns}, "
        steps = self.segments.mapInArrow(_summed, shape + "turns int, step array<long>, ends string, counts array<long>")
        entered = steps.repartition("conv_id").sortWithinPartitions("at").mapInArrow(
            _entered, shape + "turns int, step array<long>, ends string, counts array<long>, left array<long>, "
                              "seam long, own_turns long, first boolean")
        # The same rows of the same tasks, last ones first.
        self.crossed = pinned(entered.sortWithinPartitions(F.desc("at")).mapInArrow(
            _crossed, shape + "counts array<long>, seam long, own_turns long, enter int, leave int, last boolean, "
                              "whole boolean, cost long"))

    def faults(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated, illegal, cost``."""
        gaps = F.max("most") - F.min("least") + 1 - F.sum("own_turns")
        part = F.col("counts")
        return self.crossed.groupBy("conv_id").agg(
            F.coalesce(gaps, F.lit(0)).cast("bigint").alias("gaps"), F.sum(part[0]).alias("blank"),
            F.sum(part[1]).alias("duplicate"), F.sum(part[2]).alias("truncated"),
            F.sum(part[3] + F.col("seam")).alias("illegal"), F.sum("cost").alias("cost"))

    def edited(self) -> DataFrame:
        """Every edit in order, deleted rows included: ``conv_id``, ``at`` and ``nth`` (order), ``edit`` (K, R, D, I),
        and the row's role and text after it. ``whole`` says that the conversation is in one bucket. Tasks hold the
        rows of a bucket in order."""
        marks = self.segments.select("at", "codes").join(self.crossed, "at")
        solved = marks.select("conv_id", "bucket", "at", "enter", "whole", "codes", "leave", "last").mapInArrow(
            _solved, f"conv_id {self.kind}, bucket long, at long, enter int, whole boolean, edits string")
        lines = self.lines.select(
            "conv_id", F.floor(F.col("at") / BUCKET).alias("bucket"), "at", F.lit(None).cast("int").alias("enter"),
            F.lit(None).cast("boolean").alias("whole"), F.lit(None).cast("string").alias("edits"), "role", "text")
        both = solved.unionByName(lines, allowMissingColumns=True)
        dealt = both.repartition("bucket").sortWithinPartitions("at", F.col("edits").isNull())
        return dealt.mapInArrow(
            _applied, f"conv_id {self.kind}, at long, nth int, whole boolean, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """``conv_id, audit, sha256`` of the edited rows. SHA-256 goes through a text from its begin to its end: pieces
        of a conversation of several buckets meet in one task, which holds one of them at a time."""
        parts = pinned(self.edited().mapInArrow(
            _hashable, f"conv_id {self.kind}, at long, audit string, lines long, piece binary, sha256 string"))
        done = parts.filter("sha256 is not null").select("conv_id", "audit", "sha256")
        rest = parts.filter("sha256 is null").repartition("conv_id").sortWithinPartitions("at")
        return done.union(rest.mapInArrow(_hashed, f"conv_id {self.kind}, audit string, sha256 string"))


def report(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           ids: DataFrame | None = None) -> DataFrame:
    """Faults, cost, edits and digest of every conversation of ``rows``, and zeros for those of ``ids``
    (one column) without rows."""
    work = Repair(rows, conv_id, turn, role, text)
    ids = rows.select(F.col(f"`{conv_id}`").alias("conv_id")) if ids is None else ids.toDF("conv_id")
    found = work.faults().alias("f").join(
        work.digests().alias("d"), F.col("f.conv_id").eqNullSafe(F.col("d.conv_id"))).select("f.*", "audit", "sha256")
    every = ids.distinct().alias("i").join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
              for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("i.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
