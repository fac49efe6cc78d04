"""Secret scan: three fixed kinds, and runs of high entropy.

A candidate is a run of 20 or more characters of the base-64 alphabets with a letter and a
digit in it. A window of 20 characters slides over it; a table of counts is kept up to date
by the one character that comes and the one that goes, and with it the Shannon entropy. The
limit depends on the class of the run (hex, one case of letters, both). The span goes from
the first window over the limit to the end of the last one. What an allow-list knows as harmless
is left out: runs that are UUIDs, and of other runs the segments (each ends with ``/`` or ``-``) that
hold a sample or placeholder word or an alphabet; what stands beside them is looked at as before.
The list holds for this kind alone.

Edge cases. A null text is read as empty. Overlapping spans of different kinds are all given.
Repeated rows are scanned each. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.llm.text import let

# Fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ALLOWED = r"example|sample|placeholder|changeme|dummy|xxxx|0123456789|1234567890|abcdefgh|lorem"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
KINDS = ("assign", "access", "hex", "entropy")
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_-"

WINDOW = 20
SECRET_CHARS = 6
# A run is looked at from its start only, so a long one costs one pass.
CANDIDATE = (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{%d,}" % WINDOW)
LIMITS = {"hex": 3.0, "single": 3.6, "mixed": 3.8}
MASK = "[SECRET]"


def _running(lengths: Column, start: Column) -> Column:
    """Sums before each element, plus ``start``; for short arrays."""
    return F.aggregate(
        lengths, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")),
        lambda s: s["out"])


def running_sums(lengths: Column) -> Column:
    """Sums before each element, by blocks of the square root of the length."""
    def cut(a: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / width).cast("int") - 1),
                           lambda i: F.slice(a, i * width + 1, width))

    def join(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        return let(_running(totals, F.lit(0)), lambda offsets: F.flatten(
            F.transform(blocks, lambda b, i: _running(b, offsets[i]))))
    return let(lengths, lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(let(cut(a), join)))


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """Structs ``start, found, group`` of the leftmost non-overlapping matches.

    The text is split at the same matches; the lengths of pieces and matches add up to places.
    """
    def locate(pieces: Column, found: Column, inner: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(pieces[i]) + F.length(m))
        return let(running_sums(steps), lambda before: F.transform(found, lambda m, i: F.struct(
            (before[i] + F.length(pieces[i])).alias("start"), m.alias("found"), inner[i].alias("group"))))

    nothing = F.array().cast("array<struct<start:int,found:string,group:string>>")
    hits = let(F.split(text, pattern, -1), lambda p: let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda g: locate(p, m, g))))
    return F.when(text.rlike(pattern), hits).otherwise(nothing)


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                    end.alias("end"), F.lit(kind).alias("kind"))


def limit_of(run: Column) -> Column:
    """Entropy limit by the characters of a run."""
    return (F.when(run.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), F.lit(LIMITS["hex"]))
            .when(run.rlike(r"[a-z]") & run.rlike(r"[A-Z]"), F.lit(LIMITS["mixed"]))
            .otherwise(F.lit(LIMITS["single"])))


def dense_part(run: Column) -> Column:
    """Struct ``first, last``: from where to where windows of a run are over its limit; first
    is -1 if none is."""
    import math
    logs = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    size = len(ALPHABET)

    def put(counts: Column, at: Column, value: Column) -> Column:
        return F.concat(F.slice(counts, F.lit(1), at), F.array(value), F.slice(counts, at + 2, F.lit(size)))

    def scan(codes: Column, limit: Column, log_of: Column) -> Column:
        def come(s: Column, i: Column) -> Column:
            return let(codes[i], lambda a: let(s["counts"][a], lambda c: F.struct(
                put(s["counts"], a, c + 1).alias("counts"), (s["sum"] + log_of[c + 1] - log_of[c]).alias("sum"))))

        def go(s: Column, i: Column) -> Column:
            return let(codes[i - WINDOW], lambda a: let(s["counts"][a], lambda c: F.struct(
                put(s["counts"], a, c - 1).alias("counts"), (s["sum"] + log_of[c - 1] - log_of[c]).alias("sum"))))

        def step(s: Column, i: Column) -> Column:
            moved = let(come(s, i), lambda t: F.when(i >= WINDOW, go(t, i)).otherwise(t))

            def judge(t: Column) -> Column:
                over = (i >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - t["sum"] / WINDOW >= limit)
                return F.struct(
                    t["counts"].alias("counts"), t["sum"].alias("sum"),
                    F.when(over & (s["first"] < 0), i - WINDOW + 1).otherwise(s["first"]).alias("first"),
                    F.when(over, i + 1).otherwise(s["last"]).alias("last"))
            return let(moved, judge)

        start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("sum"),
                         F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step,
                           lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    letters = F.filter(F.split(run, ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return let(codes, lambda k: let(limit_of(run), lambda t: let(logs, lambda v: scan(k, t, v))))


def base_spans(text: Column) -> Column:
    assign = F.filter(places(text, ASSIGN, 2), lambda m: F.length(m["group"]) >= SECRET_CHARS)
    kinds = [("assign", assign), ("access", places(text, ACCESS)), ("hex", places(text, HEX))]

    def spans(kind: str, found: Column) -> Column:
        return F.transform(found, lambda m: _span(kind, m["start"], m["start"] + F.length(m["found"])))

    return F.concat(*[spans(kind, found) for kind, found in kinds])


def entropy_spans(text: Column) -> Column:
    runs = F.filter(places(text, CANDIDATE), lambda m: ~F.lower(m["found"]).rlike(UUID))

    def beside(run: Column, start: Column) -> Column:
        """What is left of a run without its harmless segments."""
        kept = F.transform(F.split(run, "(?<=[/-])"), lambda part: F.when(
            F.lower(part).rlike(ALLOWED), F.repeat(F.lit(" "), F.length(part))).otherwise(part))
        return let(F.array_join(kept, ""), lambda text: F.transform(places(text, CANDIDATE), lambda m: F.struct(
            m["found"].alias("found"), (start + m["start"]).alias("start"))))

    runs = F.flatten(F.transform(runs, lambda m: F.when(
        F.lower(m["found"]).rlike(ALLOWED), beside(m["found"], m["start"])).otherwise(
            F.array(F.struct(m["found"].alias("found"), m["start"].alias("start"))))))
    parts = F.transform(runs, lambda m: let(dense_part(m["found"]), lambda d: F.struct(
        (d["first"] >= 0).alias("ok"),
        _span("entropy", m["start"] + d["first"], m["start"] + d["last"]).alias("span"))))
    return F.transform(F.filter(parts, lambda x: x["ok"]), lambda x: x["span"])


def digest(spans: Column) -> Column:
    """``kind:start:end`` in order, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_more``: arrays of structs ``start, rank, end, kind``."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn("_base", base_spans(body)).withColumn("_more", entropy_spans(body))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and spans of every document."""
    found = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))

    def number(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(kind) for kind in KINDS[:3]], F.size("_more").cast("bigint").alias("n_entropy"),
        F.sha2(digest(F.col("_base")), 256).alias("base_sha256"),
        digest(F.concat("_base", "_more")).alias("spans"))


def redacted(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with every stretch that spans cover replaced by ``mask``."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        piece = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(s["out"], F.array(piece, F.lit(mask)))).otherwise(s["out"]).alias("out"))

    rest = F.aggregate(F.sort_array(spans), state, step, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(rest)


def redact(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; other columns as they are, null texts null."""
    names = docs.columns
    found = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"),
                        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    spans = found.withColumn("_spans", F.concat(base_spans(F.col("_text")), entropy_spans(F.col("_text"))))
    new = F.when(F.col(f"_row.`{text}`").isNotNull(), redacted(F.col("_text"), F.col("_spans"), mask))
    return spans.select(*[new.alias(n) if n == text else F.col(f"_row.`{n}`").alias(n) for n in names])
