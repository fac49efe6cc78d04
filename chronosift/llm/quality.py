"""Quality rules with risk-controlled cutoffs.

Each rule gives a document a badness from 0 to 1, cut into bins. Labelled documents are the
holdout on which cutoffs are certified, stratum (language) by stratum: a cutoff may be used
if the exact binomial tail says that it rejects more than ``risk`` of the good documents only
with probability ``error / tests``. Tests of one rule and stratum go from the most lenient
cutoff to stricter ones and stop at the first that isn't certified, so they count as one;
``tests`` is the number of rules times strata (Bonferroni). A stratum with too few labels
gets no cutoff and loses no document by these rules.

Edge cases. A null text has no words and fails the base rule. Null languages are a stratum.
A document is good if all its labels are 1; null labels are ignored. Repeated rows are judged
each. Empty tables of documents or labels are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosift.llm.text import BLANK, code_points, let, words
from chronosift.operators.ordinal import small_side
from chronosift.session import pinned

SYMBOLS = r"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
RULES = ("symbols", "lines", "repeats", "shouting")
BINS, RISK, ERROR = 64, 0.02, 0.1
BROADCAST_STRATA = 10_000
INDEX_BITS = 20


def _covered(starts: Column) -> Column:
    """Words covered by 3-word windows at the given places, which are in order."""
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"])


def _window(w: Column, i: Column) -> Column:
    return F.struct(w[i], w[i + 1], w[i + 2])


def _repeats_by_value(w: Column) -> Column:
    """The windows themselves are sorted; for any length."""
    rows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
        _window(w, i).alias("w"), i.alias("i"))))

    def count(r: Column) -> Column:
        same = F.filter(r, lambda x, j: F.coalesce(F.get(r, j - 1)["w"] == x["w"], F.lit(False))
                        | F.coalesce(F.get(r, j + 1)["w"] == x["w"], F.lit(False)))
        return _covered(F.sort_array(F.transform(same, lambda x: x["i"])))
    return let(rows, count)


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more, from an array of words.

    Sorts longs made of a hash of the window and its place. If different windows meet in the
    hash, or places don't fit in, the windows themselves are sorted.
    """
    def top(x: Column) -> Column:
        return F.shiftright(x, INDEX_BITS)

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << INDEX_BITS) - 1).cast("bigint")).cast("int")

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def sorted_keys(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, INDEX_BITS).bitwiseOR(i.cast("bigint"))))

    def same(k: Column) -> Column:
        return F.filter(k, lambda x, j: F.coalesce(top(F.get(k, j - 1)) == top(x), F.lit(False))
                        | F.coalesce(top(F.get(k, j + 1)) == top(x), F.lit(False)))

    def count(s: Column) -> Column:
        mixed = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda j: (top(s[j]) == top(s[j - 1])) & (
            _window(w, place(s[j])) != _window(w, place(s[j - 1]))))
        return (F.when(F.size(s) < 2, F.lit(0)).when(mixed, _repeats_by_value(w))
                .otherwise(_covered(F.sort_array(F.transform(s, place)))))

    return (F.when(F.size(w) < 4, F.lit(0)).when(F.size(w) > 1 << INDEX_BITS, _repeats_by_value(w))
            .otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
                           .otherwise(let(let(sorted_keys(h), same), count)))))


def measures(text: Column) -> Column:
    """Struct of the counts of a text."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def count(w: Column, ln: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"), repeat_words(w).cast("bigint").alias("n_repeat_words"),
            F.size(ln).cast("bigint").alias("n_lines"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("bigint").alias("n_dup_lines"))

    return F.struct(
        let(words(body), lambda w: let(lines, lambda ln: count(w, ln))).alias("counted"),
        code_points(F.regexp_replace(body, f"{BLANK}+", "")).alias("word_chars"),
        code_points(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).alias("n_symbols"),
        code_points(F.regexp_replace(body, "[^A-Z]+", "")).alias("n_capitals"))


def _rate(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.least(F.lit(1.0), F.col(part) / F.col(whole))).otherwise(F.lit(0.0))


def bins() -> Column:
    """Bin of each rule, as an array of structs ``rule, bin``."""
    badness = (_rate("n_symbols", "n_words"), _rate("n_dup_lines", "n_lines"),
               _rate("n_repeat_words", "n_words"), _rate("n_capitals", "word_chars"))
    return F.array(*[F.struct(F.lit(rule).alias("rule"), F.floor(rate * BINS).cast("int").alias("bin"))
                     for rule, rate in zip(RULES, badness)])


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The counts of every document, written once; texts are read once."""
    rows = docs.select(F.col(doc_id).alias("doc_id"),
                       F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"),
                       measures(F.col(text)).alias("_m"))
    flat = rows.select("doc_id", "_stratum", "_m.counted.*", "_m.word_chars", "_m.n_symbols", "_m.n_capitals")
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    return pinned(flat.withColumn("base_failed", failed).withColumn("_bins", bins()))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exact up to rounding while k is below the mean; 1 above."""
    first = n * F.log1p(F.lit(-p))
    odds = p / (1 - p)

    def step(s: Column, i: Column) -> Column:
        ratio = (n - i + 1) / i * odds
        return F.struct((s["log"] + F.log(ratio)).alias("log"), (s["sum"] / ratio + 1).alias("sum"))

    upto = F.aggregate(F.sequence(F.lit(1).cast("bigint"), k),
                       F.struct(first.alias("log"), F.lit(1.0).alias("sum")), step,
                       lambda s: F.exp(s["log"]) * s["sum"])
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(upto)


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR,
            doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """``_stratum`` and the certified cutoff of each rule (null: none), from labelled documents."""
    good = (labels.filter(F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
            .agg(F.min(quality).alias("_good")).filter("_good = 1").select("doc_id"))
    held = rows.filter(~F.col("base_failed")).join(good, "doc_id").select("_stratum", F.explode("_bins").alias("_b"))
    counts = held.groupBy("_stratum", "_b.rule", "_b.bin").agg(F.count(F.lit(1)).alias("n"))
    nothing = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n"))
    # At most BINS + 2 rows of a rule and stratum come together.
    counts = pinned(counts.groupBy("_stratum", "rule").agg(F.collect_list(F.struct("bin", "n")).alias("h"))
                    .select("_stratum", "rule", F.explode(F.array_append("h", nothing)).alias("_b"))
                    .select("_stratum", "rule", "_b.bin", "_b.n"))
    tests = max(1, counts.select("_stratum", "rule").distinct().count())
    group = Window.partitionBy("_stratum", "rule")
    falling = group.orderBy(F.col("bin").desc(), F.col("n")).rowsBetween(Window.unboundedPreceding, 0)
    found = counts.select(
        "_stratum", "rule", (F.col("bin") + 1).alias("cut"), F.sum("n").over(group).alias("n"),
        (F.sum("n").over(falling) - F.col("n")).alias("k"), "bin", F.col("n").alias("_own"))
    # The row of an empty bin 0 and a real one may stand side by side; the stricter k is the larger.
    found = found.groupBy("_stratum", "rule", "cut", "n").agg(F.min("k").alias("k"))
    passed = found.filter(binomial_tail(F.col("k"), F.col("n"), risk) <= error / tests)
    best = passed.groupBy("_stratum", "rule").agg(F.min("cut").alias("cut"))
    return best.groupBy("_stratum").agg(*[
        F.max(F.when(F.col("rule") == rule, F.col("cut"))).alias(f"_cut_{rule}") for rule in RULES])


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR,
          doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Counts and verdict of every document, with the rules that rejected it."""
    rows = measured(docs, doc_id, text, stratum)
    cuts = pinned(cutoffs(rows, labels, risk, error))
    joined = rows.join(small_side(cuts, BROADCAST_STRATA), "_stratum", "left")
    broken = F.array_compact(F.array(*[
        F.when(F.col("_bins")[i]["bin"] >= F.col(f"_cut_{rule}"), F.lit(rule)) for i, rule in enumerate(RULES)]))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"), F.array_join(broken, ",").alias("rules"))
