"""Mixing sources to target weights by nested hash thresholds.

Every document has a hash of 60 bits. Its sizes are added up by source and by the first
12 bits; the bucket in which the source's budget runs out is cut by the next 12 bits, and
so on until one hash is left there. What is taken is what lies below that hash: no sort of
documents, one narrow pass over them for each level, and totals of buckets in between.

Edge cases. Null texts have size 0. A null source is a source of its own, after all others.
Rows with equal hash (repeated rows) at the edge each take the same part of their words, a
single document there is taken if that comes nearer to the target. Null ids are hashed as
``null``. An empty table gives an empty result. Other columns are ignored or kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosift.llm.text import hash_bits, word_count
from chronosift.operators.ordinal import small_side, with_position
from chronosift.session import pinned

BITS, LEVELS = 12, 5
# The plan has a row per source; beyond this many the join shuffles both sides.
BROADCAST_SOURCES = 10_000


def source_key(source: Column) -> Column:
    """Never null, in code point order, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def mix_hash(doc_id: Column, text: Column) -> Column:
    return hash_bits(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"),
                              F.md5(F.coalesce(text, F.lit("")))), BITS * LEVELS // 4)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             source: str = "source") -> DataFrame:
    """What the plan needs to know of each document, written once: the texts are read once."""
    return pinned(docs.select(
        F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("size"),
        source_key(F.col(source)).alias("_key"), mix_hash(F.col(doc_id), F.col(text)).alias("_hash")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0,
            share: float = 1.0) -> DataFrame:
    """``_key, source_size`` to those with ``target``.

    Sources get the weights in turn. What a target has above ``most`` times its source is
    shared again by weight among the rest until none is above.
    """
    nth = with_position(sizes, [F.col("_key")], "_nth")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = pinned(nth.withColumn(
        "_weight", F.element_at(cycle, (F.col("_nth") % len(weights) + 1).cast("int"))).drop("_nth"))
    cap = F.lit(float(most)) * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate = None
    while True:
        capped = F.lit(False) if rate is None else cap < F.lit(rate) * F.col("_weight")
        given, left = sources.agg(
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("_weight"))), F.lit(0.0))).first()
        new = (total * share - given) / left if left > 0 else (rate or 0.0)
        if rate is not None and new <= rate:
            break
        rate = new
    return sources.select("_key", "source_size",
                          F.least(cap, F.lit(rate) * F.col("_weight")).alias("target"))


def mix_plan(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0,
             share: float = 1.0) -> DataFrame:
    """A row per source: ``source_size``, ``target``, ``_whole`` (how often each document is
    taken) and the hash up to which documents are taken once more."""
    sizes = rows.groupBy("_key").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes, weights, most, share)
    whole = F.when(F.col("source_size") > 0,
                   F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    aims = pinned(aims.withColumn("_whole", whole).withColumn(
        "_need", F.col("target") - F.col("_whole") * F.col("source_size")))
    edges = aims.select("_key", F.lit(0).cast("bigint").alias("_prefix"), F.col("_need"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level)
        here = small_side(edges.select("_key", "_prefix"), BROADCAST_SOURCES)
        inside = rows.withColumn("_prefix", F.shiftright("_hash", shift)).join(here, ["_key", "_prefix"])
        bucket = F.shiftright("_hash", shift - BITS).alias("_bucket")
        sums = inside.groupBy("_key", bucket).agg(
            F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"),
            F.min("_hash").alias("_low"), F.max("_hash").alias("_high"))
        # At most 2 ** BITS rows of each source come together here.
        upto = Window.partitionBy("_key").orderBy("_bucket")
        runs = sums.join(edges.select("_key", "_need"), "_key").withColumn(
            "_upto", F.sum("_sum").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        over = runs.filter(F.col("_upto") > F.col("_need"))
        edges = pinned(over.groupBy("_key").agg(F.min_by(F.struct(
            F.col("_bucket").alias("_prefix"), (F.col("_need") - F.col("_upto") + F.col("_sum")).alias("_need"),
            "_sum", "_n", "_low", "_high"), "_bucket").alias("_e")).select("_key", "_e.*"))
        if edges.filter("_low < _high").limit(1).count() == 0:
            break
    edges = edges.select("_key", F.col("_low").alias("_edge"), F.col("_need").alias("_rest"),
                         F.col("_sum").alias("_edge_size"), F.col("_n").alias("_edge_n"))
    return aims.drop("_need").join(edges, "_key", "left")


def taken_words() -> Column:
    """Words taken of a row that has ``size``, ``_hash`` and the plan of its source."""
    size, rest = F.col("size"), F.col("_rest")
    at_edge = (F.when(F.col("_edge_n") > 1, F.floor(size * rest / F.greatest(F.col("_edge_size"), F.lit(1))))
               .when(2 * rest >= size, size).otherwise(F.lit(0)))
    more = (F.when(F.col("_hash") < F.col("_edge"), size)
            .when(F.col("_hash") == F.col("_edge"), at_edge).otherwise(F.lit(0)))
    return (F.col("_whole") * size + more).cast("bigint")


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan = pinned(plan)
    return rows.join(small_side(plan, BROADCAST_SOURCES), "_key", "left")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0,
        share: float = 1.0, doc_id: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    rows = measured(docs, doc_id, text, source)
    return with_plan(rows, mix_plan(rows, weights, most, share)).select(
        "doc_id", "size", "source_size", "target", taken_words().alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0,
                    share: float = 1.0, doc_id: str = "doc_id", text: str = "text",
                    source: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken. Of rows that are taken in part
    (repeated rows at the edge) those with half of their words or more are given whole."""
    names = docs.columns
    plan = mix_plan(measured(docs, doc_id, text, source), weights, most, share)
    whole = F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row")
    rows = docs.select(whole, source_key(F.col(source)).alias("_key"),
                       mix_hash(F.col(doc_id), F.col(text)).alias("_hash"),
                       word_count(F.col(text)).alias("size"))
    times = F.when(F.col("size") > 0, F.round(taken_words() / F.col("size"))).otherwise(F.lit(0)).cast("int")
    copies = with_plan(rows, plan).withColumn("_times", times).filter(F.col("_times") > 0)
    return copies.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
