"""The operators as queries over the given tables, with the SQL that answers the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.llm import (alignment, ann, conversations, decontamination, jaccard, langid, licenses, mixing, packing,
                            quality, secret_scan, sharding, urls)
from chronosift.llm.catalog_sql import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_block_join(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"))


@query
def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(table(spark, sf, "documents"))


@query
def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.report(table(spark, sf, "documents"))


@query
def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.place(table(spark, sf, "documents")).withColumn("grown_shard", F.col("grown_shard").cast("int"))


@query
def op6_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join(table(spark, sf, "documents"))


@query
def op7_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


@query
def op8_urls(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"))


@query
def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@query
def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated or given another role, by a hash of their place."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    drawn = rows.select("conv_id", "turn", *said, (F.crc32(F.encode(place, "UTF-8")) % 20).alias("draw"))
    text = (F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    times = F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1)
    return drawn.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("_time")).drop("_time")


@query
def op11_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return conversations.report(damaged(rows), ids=rows.select("conv_id"))


@query
def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.report(table(spark, sf, "documents"))


@query
def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(SQL)
