"""A training corpus from raw documents, as five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet
to the shared folder and reads it back for the next one. All but the last keep the columns of
documents.

* ``language``: documents without a language (no letter, no text) go, and those whose cosine
  with no language is above the noise between random vectors (``langid.noise``). Of texts under
  ``SHORT`` characters, which have low cosines, those above 0 stay.
* ``near_duplicates``: of texts linked by similarity of 0.8 or more, directly or through
  others, the one of the smallest id stays.
* ``secrets``: what a secret covers is replaced by a mask; no document goes.
* ``mix``: documents are left out or repeated so that sources come near their targets.
* ``pack``: token sequences, one row per piece.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns are
treated as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.llm import jaccard, langid, mixing, packing, secret_scan
from chronosift.session import pinned

# Texts of fewer characters have too few trigrams to rise above the noise.
SHORT = 64


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.prototypes(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.predict_rows(docs, model)
    least = F.when(F.length(F.col("_row.text")) < SHORT, 0.0).otherwise(langid.noise(model))
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > least))
    return kept.select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.first_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets),
    ("mix", mix), ("pack", pack)]

# Profiles, similarity joins and tokenizers are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = pinned(stage(spark, docs, sf_dir))
    return docs
