"""JSON record files: an array of objects or of arrays at a path, or one value after
another. All cells are text; nested values stay JSON text."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronosift.functions.jsonpath import is_plain, json_part
from chronosift.operators.ordinal import file_path, small_side
from chronosift.session import pinned
from chronosift.sources.cells import named_rows
from chronosift.sources.headers import normal_names
from chronosift.sources.jsonsplits import Values

REJECTED = "_rejected"


def _documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file. A document has to fit in one cell; larger data belongs in
    line-delimited files, which are split."""
    return spark.read.text(paths, wholetext=True).select(F.col("value"), file_path().alias("_file"))


def _one_value(document: str) -> str | None:
    """The document as one JSON value: values written one after another, with any
    spacing, become an array. None when it is neither."""
    decoder, values, place = json.JSONDecoder(), [], 0
    document = document.removeprefix("\ufeff")
    while place < len(document):
        if document[place] in " \t\r\n":
            place += 1
            continue
        try:
            _, end = decoder.raw_decode(document, place)
        except ValueError:
            return None
        values.append(document[place:end])
        place = end
    if len(values) == 1:
        return values[0]
    return f"[{','.join(values)}]" if all(v[0] in "{[" for v in values) and values else None


@F.pandas_udf(T.StringType())
def one_value(documents: pd.Series) -> pd.Series:
    return documents.map(_one_value)


def _items(documents: DataFrame, jpath: str) -> DataFrame:
    """(file, shape, position, item) of the array at the path, items as JSON text. Each file
    has the shape of its own first item: ``arrays``, or ``objects`` if there are any; items of
    the other shape are skipped. A file that holds no JSON, or whose path gives no array of
    either, is one item, its text: ``broken`` or ``other``. Blank files and empty arrays have none."""
    whole = documents.select("_file", F.col("value").alias("_text"), one_value("value").alias("value"))
    found = whole.select("_file", "_text", F.col("value").isNull().alias("_broken"),
                         F.from_json(_at(jpath), "array<string>").alias("_found"))
    starts = lambda item, mark: F.coalesce(F.ltrim(item).startswith(mark), F.lit(False))
    of = lambda mark: F.filter("_found", lambda item: starts(item, mark))
    shape = (F.when(F.col("_broken"), "broken")
             .when(starts(F.get("_found", F.lit(0)), "["), "arrays")
             .when(F.size(of("{")) > 0, "objects").otherwise("other"))
    shaped = found.filter((F.trim("_text") != "") & F.coalesce(F.size("_found") != 0, F.lit(True))).select(
        "*", shape.alias("_shape"))
    items = (F.when(F.col("_shape") == "arrays", of("[")).when(F.col("_shape") == "objects", of("{"))
             .otherwise(F.array("_text")))
    return shaped.select("_file", "_shape", F.posexplode(items).alias("_pos", "item"))


def _root_items(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same for the root: items of a root array, or roots one after another, cut in splits. Only the files
    that have neither are read as wholes."""
    found = Values(spark, paths, items=True)
    values, files = pinned(found.values), pinned(found.files)
    mark = F.substring(F.col("value"), 1, 1)
    # A row for each file; all values of a file have the same key.
    shapes = pinned(values.groupBy("_file").agg(
        F.min_by(mark, F.struct("_start", "_seq")).alias("lead"), F.max(mark == "{").alias("some")).join(files, "_file").select(
        "_file", F.when(~F.col("matched"), "broken").when((F.col("roots") == 1) & (F.col("first") != "["), "other")
        .when(F.col("lead") == "[", "arrays").when(F.col("some"), "objects").otherwise("other").alias("_shape")))
    fits = F.when(F.col("_shape") == "arrays", (mark == "[") & F.from_json("value", "array<string>").isNotNull()).otherwise(mark == "{")
    inside = Window.partitionBy("_file", "_start").orderBy("_seq")
    kept = values.join(small_side(shapes.filter("_shape in ('arrays', 'objects')")), "_file").filter(fits).withColumn(
        "_nth", F.row_number().over(inside) - 1)
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("_file", "_start").count().select(
        "_file", "_start", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    items = kept.join(offsets, ["_file", "_start"]).select(
        "_file", "_shape", (F.col("_before") + F.col("_nth")).alias("_pos"), F.col("value").alias("item"))
    odd = shapes.filter("_shape in ('broken', 'other')")
    # A part of the file list that came in.
    left = [r[0] for r in odd.select("_file").collect()]
    if not left:
        return items
    whole = _documents(spark, left).join(odd, "_file").select(
        "_file", "_shape", F.lit(0).cast("bigint").alias("_pos"), F.col("value").alias("item"))
    return items.unionByName(whole)


def _at(jpath: str) -> Column:
    """The part of the document in ``value`` at the path; '$' is all of it."""
    if jpath.strip() == "$":
        return F.col("value")
    return F.get_json_object("value", jpath) if is_plain(jpath) else json_part(F.col("value"), jpath)


def _object(text: str) -> Column:
    """The keys and values of an object; of anything else, its text under ``_rejected``."""
    found = F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>"))
    return F.coalesce(found, F.create_map(F.lit(REJECTED), F.col(text)))


def spread_keys(maps: DataFrame) -> DataFrame:
    """One column per key of ``_by``. The distinct keys, the header of the result, are
    found by one aggregate; files come in path order, keys by name inside a file."""
    first = (maps.select("_file", F.explode(F.map_keys("_by")).alias("k"))
             .groupBy("k").agg(F.min("_file").alias("f")).orderBy("f", "k").collect())
    keys = [r["k"] for r in first]
    if not keys:
        raise ValueError("no records found")
    others = [c for c in maps.columns if c != "_by"]
    return maps.select(*others, *(
        F.coalesce(F.try_element_at("_by", F.lit(k)), F.lit("")).alias(n)
        for k, n in zip(keys, normal_names(keys))))


def _objects(items: DataFrame) -> DataFrame:
    """Objects as rows: the union of their keys, sorted by name; files without a shape as
    ``_rejected``. Columns: the keys, ``_file``, ``_pos``."""
    by = F.when(F.col("_shape") == "objects", _object("item")).otherwise(F.create_map(F.lit(REJECTED), F.col("item")))
    return spread_keys(pinned(items.select("_file", F.col("_pos").cast("bigint"), by.alias("_by"))))


def _arrays(items: DataFrame) -> DataFrame:
    """Arrays as rows: the first inner array of a file is its header."""
    return named_rows(pinned(items.select(
        "_file", F.col("_pos").cast("bigint"), F.from_json("item", "array<string>").alias("cells"))))


def read_records(spark: SparkSession, paths: list[str], jpath: str) -> DataFrame:
    """Objects or arrays, as the first item of each file says; files of both shapes are united by
    name. The text of a file without JSON, or without such an array at the path, stands in
    ``_rejected``. Items of another shape than their file's are no records. It is an error when the path gives no file an array."""
    items = pinned(_root_items(spark, paths) if jpath.strip() == "$" else _items(_documents(spark, paths), jpath))
    shapes = {r["_shape"]: r["first"] for r in items.groupBy("_shape").agg(F.min("_file").alias("first")).collect()}
    if not shapes.keys() & {"arrays", "objects", "broken"}:
        raise ValueError(f"the path {jpath!r} gives no array of objects or arrays")
    parts = []
    if "arrays" in shapes:
        parts.append((shapes["arrays"], _arrays(items.filter("_shape = 'arrays'"))))
    if shapes.keys() - {"arrays"}:
        first = min(f for shape, f in shapes.items() if shape != "arrays")
        parts.append((first, _objects(items.filter("_shape <> 'arrays'"))))
    parts = [rows for _, rows in sorted(parts, key=lambda p: p[0])]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_values(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Objects one after another, with any spacing and over any lines, as a located read with one
    column per key. Files are read in splits. What is no object is a row too, with its text in the column
    ``_rejected``; in a file whose brackets don't match, each line stands alone."""
    values = Values(spark, paths).values
    return spread_keys(values.select("_file", "_start", "_seq", _object("value").alias("_by")))


def preview(spark: SparkSession, path: str, jpath: str, n: int = 5) -> DataFrame:
    """First rows at a path; when it gives an object, its keys to choose from."""
    found = _at(jpath)
    look = _documents(spark, [path]).select(
        F.ltrim(found).startswith("{").alias("is_object"), F.json_object_keys(found).alias("k"))
    first = look.first()
    if first["is_object"]:
        return spark.createDataFrame([(k,) for k in first["k"]], "available_key string")
    rows = read_records(spark, [path], jpath)
    return rows.orderBy("_pos").limit(n if n > 0 else 5).drop("_file", "_pos")
