"""A directory of files as one table: discovery, union of headers, source column."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.session import pinned
from chronosift.sources import cells, compressed, csvfiles
from chronosift.sources.headers import SURPLUS, normal_names, union_header, unnamed
from chronosift.sources.heads import first_records
from chronosift.sources.splits import split_counts, with_stable_ordinal

# Fixed values.
SOURCE_COLUMN = "__source_file__"


def bare(path: Column) -> Column:
    """A path without scheme and leading slashes, the same for all ways Spark prints it."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), "^/+", "")


def _bare_root(spark: SparkSession, root: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", full).lstrip("/").rstrip("/")


def relative(spark: SparkSession, root: str, path: Column) -> Column:
    return F.regexp_replace(bare(path), "^" + re.escape(_bare_root(spark, root)) + "/", "")


def glob_regex(pattern: str) -> str:
    """``*``, ``?``, ``**``, ``[…]`` and ``{a,b}`` as a regular expression."""
    shapes = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}
    depth, out = 0, []
    for token in re.findall(r"\*\*/|\*\*|\[[^\]]*\]|.", pattern, re.DOTALL):
        depth += (token == "{") - (token == "}")
        if token[0] == "[" and len(token) > 1:
            out.append(token.replace("[!", "[^", 1))
        elif token == "," and depth:
            out.append("|")
        else:
            out.append(shapes.get(token) or re.escape(token))
    return "^" + "".join(out) + "$"


def listing(spark: SparkSession, root: str, pattern: str, exclude: tuple[str, ...] = (),
            max_files: int = 0) -> DataFrame:
    """Matching files: path, relative path, size, content. Contents are read only
    where that column is used. Empty files are not listed.
    ``exclude`` globs look at the file name; ``max_files`` above 0 takes the first files only."""
    if not pattern:
        raise ValueError("a file pattern is required, such as **/*.csv")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", relative(spark, root, F.col("path")).alias("relative_path"), "length", "content"))
    files = files.filter(F.col("relative_path").rlike(glob_regex(pattern)))
    for glob in exclude:
        files = files.filter(~F.regexp_extract("path", "[^/]*$", 0).rlike(glob_regex(glob)))
    return files.orderBy("relative_path").limit(max_files) if max_files > 0 else files


def preview(spark: SparkSession, root: str, pattern: str, exclude: tuple[str, ...] = (),
            max_files: int = 0) -> tuple[DataFrame, list[str], int, int]:
    """Relative paths, union header, file count and total bytes."""
    files = listing(spark, root, pattern, exclude, max_files)
    totals = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).first()
    paths = [r["path"] for r in files.orderBy("relative_path").select("path").collect()]
    heads = first_records(spark, paths) if paths else {}
    header = union_header(normal_names(head.record) for head in heads.values() if head.record)
    return files.select("relative_path").orderBy("relative_path"), header, totals["n"], totals["bytes"] or 0


def read_csv_directory(spark: SparkSession, root: str, pattern: str, *,
                       exclude: tuple[str, ...] = (), max_files: int = 0,
                       no_header_row: bool = False, include_source: bool = False,
                       multiline: bool | None = None, row_index: str = "_row_index",
                       paths: list[str] | None = None) -> DataFrame:
    """CSV files of a directory, united by column name in order of first appearance:
    those of the pattern, or the given ``paths`` in this order.

    Only the file list and the headers come to the driver. Files with the same
    header are read together by one scan.
    """
    if paths is None:
        paths = [r["path"] for r in
                 listing(spark, root, pattern, exclude, max_files).orderBy("relative_path").select("path").collect()]
    if not paths:
        raise ValueError(f"no files match {pattern!r} in {root}")
    heads = first_records(spark, paths)
    headers: dict[str, list[str]] = {}
    by_header: dict[tuple[str, ...], list[str]] = defaultdict(list)
    streamed: list[str] = []
    for path in paths:
        head = heads[path]
        if head.record is None:
            continue
        headers[path] = unnamed(len(head.record)) if no_header_row else normal_names(head.record)
        if head.streamed:
            streamed.append(path)
        else:
            by_header[tuple(headers[path])].append(path)
    names = union_header(headers.values())
    reads = [csvfiles.read_group(spark, group, list(header), not no_header_row, multiline)
             for header, group in by_header.items()]
    if streamed:
        rows = (cells.named_rows(pinned(compressed.read_cells(spark, streamed)), no_header_row)
                .withColumnRenamed("_pos", "_seq").withColumn("_start", F.lit(0).cast("bigint")))
        reads.append((rows, split_counts(rows)))
    parts, counts = zip(*reads)
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = with_stable_ordinal(united, row_index, reduce(DataFrame.unionByName, counts)).withColumn(
        "_file", relative(spark, root, F.col("_file")))
    source = [F.col("_file").alias(SOURCE_COLUMN)] if include_source else []
    quoted = [F.col("`" + n.replace("`", "``") + "`") for n in names]
    return rows.select(*quoted, SURPLUS, *source, row_index)
