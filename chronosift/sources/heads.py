"""The first record of many files, in parallel and without reading the rest.

Spark's text reader opens the files, so every file system and ending it knows will do. Large
files are not read beyond the first record. Only what Spark can't decompress is opened here.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import lzma
import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from chronosift.operators.ordinal import file_path

# Suffixes and leading bytes of compressed files.
SUFFIXES = {".gz": "gzip", ".bz2": "bzip2", ".xz": "xz"}
MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz"}
OPENERS = {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}

# Files up to this many bytes are read to their end, many by one task; a file is not cut below it.
SMALL_FILE = 4 << 20
SMALL_FILES = {"spark.sql.files.maxPartitionBytes": str(32 * SMALL_FILE),
               "spark.sql.files.openCostInBytes": str(SMALL_FILE)}
# A split this large is a whole file, and no two files share a task, which ends after the first record.
LARGE_FILES = {"spark.sql.files.maxPartitionBytes": str(1 << 50),
               "spark.sql.files.openCostInBytes": str(1 << 50),
               "spark.sql.execution.arrow.maxRecordsPerBatch": "16"}
# Cells may be as long as Python allows.
LONGEST_CELL = 2**31 - 1


class Head(NamedTuple):
    """First CSV record of a file (None for an empty one); ``streamed`` when Spark's readers
    can't decompress it: xz, or a compression that the name doesn't tell."""
    record: list[str] | None
    streamed: bool


def bare_path(path: str) -> str:
    """Without scheme and leading slashes, the same for all ways a path is printed."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", path).lstrip("/")


def open_bytes(path: str):
    """A file as a byte stream, for contents that no Spark reader takes."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        path = re.sub("^file:/(?!/)", "file:///", path)
        path = re.sub("^s3[an]://", "s3://", path)
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def skips_broken(spark: SparkSession) -> bool:
    """Whether broken files may be left out: Spark's own setting, off by default."""
    return spark.conf.get("spark.sql.files.ignoreCorruptFiles", "false").lower() == "true"


def _record(values: Iterator[bytes]) -> tuple[bytes, list[str] | None]:
    """First bytes and first record of a file's lines."""
    start: list[bytes] = []

    def lines() -> Iterator[str]:
        for value in values:
            if not start:
                start.append(value[:6])
            yield value.decode("utf-8", errors="replace") + "\n"

    try:
        record = next((r for r in csv.reader(lines()) if r), None)
    except csv.Error:
        if not start[0].startswith(tuple(MAGIC)):
            raise
        record = None
    return start[0], record


def _looked(one_file: bool):
    """Rows ``path, value``, file after file, to the head of each file; with ``one_file`` the
    rest of the input is not asked for."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LONGEST_CELL)
        rows = (row for batch in batches
                for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for path, group in groupby(rows, key=lambda row: row[0]):
            start, record = _record(value for _, value in group)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([start], pa.binary()),
                 pa.array([record], pa.list_(pa.string()))], names=["path", "start", "record"])
            if one_file:
                return
    return look


def _text_heads(spark: SparkSession, paths: list[str], small: bool) -> list[Row]:
    own = spark.newSession()
    for key, value in (SMALL_FILES if small else LARGE_FILES).items():
        own.conf.set(key, value)
    own.conf.set("spark.sql.files.ignoreCorruptFiles", str(skips_broken(spark)).lower())
    # Where files are cut all the same, the head is in the first split.
    lines = own.read.text(paths).filter(F.col("_metadata.file_block_start") == 0).select(
        file_path().alias("path"), F.col("value").cast("binary"))
    return lines.mapInArrow(_looked(not small), "path string, start binary, record array<string>").collect()


def _streamed_records(spark: SparkSession, paths: list[str]) -> dict[str, list[str] | None]:
    skip = skips_broken(spark)

    def first(path: str) -> list[str] | None:
        with open_bytes(path) as raw:
            start = raw.read(6)
            raw.seek(0)
            codec = next(codec for magic, codec in MAGIC.items() if start.startswith(magic))
            lines = io.TextIOWrapper(io.BufferedReader(OPENERS[codec](raw)), encoding="utf-8",
                                     errors="replace", newline="")
            return next((r for r in csv.reader(lines) if r), None)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(LONGEST_CELL)
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    rows.append((path, first(path)))
                except (EOFError, OSError, lzma.LZMAError):
                    if not skip:
                        raise
                    rows.append((path, None))
            yield pd.DataFrame(rows, columns=["path", "record"])

    listing = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return {r["path"]: r["record"]
            for r in listing.mapInPandas(look, "path string, record array<string>").collect()}


def first_records(spark: SparkSession, paths: list[str]) -> dict[str, Head]:
    """Head of each file. An unreadable file is an error unless
    ``spark.sql.files.ignoreCorruptFiles`` is set; then it counts as empty."""
    rows = []
    if len(paths) == 1:
        rows = _text_heads(spark, paths, small=False)
    else:
        sizes = spark.read.format("binaryFile").load(paths).select("path", F.col("length") <= SMALL_FILE).collect()
        for small in (True, False):
            if group := [path for path, fits in sizes if fits == small]:
                rows += _text_heads(spark, group, small)
    found = {bare_path(r["path"]): r for r in rows}
    heads: dict[str, Head] = {}
    for path in paths:
        row = found.get(bare_path(path)) or (next(iter(found.values()), None) if len(paths) == 1 else None)
        packed = row is not None and any(bytes(row["start"]).startswith(magic) for magic in MAGIC)
        heads[path] = Head(row["record"] if row is not None else None, packed)
    streamed = [path for path, head in heads.items() if head.streamed]
    if streamed:
        for path, record in _streamed_records(spark, streamed).items():
            heads[path] = Head(record, True)
    return heads
