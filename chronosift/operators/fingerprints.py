"""Content fingerprints of files and directories."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.session import pinned
from chronosift.sources.directory import glob_regex, listing
from chronosift.sources.heads import open_bytes

CHUNK = 8 << 20
# Contents up to here are hashed as a cell by Spark's own function, larger ones as a stream.
CELL = 256 << 20


def _digest(path: str) -> str:
    digest = hashlib.sha256()
    with open_bytes(path) as stream:
        while block := stream.read(CHUNK):
            digest.update(block)
    return digest.hexdigest()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = pa.array([_digest(p) for p in batch.column(0).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, hashes], names=[*batch.schema.names, "file_hash"])


def file_hashes(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``path``, the columns ``keep`` and ``file_hash``: SHA-256 of the content of every file of a ``listing``.
    A file that can't be read is an error."""
    names = ["path", *keep]
    within = files.filter(F.col("length") <= CELL).select(*names, F.sha2("content", 256).alias("file_hash"))
    larger = files.filter(F.col("length") > CELL).select(*names).repartition("path")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in larger.schema)
    return within.unionByName(larger.mapInArrow(_streamed, f"{kinds}, file_hash string"))


def _tree(files: DataFrame, *keys: str) -> DataFrame:
    """One hash per ``keys`` over ``relative_path`` and ``file_hash`` of files.

    A tree of hashes over the hash of each relative path, so that no task holds more than a
    65536th part of the files, or 256 hashes: first by 4 hex digits, then by 2, then all.
    """
    level = files.select(*keys, F.sha2("relative_path", 256).alias("mark"),
                         F.sha2(F.concat("file_hash", "relative_path"), 256).alias("hash"))
    for digits in (4, 2, 0):
        pairs = F.array_sort(F.collect_list(F.struct("mark", "hash")))
        level = level.groupBy(*keys, F.substring("mark", 1, digits).alias("mark")).agg(
            F.sha2(F.array_join(F.transform(pairs, lambda p: p["hash"]), ""), 256).alias("hash"))
    return level.select(*keys, F.col("hash").alias("file_hash"))


def directory_hash(spark: SparkSession, root: str, pattern: str, exclude: tuple[str, ...] = (),
                   max_files: int = 0) -> str | None:
    """One SHA-256 for content and relative path of all files; None when there are none."""
    files = listing(spark, root, pattern, exclude, max_files)
    row = _tree(file_hashes(files, ["relative_path"])).first()
    return row["file_hash"] if row else None


def directory_hashes(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """``path, file_pattern, file_hash`` of every directory below ``root``, itself included (as
    ``.``), as ``directory_hash`` gives it for each pattern. Directories without a match are
    left out; a file counts once for each directory above it."""
    files = listing(spark, root, "**")
    hashed = pinned(file_hashes(files, ["relative_path"]))
    parts = F.split("relative_path", "/")
    above = hashed.select("relative_path", "file_hash", F.explode(
        F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth"))
    inside = above.select(
        F.when(F.col("depth") == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")).alias("path"),
        F.array_join(F.slice(parts, F.col("depth") + 1, F.size(parts)), "/").alias("relative_path"), "file_hash")
    fits = F.array_compact(F.array(*[
        F.when(F.col("relative_path").rlike(glob_regex(p)), F.lit(p)) for p in sorted(set(patterns))]).cast("array<string>"))
    return _tree(inside.withColumn("file_pattern", F.explode(fits)), "path", "file_pattern")


def directory_changed(spark: SparkSession, root: str, pattern: str, stored: str | None,
                      exclude: tuple[str, ...] = (), max_files: int = 0) -> bool:
    """Against a stored hash: without one nothing has changed, without files it has."""
    if not stored:
        return False
    return directory_hash(spark, root, pattern, exclude, max_files) != stored
