"""Annotation and registry tables on shared storage.

A save appends a complete new version; readers take the newest complete one. A version is
complete when the mark that ends its write is there, so that a save that is under way, or
failed, is not seen. Its number is claimed first by a file that can be made only once, so
that two savers never write the same version.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_VERSION = "table_version="
_CLAIMS = "_claims"
_DONE = "_SUCCESS"


def _system(spark: SparkSession, path: str):
    """The file system of ``path``, and a function from a string to one of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _numbers(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """Numbers of the entries of a folder whose names are a prefix and a number; one per save."""
    files, make = _system(spark, path)
    if not files.exists(make(path)):
        return []
    names = [str(s.getPath().getName()) for s in files.listStatus(make(path))]
    return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit()]


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, in order."""
    path = path.rstrip("/")
    files, make = _system(spark, path)
    return sorted(n for n in _numbers(spark, path, _VERSION) if files.exists(make(f"{path}/{_VERSION}{n}/{_DONE}")))


def _claimed(spark: SparkSession, path: str) -> int:
    """A number of which no other saver has or gets the version."""
    files, make = _system(spark, path)
    number = max([0, *_numbers(spark, path, _VERSION), *_numbers(spark, f"{path}/{_CLAIMS}")]) + 1
    while True:
        claim = make(f"{path}/{_CLAIMS}/{number}")
        try:
            files.create(claim, False).close()
            return number
        except Py4JJavaError:
            if not files.exists(claim):
                raise
            number += 1


def save(df: DataFrame, path: str) -> int:
    """Write a new version and return its number."""
    path = path.rstrip("/")
    number = _claimed(df.sparkSession, path)
    (df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
     .mode("errorifexists").parquet(f"{path}/{_VERSION}{number}"))
    return number


def load(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """A version, by default the newest; an empty table when nothing was saved."""
    path, known = path.rstrip("/"), versions(spark, path)
    if version is not None and version not in known:
        raise LookupError(f"no version {version} in {path}")
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/{_VERSION}{version or known[-1]}")
