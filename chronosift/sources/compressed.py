"""Compressed input the text readers cannot open by themselves: xz, and files whose
compression only shows in their first bytes. One task per file, read as a stream. A broken
tail is an error; with ``spark.sql.files.ignoreCorruptFiles`` the readable part is kept."""

from __future__ import annotations

import csv
import io
import lzma
import zlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from chronosift.sources.cells import SHAPE
from chronosift.sources.heads import LONGEST_CELL, MAGIC, OPENERS, open_bytes, skips_broken

BATCH = 5000


def records(path: str, skip: bool = False) -> Iterator[list[str]]:
    csv.field_size_limit(LONGEST_CELL)
    with open_bytes(path) as raw:
        start = raw.read(6)
        raw.seek(0)
        codec = next((c for magic, c in MAGIC.items() if start.startswith(magic)), "")
        stream = OPENERS[codec](raw) if codec else raw
        lines = io.TextIOWrapper(io.BufferedReader(stream), encoding="utf-8", errors="replace",
                                 newline="")
        try:
            yield from (record for record in csv.reader(lines) if record)
        except (EOFError, OSError, lzma.LZMAError, zlib.error):
            if not skip:
                raise


def read_cells(spark: SparkSession, paths: list[str]) -> DataFrame:
    skip = skips_broken(spark)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                numbered = enumerate(records(path, skip))
                while chunk := list(islice(numbered, BATCH)):
                    yield pd.DataFrame(
                        {"_file": path, "_pos": [n for n, _ in chunk],
                         "cells": [record for _, record in chunk]})

    listing = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return listing.mapInPandas(unpack, SHAPE)
