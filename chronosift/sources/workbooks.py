"""XLSX workbooks: first sheet, every cell as text. One task per workbook."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from chronosift.sources.cells import SHAPE
from chronosift.sources.heads import open_bytes

BATCH = 5000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    strings = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, node in ElementTree.iterparse(part):
            if node.tag == _MAIN + "si":
                strings.append("".join(t.text or "" for t in node.iter(_MAIN + "t")))
                node.clear()
    return strings


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f".//{_MAIN}sheet")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(
        book.read("xl/_rels/workbook.xml.rels"))}
    target = targets[sheet.get(_REL)]
    return target.lstrip("/") if target.startswith("/") else "xl/" + target


def _column(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _text(cell, shared: list[str]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
    value = cell.findtext(_MAIN + "v") or ""
    if kind == "s" and value:
        return shared[int(value)]
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    return value


def sheet_rows(path: str) -> Iterator[list[str]]:
    """Rows of the first sheet, skipped rows as empty ones."""
    with open_bytes(path) as raw, zipfile.ZipFile(raw) as book:
        shared, expected = _shared(book), 1
        with book.open(_first_sheet(book)) as part:
            for _, node in ElementTree.iterparse(part):
                if node.tag != _MAIN + "row":
                    continue
                number = int(node.get("r") or expected)
                for _ in range(expected, number):
                    yield []
                cells: list[str] = []
                for cell in node.iter(_MAIN + "c"):
                    place = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells.extend([""] * (place - len(cells)))
                    cells.append(_text(cell, shared))
                yield cells
                expected = number + 1
                node.clear()


def read_cells(spark: SparkSession, paths: list[str]) -> DataFrame:
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                numbered = enumerate(row for row in sheet_rows(path) if row)
                while chunk := list(islice(numbered, BATCH)):
                    yield pd.DataFrame({"_file": path, "_pos": [n for n, _ in chunk],
                                        "cells": [row for _, row in chunk]})

    listing = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return listing.mapInPandas(unpack, SHAPE)
