"""JSON values of files read in splits: values over several lines, several values a line.

A string can't hold a line break, so that between two lines only the depth of open brackets counts.
One pass finds by how much each split changes the depth and how low it gets; running sums over
the splits of a file then give the depth at which each begins, and tell whether the brackets of the file
match at all. Each task cuts its split into values at that depth. A value that leaves its split is
joined with the beginnings of the splits that it goes on in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronosift.operators.ordinal import file_path
from chronosift.sources.splits import at_home, few_splits, fixed_layout

STRING = re.compile(r'"(?:[^"\\]|\\.)*"')
BRACKET = re.compile(r"[{}\[\]]")
MARK = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],]')
WHITE = " \t\r\n﻿"
# How the values of a file are found: each line is one, roots one after another, or the items of one root array.
LINES, ROOTS, ITEMS = -1, 0, 1
COMPLETE, TAIL, LEAD = 0, 1, 2


def _depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: change of depth, least depth, brackets opened at the levels 0, -1, -2 ... below the
    start, whether a string stays open, and the first character."""
    names = ["_key", "_start", "_net", "_low", "_opened", "_bad", "_first"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.string()]
    split, done = None, []
    depth, low, opened, bad, first = 0, 0, [0], False, None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    for batch in batches:
        for line, key, start in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if (key, start) != split:
                if split:
                    done.append((*split, depth, low, opened, bad, first))
                split, depth, low, opened, bad, first = (key, start), 0, 0, [0], False, None
            if first is None:
                first = line.strip(WHITE)[:1] or None
            bare = STRING.sub("", line)
            bad = bad or '"' in bare
            for mark in BRACKET.findall(bare):
                if mark in "{[":
                    if depth <= 0:
                        opened[-depth] += 1
                    depth += 1
                else:
                    depth -= 1
                    if depth < low:
                        low = depth
                        opened.append(0)
        if done:
            yield packed(done)
            done = []
    if split:
        yield packed([(*split, depth, low, opened, bad, first)])


class Cutter:
    """Lines of one split to values."""

    def __init__(self, depth: int, mode: int):
        self.depth, self.mode = depth, mode
        self.base = max(mode, 0)
        self.leading = mode != LINES and depth > self.base
        self.held: list[str] = []

    def cut(self, line: str) -> Iterator[tuple[int, str]]:
        """Values that end in this line, each with its part."""
        if self.mode == LINES:
            if line.strip(WHITE):
                yield COMPLETE, line
            return
        if not self.depth and self.mode == ROOTS and line[:1] == "{" and BRACKET.findall(STRING.sub("", line)) == ["{", "}"]:
            if line.rstrip(WHITE)[-1] == "}":
                yield COMPLETE, line.rstrip(WHITE)
                return
        base, at = self.base, 0
        for mark in MARK.finditer(line):
            sign = mark[0][0]
            if sign in "{[":
                if self.depth == base:
                    yield from self._stray(line[at:mark.start()])
                    at = mark.start()
                elif self.depth < base:
                    at = mark.end()
                self.depth += 1
            elif sign in "}]":
                self.depth -= 1
                if self.depth == base:
                    self.held.append(line[at:mark.end()])
                    yield (LEAD if self.leading else COMPLETE), "\n".join(self.held)
                    self.held, self.leading, at = [], False, mark.end()
                elif self.depth < base:
                    yield from self._stray(line[at:mark.start()])
                    at = mark.end()
            elif sign == "," and self.depth == base == ITEMS:
                yield from self._stray(line[at:mark.start()])
                at = mark.end()
        if self.depth > base:
            self.held.append(line[at:])
        else:
            yield from self._stray(line[at:])

    @staticmethod
    def _stray(text: str) -> Iterator[tuple[int, str]]:
        if text.strip(WHITE):
            yield COMPLETE, text.strip(WHITE)

    def rest(self) -> Iterator[tuple[int, str]]:
        if self.held:
            yield (LEAD if self.leading else TAIL), "\n".join(self.held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to values: ``value, _key, _start, _seq`` (place in the split), ``_part``."""
    names = ["value", "_key", "_start", "_seq", "_part"]
    split, cutter, nth, out = None, None, 0, []

    def packed() -> pa.RecordBatch:
        n = len(out)
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.string()), *[pa.array(np.array([o[i] for o in out], np.int64).reshape(n)) for i in (1, 2, 3)],
             pa.array(np.array([o[4] for o in out], np.int32).reshape(n))], names=names)

    def add(found: Iterator[tuple[int, str]]) -> None:
        nonlocal nth
        for part, text in found:
            out.append((text, *split, nth, part))
            nth += part != LEAD

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for line, key, start, depth, mode in zip(*columns):
            if (key, start) != split:
                if cutter:
                    add(cutter.rest())
                if mode is None:
                    raise ValueError("a file was changed after it was opened")
                split, cutter, nth = (key, start), Cutter(depth, mode), 0
            add(cutter.cut(line))
        yield packed()
        out = []
    if cutter:
        add(cutter.rest())
        yield packed()


class Values:
    """``files``: ``_file, roots, first, matched`` of each file that isn't blank; ``values``: ``value, _file, _start, _seq``, a
    located read. Without ``items``, roots one after another; lines stand alone in a file whose brackets
    don't match. With ``items``, a file of one root array gives its items. All of it is found when asked for."""

    def __init__(self, spark: SparkSession, paths: list[str], items: bool = False):
        own = fixed_layout(spark)
        lines = at_home(spark, own.read.option("lineSep", "\n").text(paths).select(
            "value", F.xxhash64("_metadata.file_path").alias("_key"), F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_line")))
        names = at_home(spark, own.read.format("binaryFile").load(paths).select(
            F.xxhash64("_metadata.file_path").alias("_key"), file_path().alias("_file"))).groupBy("_key").agg(
            F.any_value("_file").alias("_file"))
        found = lines.select("value", "_key", "_start").mapInArrow(
            _depths, "_key long, _start long, _net long, _low long, _opened array<long>, _bad boolean, _first string").persist()
        place = Window.partitionBy("_key").orderBy("_start")
        depth = F.coalesce(F.sum("_net").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        splits = found.withColumn("_depth", depth)
        # Roots open where the depth is 0, which is as far below the start as the start is deep.
        roots = F.when((F.col("_depth") >= 0) & (F.col("_depth") < F.size("_opened")), F.get("_opened", F.col("_depth").cast("int"))).otherwise(0)
        told = splits.groupBy("_key").agg(
            ((F.sum("_net") == 0) & (F.min(F.col("_depth") + F.col("_low")) >= 0) & ~F.max("_bad")).alias("matched"),
            F.sum(roots).alias("roots"), F.min_by("_first", F.when(F.col("_first").isNotNull(), F.col("_start"))).alias("first"))
        one = F.lit(items) & (F.col("roots") == 1) & (F.col("first") == "[")
        modes = told.select("_key", F.when(~F.col("matched"), LINES).when(one, ITEMS).otherwise(ROOTS).alias("_mode"))
        base = F.greatest(F.col("_mode"), F.lit(0))
        after, least = F.col("_depth") + F.col("_net"), F.col("_depth") + F.col("_low")
        moded = splits.join(modes, "_key").select(
            "_key", "_start", "_depth", "_mode", ((F.col("_mode") >= 0) & (F.col("_depth") > base)).alias("_inside"),
            ((F.col("_mode") >= 0) & (after > base) & (least <= base)).alias("_leaves"),
            ((F.col("_mode") >= 0) & (after > base)).alias("_open"))
        moded = moded.withColumn("_began", F.last(F.when(F.col("_leaves"), F.col("_start")), ignorenulls=True).over(
            place.rowsBetween(Window.unboundedPreceding, -1)))
        small = few_splits(lines)
        sent = lambda some: F.broadcast(some) if small else some

        def cut(some: DataFrame, how: str) -> DataFrame:
            told = lines.join(sent(some), ["_key", "_start"], how)
            if not small:
                told = told.repartition("_key", "_start").sortWithinPartitions("_key", "_start", "_line")
            return told.select("value", "_key", "_start", "_depth", "_mode").mapInArrow(
                _cut, "value string, _key long, _start long, _seq long, _part int")

        whole = cut(moded, "left").filter(F.col("_part") == COMPLETE).drop("_part")
        across = moded.filter("_inside or _open")
        parts = cut(across, "inner").filter(F.col("_part") != COMPLETE).join(
            sent(across.select("_key", "_start", "_began")), ["_key", "_start"])
        owner = F.when(F.col("_part") == TAIL, F.col("_start")).otherwise(F.col("_began")).alias("_owner")
        joined = parts.groupBy("_key", owner).agg(
            F.sort_array(F.collect_list(F.struct("_start", "value"))).alias("pieces"),
            F.min(F.when(F.col("_part") == TAIL, F.col("_seq"))).alias("_seq")).select(
                F.array_join(F.transform("pieces", lambda p: p["value"]), "\n").alias("value"), "_key",
                F.col("_owner").alias("_start"), "_seq")
        named = F.broadcast(names) if small else names
        self.files = told.join(names, "_key").filter("first is not null").select("_file", "roots", "first", "matched")
        self.values = whole.unionByName(joined).join(named, "_key", "left").select("value", "_file", "_start", "_seq")
