"""CSV files: every cell is text, the first record names the columns.

A record may span lines, and a split can begin inside a quoted cell. What a line does is a function
of the state before it (outside or inside quotes) to the state after it, and so is a whole split.
One light pass finds both images of each split and how many records begin in it; a running
composition over the splits of a file then tells in which state each of them begins. Each task
puts the lines of its split together with that, and only the record that leaves a split is joined
with the beginnings of the splits that it goes on in. Files of any size are read in splits.

A quote in a cell that doesn't begin with one is text. A quoted cell ends at a quote before a
comma or the end of a line; after any other single quote it goes on, without quotes, to the next comma.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronosift.operators.ordinal import file_path
from chronosift.sources.headers import SURPLUS, normal_names, unnamed
from chronosift.sources.heads import first_records
from chronosift.sources.splits import at_home, few_splits, fixed_layout, read_located, split_counts

SETTINGS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1",
            "maxColumns": "100000"}
GAP = "\x00\x1f\x00"
WHITE = " \t\n\x0b\f\r"
# A line of cells that are closed, or have no quotes.
CLOSED = re.compile(r'(?:"[^"]*"|[^",]*)(?:,(?:"[^"]*"|[^",]*))*')
# Parts of a split that a task gives out.
COMPLETE, TAIL, LEAD = 0, 1, 2


def record_cells(record: Column) -> Column:
    """Cells of one CSV record. Between quotes a comma is text, so quotes cut first: every
    other piece lies outside them."""
    pieces = F.transform(F.split(record, '"'), lambda piece, i: F.when(
        i % 2 == 0, F.replace(piece, F.lit(","), F.lit(GAP))).otherwise(piece))
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(F.split(F.array_join(pieces, '"'), GAP), lambda c: F.when(
        c.startswith('"') & c.endswith('"') & (F.length(c) > 1), inner(c)).otherwise(c))


def beyond(cells: Column, width: int) -> Column:
    """Cells after the first ``width``; null if there are none."""
    return F.when(F.size(cells) > width, F.slice(cells, width + 1, F.size(cells)))


def after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open after a line, given whether one was before it."""
    if not inside and CLOSED.fullmatch(line):
        return False
    at = 0
    while True:
        if not inside:
            if line[at:at + 1] == '"':
                at += 1
            else:
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
        inside = True
        at = line.find('"', at)
        if at < 0:
            return True
        following = line[at + 1:at + 2]
        if following == '"':
            at += 2
        elif not following:
            return False
        else:
            inside = False
            at = line.find(",", at + 1) + 1
            if not at:
                return False


def _runs(*keys: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows of equal keys."""
    columns = [np.asarray(k) for k in keys]
    cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if len(columns[0]) else []
    bounds = [0, *map(int, cuts), len(columns[0])]
    return ((a, b) for a, b in zip(bounds, bounds[1:]) if a < b)


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, for both states before it: the state after it and how many records begin."""
    names = ["_key", "_start", "_after0", "_after1", "_n0", "_n1"]
    split, ends, counts, done = None, [False, True], [0, 0], []

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)

    for batch in batches:
        keys, starts = batch.column(0), batch.column(1)
        for a, b in _runs(keys, starts):
            here = (keys[a].as_py(), starts[a].as_py())
            if here != split:
                if split:
                    done.append((*split, *map(int, ends), *counts))
                split, ends, counts = here, [False, True], [0, 0]
            filled = np.asarray(batch.column(3).slice(a, b - a))
            quoted = batch.column(2).slice(a, b - a)
            places = np.flatnonzero(np.asarray(quoted.is_valid())).tolist()
            lines = quoted.drop_null().to_pylist()
            whole = np.concatenate([[0], np.cumsum(filled)])
            for state in (0, 1):
                upto = 0
                for place, line in zip(places, lines):
                    if not ends[state]:
                        counts[state] += int(whole[place + 1] - whole[upto])
                    ends[state] = after(line, ends[state])
                    upto = place + 1
                if not ends[state]:
                    counts[state] += int(whole[-1] - whole[upto])
        if done:
            yield packed(done)
            done = []
    if split:
        yield packed([(*split, *map(int, ends), *counts)])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits to records: ``record, _key, _seq`` (place in the file), ``_part`` (COMPLETE, or the TAIL
    that leaves the split, or the LEAD that came into it), ``_start``."""
    names = ["record", "_key", "_seq", "_part", "_start"]
    split, inside, leading, nth, held = None, False, False, 0, []

    def packed(records: list | pa.Array, key: int, start: int, first: int, part: int) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [records if isinstance(records, pa.Array) else pa.array(records, pa.string()), pa.array(np.full(n, key, np.int64)),
             pa.array(np.arange(first, first + n, dtype=np.int64)), pa.array(np.full(n, part, np.int32)),
             pa.array(np.full(n, start, np.int64))], names=names)

    def left_over() -> Iterator[pa.RecordBatch]:
        if held:
            yield packed(["\n".join(held)], split[0], split[1], nth, LEAD if leading else TAIL)

    for batch in batches:
        keys, starts = batch.column(1), batch.column(2)
        for a, b in _runs(keys, starts):
            here = (keys[a].as_py(), starts[a].as_py())
            if here != split:
                yield from left_over()
                if batch.column(3)[a].as_py() is None:
                    raise ValueError("a file was changed after it was opened")
                split, held, inside = here, [], bool(batch.column(3)[a].as_py())
                leading, nth = inside, batch.column(4)[a].as_py()
            values = batch.column(0).slice(a, b - a)
            if not inside and not pc.any(pc.match_substring(values, '"')).as_py():
                records = values.filter(pc.not_equal(pc.utf8_trim(values, WHITE), ""))
                yield packed(records, *here, nth, COMPLETE)
                nth += len(records)
                continue
            records, first = [], nth
            for line in values.to_pylist():
                if not inside and '"' not in line:
                    if line.strip(WHITE):
                        records.append(line)
                    continue
                held.append(line)
                inside = after(line, inside)
                if not inside:
                    text, held = "\n".join(held), []
                    if leading:
                        leading = False
                        yield packed([text], *here, nth, LEAD)
                    else:
                        records.append(text)
            nth = first + len(records)
            yield packed(records, *here, first, COMPLETE)
    yield from left_over()


class Records:
    """Records of CSV files that share their columns, lazily: ``rows`` (``record, _file, _start, _seq``) and
    ``counts`` (records of each file). Nothing is written, and nothing read before a query needs it."""

    def __init__(self, spark: SparkSession, paths: list[str], header: bool):
        own = fixed_layout(spark)
        raw = own.read.option("lineSep", "\n").text(paths).select(
            F.rtrim(F.col("value"), F.lit("\r")).alias("value"), F.xxhash64("_metadata.file_path").alias("_key"),
            F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
        lines = at_home(spark, raw)
        files = at_home(spark, own.read.format("binaryFile").load(paths).select(
            F.xxhash64("_metadata.file_path").alias("_key"), file_path().alias("_file")))
        files = files.groupBy("_key").agg(F.any_value("_file").alias("_file"))
        quoted = F.when(F.col("value").contains('"'), F.col("value"))
        images = lines.select("_key", "_start", quoted, F.trim("value", F.lit(WHITE)) != "").mapInArrow(
            _images, "_key long, _start long, _after0 long, _after1 long, _n0 long, _n1 long").persist()
        splits = self._states(images)
        small = few_splits(lines)
        sent = lambda some: F.broadcast(some) if small else some
        assembled = self._assemble(lines.join(sent(splits), ["_key", "_start"], "left"), small)
        whole = assembled.filter(F.col("_part") == COMPLETE).select("record", "_key", "_seq")
        leaving = splits.filter("_inside = 1 or _after = 1")
        parts = self._assemble(lines.join(sent(leaving), ["_key", "_start"]), small).filter(F.col("_part") != COMPLETE)
        owner = F.when(F.col("_part") == TAIL, F.col("_start")).otherwise(F.col("_began")).alias("_owner")
        owned = parts.join(sent(leaving.select("_key", "_start", "_began")), ["_key", "_start"])
        joined = owned.groupBy("_key", owner).agg(
            F.sort_array(F.collect_list(F.struct("_start", "record"))).alias("pieces"),
            F.min(F.when(F.col("_part") == TAIL, F.col("_seq"))).alias("_seq")).select(
                F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record"), "_key", "_seq")
        rows = whole.unionByName(joined)
        skipped = int(header)
        if header:
            rows = rows.filter("_seq > 0")
        named = F.broadcast(files) if small else files
        self.rows = rows.join(named, "_key", "left").select("record", "_file", F.lit(0).cast("bigint").alias("_start"), "_seq")
        totals = splits.groupBy("_key").agg((F.sum("_n") - skipped).alias("_n"))
        self.counts = totals.join(files, "_key").select(
            "_file", F.lit(0).cast("bigint").alias("_start"), F.greatest("_n", F.lit(0)).alias("_n"),
            F.lit(skipped).cast("bigint").alias("_first"))

    @staticmethod
    def _states(images: DataFrame) -> DataFrame:
        """``_inside`` (state before a split), ``_after``, ``_n`` records that begin in it, ``_before`` that begin before
        it in the file, and ``_began``, the last split before it in which one begins. A split either fixes the
        state after it, keeps it or flips it: the state is the last fixed one, and the flips since."""
        place = Window.partitionBy("_key").orderBy("_start")
        earlier = place.rowsBetween(Window.unboundedPreceding, -1)
        upto = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        flip = F.when((F.col("_after0") == 1) & (F.col("_after1") == 0), 1).otherwise(0)
        flips = images.withColumn("_flips", F.sum(flip).over(upto))
        fixed = F.when(F.col("_after0") == F.col("_after1"), F.struct("_after0", "_flips"))
        last = flips.select(
            "*", F.last(fixed, ignorenulls=True).over(earlier).alias("_last"),
            F.coalesce(F.lag("_flips").over(place), F.lit(0)).alias("_so_far"))
        since = F.col("_so_far") - F.coalesce(F.col("_last._flips"), F.lit(0))
        inside = (F.coalesce(F.col("_last._after0"), F.lit(0)) + since) % 2
        told = last.withColumn("_inside", inside).select(
            "_key", "_start", "_inside", F.when(F.col("_inside") == 1, F.col("_after1")).otherwise(F.col("_after0")).alias("_after"),
            F.when(F.col("_inside") == 1, F.col("_n1")).otherwise(F.col("_n0")).alias("_n"))
        began = F.when(F.col("_n") > 0, F.col("_start"))
        return told.select("*", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                           F.last(began, ignorenulls=True).over(earlier).alias("_began"))

    @staticmethod
    def _assemble(lines: DataFrame, in_order: bool) -> DataFrame:
        if not in_order:
            lines = lines.repartition("_key", "_start").sortWithinPartitions("_key", "_start", "_line")
        return lines.select("value", "_key", "_start", "_inside", "_before").mapInArrow(
            _assembled, "record string, _key long, _seq long, _part int, _start long")


def read_group(spark: SparkSession, paths: list[str], names: list[str], header: bool,
               multiline: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Files that share their columns, as a located read, and its counts. Short rows are padded; what a row has
    beyond the header is in ``SURPLUS``. ``multiline=False`` says that no record spans lines, and saves the look."""
    if multiline is False:
        columns = ", ".join(f"c{i} string" for i in range(len(names)))
        read = lambda own: own.read.options(**SETTINGS).option("header", header).option(
            "columnNameOfCorruptRecord", "record").schema(f"{columns}, record string").csv(paths)
        rows = read_located(spark, read)
        counts, cells = split_counts(rows), [F.col(f"c{i}") for i in range(len(names))]
    else:
        found = Records(spark, paths, header)
        columns = ", ".join(f"c{i} string" for i in range(len(names)))
        rows, counts = found.rows.withColumn("_cells", F.from_csv("record", columns, SETTINGS)), found.counts
        cells = [F.col(f"_cells.c{i}") for i in range(len(names))]
    commas = F.length("record") - F.length(F.replace("record", F.lit(","), F.lit("")))
    surplus = F.when(commas >= len(names), beyond(record_cells(F.col("record")), len(names)))
    return rows.select(*[c.alias(n) for c, n in zip(cells, names)], "_file", "_start", "_seq", surplus.alias(SURPLUS)), counts


def read_csv(spark: SparkSession, path: str, no_header_row: bool = False,
             multiline: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """One CSV file as a located read, and its counts."""
    record = first_records(spark, [path])[path].record
    if record is None:
        raise ValueError(f"no readable header in {path}")
    names = unnamed(len(record)) if no_header_row else normal_names(record)
    return read_group(spark, [path], names, not no_header_row, multiline)
