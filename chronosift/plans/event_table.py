"""The event table: a lazy DataFrame plus the state a DataFrame has no place for.

Rows keep all their columns; ``display`` says which ones a result shows. Order is
kept as a list of sort keys and only used where it matters (limit, dedup, paging,
export), so chained sorts cost nothing until then.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from typing import ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronosift.functions import timeparse
from chronosift.functions.jsonpath import json_cell, json_value
from chronosift.functions.predicates import Test, all_of
from chronosift.functions.text import (
    col, folded, is_blank, number, resolve, split_column_path, text)
from chronosift.session import pinned
from chronosift.sources.headers import SURPLUS
from chronosift.operators.ordinal import (
    SINGLE_TASK_ROWS, slice_rows, with_parquet_ordinal, with_position)


@dataclass(frozen=True)
class SortKey:
    """One sort key: a column, or ``column{json path}``."""
    spec: str
    descending: bool = False


@dataclass(frozen=True)
class OrderTerm:
    """One expression of the physical order."""
    value: Column
    descending: bool = False
    plain: bool = True

    def by(self, value: Column | None = None) -> Column:
        value = self.value if value is None else value
        return value.desc_nulls_last() if self.descending else value.asc_nulls_last()


@dataclass(frozen=True)
class EventTable:
    ROW_INDEX: ClassVar[str] = "_row_index"
    EVENT_MS: ClassVar[str] = "_event_ms"
    SURPLUS: ClassVar[str] = SURPLUS

    df: DataFrame
    columns: tuple[str, ...]
    display: tuple[str, ...]
    time_col: str | None = None
    file_key: str = ""
    ingest_zone: str = "UTC"
    display_zone: str = "UTC"
    zone_names: tuple[tuple[str, str], ...] = ()
    order: tuple[SortKey, ...] = ()
    sorted_by_user: bool = False
    after_ms: int | None = None
    before_ms: int | None = None
    # True while no row has been dropped: then a row's position in file order is its index.
    whole: bool = True

    # -- making one --------------------------------------------------------

    @classmethod
    def of(cls, df: DataFrame, *, row_index: str | None = None, time_col: str | None = None,
           file_key: str = "", ingest_zone: str | None = None,
           display_zone: str | None = None, zone_names: Mapping[str, str] | None = None) -> EventTable:
        """Wrap a DataFrame. ``row_index`` names a column that holds the 0-based row
        position; it becomes the row identity and leaves the header. ``zone_names`` says which
        offset (``+hh:mm``) an abbreviation after a text's time stands for; UTC and GMT are known."""
        ingest = timeparse.zone_id(ingest_zone)
        if row_index is not None and row_index != cls.ROW_INDEX:
            df = df.withColumnRenamed(row_index, cls.ROW_INDEX)
        if cls.ROW_INDEX not in df.columns:
            raise ValueError("an event table needs a row position column")
        header = tuple(c for c in df.columns if c not in (cls.ROW_INDEX, cls.EVENT_MS, cls.SURPLUS))
        chosen = timeparse.time_column(header, time_col)
        if cls.EVENT_MS not in df.columns:
            when, kind = F.lit(None).cast("bigint"), None
            if chosen is not None:
                kind = df.schema[chosen].dataType
                when = timeparse.millis(col(chosen), kind, ingest, _session_zone(df))
            if isinstance(kind, T.StringType):
                df = timeparse.with_text_millis(df, col(chosen), cls.EVENT_MS, ingest, zone_names)
            else:
                df = df.withColumn(cls.EVENT_MS, when)
        return cls(df=df, columns=header, display=header, time_col=chosen, file_key=file_key,
                   ingest_zone=ingest, display_zone=timeparse.zone_id(display_zone),
                   zone_names=tuple(sorted((zone_names or {}).items())))

    @classmethod
    def from_parquet(cls, spark, path: str, **options) -> EventTable:
        """Parquet files; the row position stored in the files is the row index."""
        return cls.of(with_parquet_ordinal(spark.read.parquet(path), cls.ROW_INDEX), **options)

    @property
    def session_zone(self) -> str:
        return _session_zone(self.df)

    def using_time(self, name: str) -> EventTable:
        """Choose another time column by name, any case."""
        return EventTable.of(
            self.df.drop(self.EVENT_MS), time_col=name, file_key=self.file_key,
            ingest_zone=self.ingest_zone, display_zone=self.display_zone, zone_names=dict(self.zone_names))

    def keeping(self, rows: DataFrame) -> EventTable:
        """The same table with only these of its rows."""
        return replace(self, df=rows, whole=False)

    # -- filters -----------------------------------------------------------

    def filter(self, *tests: Test, after=None, before=None,
               now: datetime | None = None) -> EventTable:
        """Rows that pass every test and lie inside the (inclusive) time bounds."""
        table = self
        if tests:
            table = table.keeping(table.df.filter(all_of(*tests)(table)))
        if after is not None or before is not None:
            table = table._bounded(
                None if after is None else timeparse.bound_millis(after, self.display_zone, now),
                None if before is None else timeparse.bound_millis(before, self.display_zone, now))
        return table

    def after(self, value, now: datetime | None = None) -> EventTable:
        return self.filter(after=value, now=now)

    def before(self, value, now: datetime | None = None) -> EventTable:
        return self.filter(before=value, now=now)

    def _bounded(self, after: int | None, before: int | None) -> EventTable:
        if self.time_col is None:
            return self
        table = replace(
            self,
            after_ms=self.after_ms if after is None else after,
            before_ms=self.before_ms if before is None else before)
        return table.keeping(table.df.filter(table._time_test(after, before)))

    def _time_test(self, after: int | None, before: int | None) -> Column:
        stored = timeparse.raw_bounds(
            col(self.time_col), self.df.schema[self.time_col].dataType, self.ingest_zone,
            after, before)
        when = col(self.EVENT_MS)
        exact = F.lit(True)
        if after is not None:
            exact = exact & (when >= after)
        if before is not None:
            exact = exact & (when <= before)
        if stored is None:
            return exact
        if isinstance(self.df.schema[self.time_col].dataType, T.TimestampNTZType) \
                and self.ingest_zone != "UTC":
            return stored & exact
        return stored

    def time_range(self, base: EventTable, start_ms: int, end_ms: int) -> EventTable:
        """A range brushed on the histogram, from the first bucket's start to the last
        bucket's start plus its width. It is applied to ``base``, the table before any
        bounds, so that it replaces an earlier pair; shown columns and order stay."""
        ranged = replace(base, after_ms=None, before_ms=None)._bounded(start_ms, end_ms)
        return replace(ranged, display=self.display, order=self.order,
                       sorted_by_user=self.sorted_by_user)

    # -- columns -----------------------------------------------------------

    def select(self, *names: str) -> EventTable:
        """Show these columns in this order. Unknown names are ignored; a repeated call
        narrows what is shown; hidden columns stay usable."""
        shown = [resolve(n, self.display) for n in names]
        kept = tuple(dict.fromkeys(n for n in shown if n is not None))
        return replace(self, display=kept) if kept else self

    def strip(self) -> EventTable:
        """Hide shown columns that are blank in all current rows (one aggregate)."""
        if not self.display:
            return self
        flags = [F.max(F.when(~is_blank(col(c)), 1).otherwise(0)).alias(f"c{i}")
                 for i, c in enumerate(self.display)]
        row = self.df.agg(F.count(F.lit(1)).alias("n"), *flags).first()
        if row["n"] == 0:
            return self
        return replace(self, display=tuple(
            c for i, c in enumerate(self.display) if row[f"c{i}"]))

    def time_first(self) -> EventTable:
        """The time column leads the shown columns."""
        if self.time_col not in self.display:
            return self
        rest = tuple(c for c in self.display if c != self.time_col)
        return replace(self, display=(self.time_col, *rest))

    # -- order -------------------------------------------------------------

    def sort(self, *keys: str | SortKey | tuple[str, bool]) -> EventTable:
        """Sort by columns or ``column{path}``; a tuple or SortKey gives the direction.
        Earlier sorts remain as tie-breakers. Unknown columns are ignored."""
        wanted = []
        for key in keys:
            key = key if isinstance(key, SortKey) else (
                SortKey(*key) if isinstance(key, tuple) else SortKey(key))
            if self._field(key.spec) is not None:
                wanted.append(key)
        if not wanted:
            return self
        return replace(self, order=(*wanted, *self.order), sorted_by_user=True)

    def _field(self, spec: str) -> tuple[str, str | None] | None:
        """(column, JSON path or None) of ``name`` or ``name{path}``."""
        column = resolve(spec, self.columns)
        if column is not None:
            return column, None
        name, path = split_column_path(spec)
        column = resolve(name, self.columns)
        return None if column is None else (column, path)

    def _is_text(self, key: SortKey) -> bool:
        """Whether a key holds text that may be numbers, words or blank."""
        column, path = self._field(key.spec)
        return path is not None or (column != self.time_col and isinstance(
            self.df.schema[column].dataType, T.StringType))

    def _valued(self) -> EventTable:
        """Text sort keys and their numbers as helper columns, so that they are read once."""
        texts, numbers = {}, {}
        for i, key in enumerate(self.order):
            if self._is_text(key):
                column, path = self._field(key.spec)
                texts[f"_v{i}"] = json_value(col(column), path) if path else text(col(column))
                numbers[f"_n{i}"] = number(F.col(f"_v{i}"))
        if not texts:
            return self
        return replace(self, df=self.df.withColumns(texts).withColumns(numbers))

    def _terms(self, i: int, key: SortKey) -> list[OrderTerm]:
        column, _ = self._field(key.spec)
        down = key.descending
        if not self._is_text(key):
            return [OrderTerm(col(self.EVENT_MS if column == self.time_col else column), down)]
        value, as_number = F.col(f"_v{i}"), F.col(f"_n{i}")
        # Numbers before text going up, after it going down; blanks last both ways.
        kind = (F.when(as_number.isNotNull(), 1 if down else 0)
                .when(is_blank(value), 2).otherwise(0 if down else 1))
        words = F.when(as_number.isNull() & ~is_blank(value), F.lower(value))
        return [OrderTerm(kind, plain=False), OrderTerm(as_number, down), OrderTerm(words, down, plain=False)]

    def order_terms(self) -> list[OrderTerm]:
        """The total order: sort keys, then the row position. On a ``_valued`` table."""
        terms = [term for i, key in enumerate(self.order) for term in self._terms(i, key)]
        return [*terms, OrderTerm(col(self.ROW_INDEX))]

    def keyed(self) -> tuple[DataFrame, list[Column], list[str]]:
        """Rows with their sort keys as columns, the order over them, and their names.

        A sort compares rows many times; keys that are columns are computed once.
        """
        table = self._valued()
        names, order, rows = [], [], table.df
        extra = {}
        for i, term in enumerate(table.order_terms()):
            if term.plain:
                order.append(term.by())
                continue
            name = f"_k{i}"
            extra[name] = term.value
            order.append(term.by(F.col(name)))
            names.append(name)
        if extra:
            rows = rows.withColumns(extra)
        helpers = [c for c in table.df.columns if c not in self.df.columns]
        return rows, order, [*names, *helpers]

    def limit(self, n: int) -> EventTable:
        """First ``n`` rows of the current order; a count below 1 changes nothing."""
        if n <= 0:
            return self
        return self.keeping(self._slice(0, n))

    def page(self, start: int, end: int) -> EventTable:
        """Rows ``[start, end)`` of the current order."""
        start = max(start, 0)
        if end <= start:
            return self.keeping(self.df.filter(F.lit(False)))
        return self.keeping(self._slice(start, end))

    def _slice(self, start: int, end: int) -> DataFrame:
        """A bounded top-k, or row indexes by position: then only sort keys and row indexes
        move before the rows asked for."""
        if self.whole and not self.order:
            return self.df.filter(col(self.ROW_INDEX).between(start, end - 1))
        if end <= SINGLE_TASK_ROWS:
            rows, order, helpers = self.keyed()
            return slice_rows(rows, order, start, end, SINGLE_TASK_ROWS).drop(*helpers)
        nth = self.positions(name="_nth").filter(F.col("_nth").between(start, end - 1))
        return self.df.join(nth.select(F.col("row_index").alias(self.ROW_INDEX)), self.ROW_INDEX, "left_semi")

    def positions(self, *carry: Column, name: str = "position", costly: bool = False) -> DataFrame:
        """``row_index``, its position in this result, and ``carry`` columns. Only the
        sort keys and the carried columns move through the shuffle.

        Range partitioning looks at its input twice. Computed sort keys, and carried
        columns said to be ``costly``, are therefore written down first.
        """
        if self.whole and not self.order:
            return self.df.select(col(self.ROW_INDEX).alias("row_index"), *carry,
                                  col(self.ROW_INDEX).alias(name))
        row_index = col(self.ROW_INDEX).alias("row_index")
        rows, order, helpers = self.keyed()
        kept = [self.ROW_INDEX, self.EVENT_MS, *helpers, *(
            c for c in (self._field(k.spec)[0] for k in self.order) if c not in helpers)]
        carried = [f"_c{i}" for i in range(len(carry))]
        narrow = rows.select(*(col(c) for c in dict.fromkeys(kept)),
                             *(c.alias(n) for c, n in zip(carry, carried)))
        if helpers or costly:
            narrow = pinned(narrow)
        # The carried columns keep the names they were given.
        names = self.df.select(*carry).columns if carry else []
        return with_position(narrow, order, "_position").select(
            row_index, *(F.col(c).alias(n) for c, n in zip(carried, names)),
            F.col("_position").alias(name))

    def position_of(self, row_index: int) -> int | None:
        """Position of one row in this result: a count of the rows before it."""
        table = self._valued()
        terms = table.order_terms()
        keys = F.struct(*(t.value.alias(f"k{i}") for i, t in enumerate(terms)))
        row = table.df.filter(col(self.ROW_INDEX) == row_index).select(keys.alias("k")).first()
        if row is None:
            return None
        before, equal = F.lit(False), F.lit(True)
        for i, term in enumerate(terms):
            kind = table.df.select(term.value).schema[0].dataType
            mine = F.lit(row["k"][i]).cast(kind)
            value = term.value
            if row["k"][i] is None:
                less = value.isNotNull()
            else:
                beyond = value > mine if term.descending else value < mine
                less = F.coalesce(beyond, F.lit(False))
            before = before | (equal & less)
            equal = equal & value.eqNullSafe(mine)
        return table.df.filter(before).count()

    # -- distinct ----------------------------------------------------------

    def dedup(self, *keys: str) -> EventTable:
        """First row in the current order per key; without usable keys, per shown row.

        The window only asks for rank 1, so each task keeps one row per key before
        the shuffle and a hot key costs no more than a rare one.
        """
        fields = [f for f in (self._field(k) for k in keys) if f is not None]
        fields = fields or [(c, None) for c in self.display]
        parts = []
        for column, path in fields:
            if path:
                parts.append(folded(json_value(col(column), path)))
            elif isinstance(self.df.schema[column].dataType, T.StringType):
                parts.append(folded(col(column)))
            else:
                parts.append(col(column))
        rows, order, helpers = self.keyed()
        window = Window.partitionBy(*parts).orderBy(*order)
        kept = (rows.withColumn("_rank", F.row_number().over(window))
                .filter(F.col("_rank") == 1).drop("_rank", *helpers))
        return self.keeping(kept)

    # -- results -----------------------------------------------------------

    def result(self, *, ordered: bool = True, sort_by_time: bool = False,
               descending: bool = False, format_time: bool = False,
               pattern: str = timeparse.DEFAULT_PATTERN,
               paths: Mapping[str, str] | None = None,
               keep: Sequence[str] = ()) -> DataFrame:
        """The shown columns. ``sort_by_time`` adds a time sort when no sort was asked
        for; it comes after any limit. ``paths`` shows columns through a JSON path.
        ``keep`` adds helper columns by name."""
        table = self
        if sort_by_time and not self.sorted_by_user and self.time_col is not None:
            table = self.sort((self.time_col, descending))
        rows = table.df
        if ordered:
            keyed, order, _ = table.keyed()
            rows = keyed.orderBy(*order)
        through = {resolve(name, table.columns): path for name, path in (paths or {}).items()}

        def cell(name: str) -> Column:
            if name in through:
                return json_cell(col(name), through[name]).alias(name)
            if format_time and name == table.time_col:
                return table.shown(name, pattern)
            return col(name)

        return rows.select(*map(cell, table.display), *(col(k) for k in keep))

    def shown(self, name: str, pattern: str = timeparse.DEFAULT_PATTERN) -> Column:
        """A cell as it is displayed: the time column in the display zone."""
        if name != self.time_col:
            return text(col(name)).alias(name)
        return timeparse.display_or_raw(
            col(name), col(self.EVENT_MS), self.display_zone, pattern,
            self.session_zone).alias(name)

    def total(self) -> int:
        return self.df.count()


def _session_zone(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone")
