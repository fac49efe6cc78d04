"""Row tests. A test is a function of the table it is applied to, so that the same
test object works on any header, and tests combine with ``all_of``, ``any_of`` and
``negate``. All text tests ignore case; a missing cell is ''.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronosift.functions.jsonpath import json_value
from chronosift.functions.text import col, folded, resolve, split_column_path, text, trimmed
from chronosift.functions.timeparse import time_equals

if TYPE_CHECKING:
    from chronosift.plans.event_table import EventTable

Test = Callable[["EventTable"], Column]


def _or(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def _and(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


# ---------------------------------------------------------------------------
# Free text over all cells
# ---------------------------------------------------------------------------

def _some_cell(table: EventTable, test: Callable[[Column], Column]) -> Column:
    """Whether a cell passes, those beyond the header included."""
    found = [test(col(c)) for c in table.columns]
    if table.SURPLUS in table.df.columns:
        found.append(F.coalesce(F.exists(F.col(table.SURPLUS), test), F.lit(False)))
    return _or(found)


def term(words: str) -> Test:
    """Some cell contains the words; a trailing ``*`` means starts with."""
    if words.endswith("*"):
        return starts(words[:-1])
    needle = words.lower()
    return lambda table: _some_cell(table, lambda c: F.lower(text(c)).contains(needle))


def phrase(words: str) -> Test:
    """Text in quotes: the quotes are removed, the rest is taken as it stands."""
    if len(words) >= 2 and words[0] == words[-1] and words[0] in "\"'":
        words = words[1:-1]
    needle = words.lower()
    return lambda table: _some_cell(table, lambda c: F.lower(text(c)).contains(needle))


def starts(prefix: str) -> Test:
    """Some cell starts with the prefix; an empty prefix asks for a cell with a value."""
    needle = prefix.lower()
    if not needle:
        return lambda table: _some_cell(table, lambda c: trimmed(c) != "")
    return lambda table: _some_cell(table, lambda c: folded(c).startswith(needle))


# ---------------------------------------------------------------------------
# One field, or the value of a JSON path in it: ``name`` or ``name{path}``
# ---------------------------------------------------------------------------

def _value(table: EventTable, field: str) -> tuple[str | None, Column | None]:
    """(column, value to test); the value is NULL when a path does not match."""
    column = resolve(field, table.columns)
    if column is not None:
        return column, trimmed(col(column))
    name, path = split_column_path(field)
    column = resolve(name, table.columns)
    if column is None:
        return None, None
    return column, json_value(col(column), path) if path else trimmed(col(column))


def _positive(field: str, check: Callable[[Column], Column]) -> Test:
    def test(table: EventTable) -> Column:
        _, value = _value(table, field)
        if value is None:
            return F.lit(False)
        return F.coalesce(check(F.lower(value)), F.lit(False))
    return test


def field_eq(field: str, value: str) -> Test:
    """``=``: equal, or a prefix with a trailing ``*``; on the time column a time."""
    def test(table: EventTable) -> Column:
        column, cell = _value(table, field)
        if cell is None:
            return F.lit(False)
        if column == table.time_col and resolve(field, table.columns):
            as_time = time_equals(col(table.EVENT_MS), value, table.display_zone,
                                  table.session_zone)
            if as_time is not None:
                return as_time
        if value.endswith("*"):
            return field_prefix(field, value[:-1])(table)
        wanted = value.lower()
        return F.coalesce(F.lower(cell) == wanted, F.lit(False))
    return test


def field_prefix(field: str, prefix: str) -> Test:
    """``=abc*``; with an empty prefix the field must have a value."""
    if prefix == "":
        return field_present(field)
    return _positive(field, lambda value: value.startswith(prefix.lower()))


def field_present(field: str) -> Test:
    """``=*``"""
    return _positive(field, lambda value: value != "")


def field_ne(field: str, value: str) -> Test:
    """``!=``; a trailing ``*`` means not this prefix. True for an unknown field."""
    return negate(field_eq(field, value))


def field_contains(field: str, part: str) -> Test:
    """``~``; no row for an unknown field."""
    return _positive(field, lambda value: value.contains(part.lower()))


def field_not_contains(field: str, part: str) -> Test:
    """``!~``; every row for an unknown field."""
    return negate(field_contains(field, part))


# ---------------------------------------------------------------------------
# Composition
# ---------------------------------------------------------------------------

def all_of(*tests: Test) -> Test:
    return lambda table: _and([test(table) for test in tests])


def any_of(*tests: Test) -> Test:
    return lambda table: _or([test(table) for test in tests])


def negate(test: Test) -> Test:
    return lambda table: ~test(table)
