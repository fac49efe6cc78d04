"""Text view of cells: missing and blank are the same thing, case is ignored."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as blank around a cell.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0"

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def quoted(name: str) -> str:
    """A column name that may hold dots, blanks, brackets or backticks."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def text(value: Column) -> Column:
    """Cell text, with '' for a missing cell."""
    return F.coalesce(value.cast("string"), F.lit(""))


def trimmed(value: Column) -> Column:
    return F.btrim(text(value), F.lit(BLANKS))


def folded(value: Column) -> Column:
    """Trimmed lower-case text: what equality, prefix and dedup compare."""
    return F.lower(trimmed(value))


def is_blank(value: Column) -> Column:
    return trimmed(value) == ""


def number(value: Column) -> Column:
    """The cell as a double when it is plain decimal text, else NULL."""
    cell = trimmed(value)
    return F.when(cell.rlike(NUMBER), cell.try_cast("double"))


def resolve(name: str, header: list[str] | tuple[str, ...]) -> str | None:
    """Header entry for ``name``: exact first, then by trimmed name in any case."""
    if name in header:
        return name
    wanted = name.strip().lower()
    return next((h for h in header if h.strip().lower() == wanted), None)


_PATH_SUFFIX = re.compile(r"^(?P<column>[^{]*)\{(?P<path>.*)\}[^}]*$", re.DOTALL)


def split_column_path(spec: str) -> tuple[str, str | None]:
    """``name{path}`` as (name, path); anything else is a plain column name."""
    found = _PATH_SUFFIX.match(spec)
    if not found:
        return spec, None
    name, path = found["column"].strip(), found["path"].strip()
    return (name, path) if name and path else (spec, None)
