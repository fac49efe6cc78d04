"""Column helpers for texts and words, shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words are the longest runs without these characters; Java, DuckDB and Python read it alike.
BLANK = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` reads it.

    A lambda that reads a computed column may have the computation copied into it and
    repeated for each element; a lambda variable can't be.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of ``text``; null for null."""
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("bigint")


def code_points(text: Column) -> Column:
    """Length in code points as long; 0 for null."""
    return F.coalesce(F.length(text), F.lit(0)).cast("bigint")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, UPPER, LOWER)


def hash_bits(text: Column, digits: int) -> Column:
    """The first hex ``digits`` (15 at most) of the MD5 as a long that is not negative."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")
