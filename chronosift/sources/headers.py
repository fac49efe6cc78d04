"""Column names of files."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count, islice, product
from string import ascii_uppercase


def _letters() -> Iterable[str]:
    """A, B, … Z, AA, AB, …"""
    for size in count(1):
        for letters in product(ascii_uppercase, repeat=size):
            yield "".join(letters)


# Cells of a row beyond its header, as a list; free-text tests read them, results don't show them.
SURPLUS = "__surplus__"


def normal_names(header: list[str | None]) -> list[str]:
    """Blank names become Unnamed_A, Unnamed_B, … counted over blank names only; repeated
    names (in any case) get a number so that the first one keeps its name."""
    blanks = (f"Unnamed_{letters}" for letters in _letters())
    named = [h.removeprefix("﻿") if h and h.strip() else next(blanks) for h in header]
    seen: set[str] = set()
    unique = []
    for base in named:
        name = base
        for n in count(2):
            if name.lower() not in seen:
                break
            name = f"{base}_{n}"
        seen.add(name.lower())
        unique.append(name)
    return unique


def unnamed(width: int) -> list[str]:
    return [f"Unnamed_{letters}" for letters in islice(_letters(), width)]


def union_header(headers: Iterable[list[str]]) -> list[str]:
    """Names in order of first appearance."""
    return list(dict.fromkeys(name for header in headers for name in header))
