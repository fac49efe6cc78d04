"""JSON path values of text cells, evaluated by the JVM variant functions.

Supported steps: ``.name``, ``['name']``, ``[n]`` (also from the end), ``[*]`` and ``.*``, slices
``[a:b]``, filters ``[?(@.name op value)]`` and ``[?(@.name)]``, and one descent ``..`` before any of
those that give several values. Other step kinds raise ``ValueError`` when the plan is built.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronosift.functions.text import text

_STEP = re.compile(
    r"(?P<deep>\.\.)|\.(?P<name>[^.\[\]*'\"\s]+)|\[(?P<index>-?\d+)\]|\[(?P<q>['\"])(?P<quoted>.*?)(?P=q)\]"
    r"|(?P<each>\[\*\]|\.\*)|\[(?P<start>-?\d*):(?P<end>-?\d*)\]"
    r"|\[\?\(?\s*@(?P<of>[^\s=!<>()]+)\s*(?:(?P<op>[=!]=|[<>]=?)\s*(?P<value>'[^']*'|\"[^\"]*\"|[^\s()'\"]+))?\s*\)?\]")


class Many(NamedTuple):
    """A step that may give several values."""
    kind: str
    args: tuple = ()


def _name(name: str, path: str) -> str:
    if '"' in name and "'" in name:
        raise ValueError(f"unsupported JSON path: {path!r}")
    quote = '"' if "'" in name else "'"
    return f"[{quote}{name}{quote}]"


def _steps(path: str) -> list[str | Many]:
    body = path.strip()
    body = body[1:] if body.startswith("$") else "." + body
    steps, position = [], 0
    while position < len(body):
        found = _STEP.match(body, position)
        if not found:
            raise ValueError(f"unsupported JSON path: {path!r}")
        position = found.end()
        if found["deep"]:
            if any(isinstance(s, Many) for s in steps) or position == len(body):
                raise ValueError(f"unsupported JSON path: {path!r}")
            steps.append(Many("deep"))
            # The second dot also begins the next step, unless that is in brackets.
            position -= body[position] != "["
        elif found["each"]:
            steps.append(Many("each"))
        elif found["start"] is not None:
            steps.append(Many("slice", tuple(int(v) if v else None for v in (found["start"], found["end"]))))
        elif found["of"]:
            steps.append(Many("test", (_plain(found["of"], path), found["op"], _literal(found["value"], path))))
        elif found["index"] is not None:
            index = int(found["index"])
            steps.append(f"[{index}]" if index >= 0 else Many("last", (index,)))
        else:
            steps.append(_name(found["name"] if found["name"] is not None else found["quoted"], path))
    return steps


def _plain(part: str, path: str) -> str:
    steps = _steps("$" + part)
    if any(isinstance(s, Many) for s in steps):
        raise ValueError(f"unsupported JSON path: {path!r}")
    return "$" + "".join(steps)


def _literal(value: str | None, path: str) -> object:
    if value is None or value[0] == "'":
        return value and value[1:-1]
    try:
        return json.loads(value)
    except ValueError:
        raise ValueError(f"unsupported JSON path: {path!r}") from None


def _segments(path: str) -> list[tuple[str, Many | None]]:
    """The path cut at its steps for several values: pairs of a plain path and such a step, or None."""
    segments, plain = [], "$"
    for step in _steps(path):
        if isinstance(step, Many):
            segments.append((plain, step))
            plain = "$"
        else:
            plain += step
    segments.append((plain, None))
    return segments


def is_plain(path: str) -> bool:
    """Whether the path has names, indexes and wildcards only."""
    return all(step is None or step.kind == "each" for _, step in _segments(path))


def _parsed(cell: Column) -> Column:
    return F.try_parse_json(text(cell))


def _at(variant: Column, path: str) -> Column:
    return variant if path == "$" else F.try_variant_get(variant, path, "variant")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _containers(documents: pd.Series) -> pd.Series:
    """A value and all objects and arrays in it, outer ones first, in document order."""
    def of(document: str | None) -> list[str]:
        found, todo = [], [json.loads(document)] if document else []
        while todo:
            value = todo.pop()
            if isinstance(value, (dict, list)):
                found.append(json.dumps(value, ensure_ascii=False))
                todo += reversed(list(value.values()) if isinstance(value, dict) else value)
        return found
    return documents.map(of)


def _holds(member: Column, plain: str, op: str | None, value: object) -> Column:
    """Whether what stands at the path in ``member`` compares so. Values of another type, or
    none, are unequal, and neither smaller nor larger."""
    found = F.try_variant_get(member, plain, "variant")
    if op is None:
        return found.isNotNull()
    kind = F.schema_of_variant(found)
    if value is None:
        same, own, other = F.is_variant_null(found), F.lit(0), 0
    elif isinstance(value, bool):
        same, own, other = kind == "BOOLEAN", F.try_variant_get(found, "$", "boolean"), value
    elif isinstance(value, (int, float)):
        same, own, other = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(found, "$", "double"), float(value)
    elif isinstance(value, str):
        same, own, other = kind == "STRING", F.try_variant_get(found, "$", "string"), value
    else:
        raise ValueError(f"unsupported value in a JSON path: {value!r}")
    equal = F.coalesce(same & (own == F.lit(other)), F.lit(False))
    less = F.coalesce(same & (own < F.lit(other)), F.lit(False))
    more = F.coalesce(same & (own > F.lit(other)), F.lit(False))
    return {"==": equal, "!=": ~equal, "<": less, "<=": less | equal, ">": more, ">=": more | equal}[op]


def _members(variant: Column, plain: str, step: Many) -> Column:
    nothing = F.array().cast("array<variant>")
    if step.kind == "deep":
        return F.transform(_containers(F.to_json(_at(variant, plain))), F.try_parse_json)
    listed = F.try_variant_get(variant, plain, "array<variant>")
    if step.kind in ("each", "test"):
        inner = F.coalesce(listed, F.map_values(F.try_variant_get(variant, plain, "map<string,variant>")), nothing)
        return inner if step.kind == "each" else F.filter(inner, lambda m: _holds(m, *step.args))
    listed = F.coalesce(listed, nothing)
    size = F.size(listed)
    if step.kind == "last":
        return F.array_compact(F.array(F.get(listed, size + step.args[0])))

    def place(value: int | None, default: Column) -> Column:
        if value is None:
            return default
        return F.least(size, F.greatest(F.lit(0), size + value if value < 0 else F.lit(value)))

    start, end = place(step.args[0], F.lit(0)), place(step.args[1], size)
    return F.slice(listed, start + 1, F.greatest(end - start, F.lit(0)))


def _matches(variant: Column, segments: list[tuple[str, Many | None]]) -> Column:
    """All matches as an array of variants, in document order."""
    plain, step = segments[0]
    if step is None:
        return F.array_compact(F.array(_at(variant, plain)))
    members = _members(variant, plain, step)
    rest = segments[1:]
    if rest == [("$", None)]:
        return members
    return F.flatten(F.transform(members, lambda member: _matches(member, rest)))


def json_part(cell: Column, path: str) -> Column:
    """JSON text of what a path gives: a single array as it is, else the array of all matches."""
    found = _matches(_parsed(cell), _segments(path))
    several = F.concat(F.lit("["), F.array_join(F.transform(found, lambda v: F.to_json(v)), ",", "null"), F.lit("]"))
    one = F.get(found, F.lit(0))
    single = (F.size(found) == 1) & F.startswith(F.schema_of_variant(one), F.lit("ARRAY"))
    return F.when(single, F.to_json(one)).when(F.size(found) > 0, several)


def json_value(cell: Column, path: str) -> Column:
    """Text of the first match. NULL when the cell is not JSON or nothing matches;
    '' for a JSON null; objects and arrays as JSON text."""
    segments = _segments(path)
    parsed = _parsed(cell)
    if len(segments) == 1:
        path = segments[0][0]
        # The common case, a value, is parsed once; only its absence is looked at again.
        return F.coalesce(F.try_variant_get(parsed, path, "string"),
                          F.when(F.is_variant_null(_at(parsed, path)), ""))
    found = F.get(_matches(parsed, segments), F.lit(0))
    return F.when(found.isNotNull(),
                  F.coalesce(F.try_variant_get(found, "$", "string"), F.lit("")))


def json_found(cell: Column, path: str) -> Column:
    """True when the path gives a match, a JSON null included."""
    return json_value(cell, path).isNotNull()


def json_cell(cell: Column, path: str) -> Column:
    """The cell replaced by its path result, for display and export: unchanged when
    it is not JSON, '' without a match, a JSON array when there are several."""
    if path.strip() in ("", "$"):
        return text(cell)
    segments = _segments(path)
    parsed = _parsed(cell)
    if len(segments) == 1:
        shown = F.coalesce(json_value(cell, path), F.lit(""))
    else:
        found = _matches(parsed, segments)
        single = F.coalesce(F.try_variant_get(F.get(found, F.lit(0)), "$", "string"), F.lit(""))
        several = F.concat(
            F.lit("["), F.array_join(F.transform(found, lambda v: F.to_json(v)), ",", "null"), F.lit("]"))
        shown = (F.when(F.size(found) == 0, F.lit(""))
                 .when(F.size(found) == 1, single).otherwise(several))
    return F.when(parsed.isNull(), text(cell)).otherwise(shown)
