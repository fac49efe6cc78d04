"""Timestamps: text to epoch milliseconds, bounds, display and equality."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronosift.functions.text import text, trimmed

# The accepted shapes, in the order they are tried.
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_CLOCK = r"[0-9]{1,2}:[0-9]{2}:[0-9]{2}"
_FRACTION = r"[.,][0-9]+"
_OFFSET = r"(?:Z|[+-][0-9]{2}:[0-9]{2})"
RUNGS: dict[str, str] = {
    "epoch": r"^[+-]?[0-9]+$",
    "iso_offset": rf"^{_DATE}T{_CLOCK}(?:{_FRACTION})?{_OFFSET}$",
    "iso_compact_offset": rf"^{_DATE}T{_CLOCK}(?:{_FRACTION})?[+-][0-9]{{4}}$",
    "blank_offset": rf"^{_DATE} +{_CLOCK}(?:{_FRACTION})?{_OFFSET}$",
    "zone_name": rf"^{_DATE}(?:T{_CLOCK}[.,][0-9]{{1,3}}| +{_CLOCK}(?:{_FRACTION})?) +(?:UTC|GMT)$",
    "zoneless": rf"^{_DATE}(?:(?:T| +)(?:{_CLOCK}(?:{_FRACTION})?|[0-9]{{1,2}}:[0-9]{{2}}))?$",
    "day_first_12h": r"^[0-9]{2}/[0-9]{2}/[0-9]{4} +[0-9]{1,2}:[0-9]{2} *[ap]m$",
}
ISO = "|".join(RUNGS[n] for n in (
    "zoneless", "iso_offset", "iso_compact_offset", "blank_offset", "zone_name"))
ZONED = "(?:Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2})$"
EPOCH_MS_ABOVE = 1_000_000_000_000

# Column names that mark the time column, strongest first.
TIME_NAMES = ("@timestamp", "timestamp", "time")
TIME_NAME_PARTS = ("@timestamp", "timestamp", "datetime", "date", "time", "ts")

# Units of relative times, in seconds.
RELATIVE_UNITS: dict[str, int] = {
    **dict.fromkeys(("s", "sec", "secs", "second", "seconds"), 1),
    **dict.fromkeys(("m", "min", "mins", "minute", "minutes"), 60),
    **dict.fromkeys(("h", "hr", "hrs", "hour", "hours"), 3600),
    **dict.fromkeys(("d", "day", "days"), 86400),
    **dict.fromkeys(("w", "wk", "wks", "week", "weeks"), 7 * 86400),
    **dict.fromkeys(("mo", "mon", "month", "months"), 30 * 86400),
    **dict.fromkeys(("y", "yr", "yrs", "year", "years"), 365 * 86400),
}

DEFAULT_PATTERN = "yyyy-MM-dd HH:mm:ss"


def zone_id(name: str | None, default: str = "UTC") -> str:
    """A zone the JVM knows. Blank, ``Local`` and unknown names fall back to the
    default, which is UTC so that results never depend on the host."""
    wanted = (name or "").strip()
    if wanted.upper() == "UTC":
        return "UTC"
    return wanted if wanted in available_timezones() else default


def time_column(header: list[str] | tuple[str, ...], chosen: str | None = None) -> str | None:
    """The user's column when it exists, else the most likely one by name."""
    lowered = [h.strip().lower() for h in header]
    if chosen and chosen.strip().lower() in lowered:
        return header[lowered.index(chosen.strip().lower())]
    for name in TIME_NAMES:
        if name in lowered:
            return header[lowered.index(name)]
    for part in TIME_NAME_PARTS:
        for original, name in zip(header, lowered):
            if part in name:
                return original
    return None


def rung_of(value: Column) -> Column:
    """Name of the first shape that fits the text, or NULL."""
    cell = trimmed(value)
    return F.coalesce(*(F.when(cell.rlike(shape), F.lit(name))
                        for name, shape in RUNGS.items()))


def canonical(value: Column, zone_names: Mapping[str, str] | None = None) -> Column:
    """Trimmed text with single blanks and a point before fractions. The abbreviations of ``zone_names``
    (letters alone) are written as their offsets (``+hh:mm``) where a zone name may stand."""
    cell = trimmed(value)
    cell = F.translate(F.when(cell.contains("  "), F.regexp_replace(cell, " +", " ")).otherwise(cell), ",", ".")
    for name, offset in (zone_names or {}).items():
        if not re.fullmatch("[A-Za-z]+", name) or not re.fullmatch(_OFFSET, offset):
            raise ValueError(f"not a zone abbreviation and its offset: {name!r}, {offset!r}")
        shape = RUNGS["zone_name"].replace("(?:UTC|GMT)", name)
        cell = F.when(cell.rlike(shape), F.regexp_replace(cell, f" {name}$", offset)).otherwise(cell)
    return cell


def text_millis(value: Column, zone: str = "UTC", zone_names: Mapping[str, str] | None = None) -> Column:
    """Epoch milliseconds of a text cell, NULL when no shape fits."""
    return ladder(canonical(value, zone_names), zone)


def with_text_millis(df: DataFrame, value: Column, name: str, zone: str = "UTC",
                     zone_names: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with ``text_millis`` as a column. The canonical text is a column on the way:
    it is looked at many times, and small steps keep the generated code compilable."""
    return (df.withColumn("_canonical", canonical(value, zone_names))
            .withColumn(name, ladder(F.col("_canonical"), zone)).drop("_canonical"))


def ladder(cell: Column, zone: str = "UTC") -> Column:
    """Epoch milliseconds of a canonical cell.

    Each shape is guarded by its pattern, so the lenient string cast of the engine
    never sees anything the ladder would not take. A row costs at most three pattern
    checks and one cast.
    """
    count = cell.try_cast("bigint")
    epoch = F.try_multiply(count, F.when(count > EPOCH_MS_ABOVE, 1).otherwise(1000).cast("bigint"))
    size = F.length(cell)
    wall = F.concat(cell, F.when(size == 10, "T00:00:00Z").when(size <= 16, ":00Z").otherwise("Z"))
    zoned = cell.rlike(ZONED)
    if zone == "UTC":
        iso = F.unix_millis(F.when(zoned, cell).otherwise(wall).try_cast("timestamp"))
    else:
        iso = F.when(zoned, F.unix_millis(cell.try_cast("timestamp"))).otherwise(_local(wall, zone))
    return (F.when(cell.rlike(RUNGS["epoch"]), epoch)
            .when(cell.rlike(ISO), iso)
            .when(cell.rlike(RUNGS["day_first_12h"]), _day_first(cell, zone)))


def _local(utc_text: Column, zone: str) -> Column:
    """Wall clock of a zone, given as if it were UTC, to epoch ms."""
    instant = utc_text.try_cast("timestamp")
    return F.unix_millis(instant if zone == "UTC" else F.to_utc_timestamp(instant, zone))


def _day_first(cell: Column, zone: str) -> Column:
    hour12 = F.regexp_extract(cell, r" +([0-9]{1,2}):", 1).try_cast("int")
    hour = (F.when(cell.endswith("pm") & (hour12 < 12), hour12 + 12)
            .when(cell.endswith("am") & (hour12 == 12), 0).otherwise(hour12))
    iso = F.concat(F.substring(cell, 7, 4), F.lit("-"), F.substring(cell, 4, 2), F.lit("-"),
                   F.substring(cell, 1, 2), F.lit("T"), F.lpad(hour.cast("string"), 2, "0"),
                   F.regexp_extract(cell, r"(:[0-9]{2}) *[ap]m$", 1), F.lit(":00Z"))
    return F.when(hour12 <= 12, _local(iso, zone))


def millis(value: Column, data_type: T.DataType, zone: str = "UTC",
           session_zone: str = "UTC") -> Column:
    """Epoch milliseconds of a column of any type the sources give."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_millis(value)
    if isinstance(data_type, T.TimestampNTZType):
        if zone == session_zone:
            return F.unix_millis(value.cast("timestamp"))
        if session_zone == "UTC":
            return F.unix_millis(F.to_utc_timestamp(value.cast("timestamp"), zone))
        wall = F.convert_timezone(F.lit(zone), F.lit(session_zone), value)
        return F.unix_millis(wall.cast("timestamp"))
    if isinstance(data_type, T.DateType):
        return text_millis(value.cast("string"), zone)
    return text_millis(value, zone)


def raw_bounds(value: Column, data_type: T.DataType, zone: str, after: int | None,
               before: int | None) -> Column | None:
    """The time bounds on the stored column itself, so that they reach the scan.

    Exact for instants and for zone-less values in UTC. For other zones the
    bounds are widened by a day on each side; the exact test on epoch ms follows.
    """
    slack = 0
    if isinstance(data_type, T.TimestampNTZType):
        kind = "timestamp_ntz"
        if zone != "UTC":
            slack = 86_400_000
    elif isinstance(data_type, T.TimestampType):
        kind = "timestamp"
    else:
        return None

    def literal(ms: int) -> Column:
        moment = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)
        stamp = moment.strftime("%Y-%m-%d %H:%M:%S.%f")
        return F.lit(stamp + ("Z" if kind == "timestamp" else "")).cast(kind)

    tests = []
    if after is not None:
        tests.append(value >= literal(after - slack))
    if before is not None:
        tests.append(value < literal(before + slack + 1))
    return _all(tests)


def _all(tests: list[Column]) -> Column | None:
    result = None
    for test in tests:
        result = test if result is None else result & test
    return result


# ---------------------------------------------------------------------------
# Values given by the user, resolved to literals before a plan exists
# ---------------------------------------------------------------------------

def literal_millis(value: str, zone: str = "UTC") -> int | None:
    """The same ladder for one value the user typed."""
    cell = value.strip()
    if re.fullmatch(RUNGS["epoch"][1:-1], cell):
        count = int(cell)
        return count if count > EPOCH_MS_ABOVE else count * 1000
    for name in ("iso_offset", "iso_compact_offset", "blank_offset", "zone_name", "zoneless"):
        if re.match(RUNGS[name], cell):
            return _literal_iso(cell, zone)
    if re.match(RUNGS["day_first_12h"], cell):
        return _literal_day_first(cell, zone)
    return None


def _millis_of(moment: datetime) -> int:
    return (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)


def _literal_iso(cell: str, zone: str) -> int | None:
    parts = re.match(
        r"(\d{4})-(\d{2})-(\d{2})(?:(?:T| +)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?"
        r" *(Z|UTC|GMT|[+-]\d{2}:?\d{2})?$", cell)
    if not parts:
        return None
    year, month, day, hour, minute, second, fraction, offset = parts.groups()
    if offset is None:
        tz = ZoneInfo(zone)
    elif offset in ("Z", "UTC", "GMT"):
        tz = timezone.utc
    else:
        sign = -1 if offset[0] == "-" else 1
        tz = timezone(sign * timedelta(hours=int(offset[1:3]), minutes=int(offset[-2:])))
    try:
        moment = datetime(int(year), int(month), int(day), int(hour or 0), int(minute or 0),
                          int(second or 0), int((fraction or "0")[:3].ljust(3, "0")) * 1000,
                          tzinfo=tz)
    except ValueError:
        return None
    return _millis_of(moment)


def _literal_day_first(cell: str, zone: str) -> int | None:
    day, month, year, hour, minute, half = re.match(
        r"(\d{2})/(\d{2})/(\d{4}) +(\d{1,2}):(\d{2}) *([ap]m)$", cell).groups()
    if int(hour) > 12:
        return None
    hour24 = int(hour) % 12 + 12 if half == "pm" else int(hour) % 12
    try:
        moment = datetime(int(year), int(month), int(day), hour24, int(minute),
                          tzinfo=ZoneInfo(zone))
    except ValueError:
        return None
    return _millis_of(moment)


def bound_millis(value: str | int | datetime, zone: str = "UTC",
                 now: datetime | None = None) -> int:
    """A bound as epoch ms: a number or datetime, ``now``, an absolute time, or a
    span back from now such as ``15m``, ``2h ago`` or ``3 days``."""
    if isinstance(value, bool):
        raise TypeError("a time bound cannot be a bool")
    if isinstance(value, datetime):
        return _millis_of(value if value.tzinfo else value.replace(tzinfo=ZoneInfo(zone)))
    if isinstance(value, int):
        return value if value > EPOCH_MS_ABOVE else value * 1000
    moment = now or datetime.now(timezone.utc)
    phrase = value.strip().lower()
    if phrase == "now":
        return _millis_of(moment)
    absolute = literal_millis(value, zone)
    if absolute is not None:
        return absolute
    span = re.fullmatch(r"(\d+)\s*([a-z]*)(?:\s*ago)?", re.sub(r"\s*ago$", "", phrase))
    seconds = RELATIVE_UNITS.get(span[2] or "s") if span else None
    if seconds is None:
        raise ValueError(f"not a time: {value!r}")
    return _millis_of(moment - timedelta(seconds=int(span[1]) * seconds))


# ---------------------------------------------------------------------------
# Display and equality
# ---------------------------------------------------------------------------

def display_time(event_ms: Column, zone: str = "UTC", pattern: str = DEFAULT_PATTERN,
                 session_zone: str = "UTC") -> Column:
    """Epoch ms in the display zone. Tokens: yyyy yy MM dd HH mm ss SSS zzz."""
    instant = F.timestamp_millis(event_ms)
    wall = instant
    if zone != session_zone and session_zone == "UTC":
        wall = F.from_utc_timestamp(instant, zone)
    elif zone != session_zone:
        wall = F.convert_timezone(F.lit(session_zone), F.lit(zone),
                                  instant.cast("timestamp_ntz")).cast("timestamp")
    pattern = pattern.strip() or DEFAULT_PATTERN
    if "zzz" not in pattern:
        return F.date_format(wall, pattern)
    pieces = pattern.split("zzz")
    abbreviation = zone_abbreviation(event_ms, zone)
    parts: list[Column] = []
    for position, piece in enumerate(pieces):
        if position:
            parts.append(abbreviation)
        if piece:
            parts.append(F.date_format(wall, piece))
    return F.concat(*parts)


def zone_abbreviation(event_ms: Column, zone: str) -> Column:
    """Short zone name at that moment, from the zone's own transitions."""
    if zone == "UTC":
        return F.lit("UTC")
    # Transitions are rules of the zone, not data: a chain of half-year steps
    # over 1970-2037 collapsed to the moments where the name changes.
    info = ZoneInfo(zone)
    start = datetime(1970, 1, 1, tzinfo=timezone.utc)
    name = start.astimezone(info).tzname()
    changes = [(None, name)]
    step = start
    while step.year < 2038:
        following = step + timedelta(days=7)
        if following.astimezone(info).tzname() != name:
            low, high = step, following
            while high - low > timedelta(seconds=1):
                middle = low + (high - low) / 2
                middle = middle.replace(microsecond=0)
                if middle <= low:
                    break
                if middle.astimezone(info).tzname() == name:
                    low = middle
                else:
                    high = middle
            name = high.astimezone(info).tzname()
            changes.append((_millis_of(high), name))
        step = following
    moments = F.array(*(F.lit(ms).cast("bigint") for ms, _ in changes[1:])) if len(changes) > 1 else None
    names = F.array(*(F.lit(label) for _, label in changes))
    if moments is None:
        return F.lit(changes[0][1])
    passed = F.size(F.filter(moments, lambda m: m <= event_ms))
    return F.element_at(names, passed + 1)


def display_or_raw(value: Column, event_ms: Column, zone: str = "UTC",
                   pattern: str = DEFAULT_PATTERN, session_zone: str = "UTC") -> Column:
    """Formatted time, or the cell as it is when it did not parse."""
    return F.coalesce(display_time(event_ms, zone, pattern, session_zone), text(value))


_PARTIAL = re.compile(r"(\d{4}-\d{2}-\d{2})(?:[T ](\d{1,2})(?::(\d{2}))?)?")


def time_equals(event_ms: Column, value: str, zone: str = "UTC",
                session_zone: str = "UTC") -> Column | None:
    """Equality on the time column, or NULL object when the value is no time.

    A full timestamp compares exact milliseconds. A date, date and hour, date and
    minute, or anything with a trailing ``*`` is a prefix of the displayed time.
    Whole-unit prefixes become a range on epoch ms where the zone allows it.
    """
    wanted = value.strip()
    if not wanted:
        return None
    wildcard = wanted.endswith("*")
    wanted = wanted[:-1] if wildcard else wanted
    partial = _PARTIAL.fullmatch(wanted)
    exact = literal_millis(wanted, zone)
    if exact is not None and not wildcard and not partial:
        return F.coalesce(event_ms == exact, F.lit(False))
    if not (wildcard or partial):
        return None
    prefix = re.sub(r"^(\d{4}-\d{2}-\d{2})T", r"\1 ", wanted)
    window = _unit_range(prefix) if zone == "UTC" else None
    if window:
        low, high = window
        return F.coalesce((event_ms >= low) & (event_ms < high), F.lit(False))
    shown = display_time(event_ms, zone, DEFAULT_PATTERN, session_zone)
    return F.coalesce(F.lower(shown).startswith(prefix.lower()), F.lit(False))


def _unit_range(prefix: str) -> tuple[int, int] | None:
    """Half-open ms range of a whole day, hour, minute or second in UTC."""
    shapes = (("%Y-%m-%d", 10, timedelta(days=1)), ("%Y-%m-%d %H", 13, timedelta(hours=1)),
              ("%Y-%m-%d %H:%M", 16, timedelta(minutes=1)),
              ("%Y-%m-%d %H:%M:%S", 19, timedelta(seconds=1)))
    for layout, length, span in shapes:
        if len(prefix) != length:
            continue
        try:
            low = datetime.strptime(prefix, layout).replace(tzinfo=timezone.utc)
        except ValueError:
            return None
        return _millis_of(low), _millis_of(low + span)
    return None
