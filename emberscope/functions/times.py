"""Time parsing, zone conversion and window starts.

Stored times are local wall times (``TIMESTAMP_NTZ``), so no result depends on
the session zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": DAY_SECONDS}
OFFSET_PATTERN = r"([+-])(\d{2}):?(\d{2})$"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
MONTH_NAMES = "(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)"
STAMP_PATTERN = rf"^[A-Za-z]{{3}} {MONTH_NAMES} (\d{{1,2}}) (\d{{2}}:\d{{2}}:\d{{2}}) ([+-]\d{{4}}) (\d{{4}})$"
NAMED_PATTERN = rf"^{MONTH_NAMES}\.? (\d{{1,2}}),? (\d{{4}})(?:,? (\d{{1,2}}:\d{{2}}(?::\d{{2}})?))?$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it; keeps generated code small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def as_iso(text: Column) -> Column:
    """Common ways to write a time, as ISO text; other text is unchanged.

    Read are ``2024/01/05 10:00``, ``20240105``, ``Jan 5, 2024 10:00``, ``Sun Jan 29 14:25:37 +0000 2023``
    and a closing ``UTC`` or ``GMT``.
    """
    return bound(F.regexp_replace(F.trim(text), r"\s*(?:UTC|GMT)$", ""), _as_iso)


def _as_iso(bare: Column) -> Column:
    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(bare, pattern, group)

    def date(pattern: str, year: int, month: int, day: int) -> Column:
        number = F.floor((F.instr(F.lit(MONTHS), F.initcap(part(pattern, month))) + 2) / 3)
        return F.concat_ws("-", part(pattern, year), F.lpad(number.cast("string"), 2, "0"), F.lpad(part(pattern, day), 2, "0"))

    offset = F.regexp_replace(part(STAMP_PATTERN, 4), r"(\d{2})$", ":$1")
    stamp = F.concat(date(STAMP_PATTERN, 5, 1, 2), F.lit(" "), part(STAMP_PATTERN, 3), offset)
    named = F.rtrim(F.concat(date(NAMED_PATTERN, 3, 1, 2), F.lit(" "), part(NAMED_PATTERN, 4)))
    return (
        F.when(bare.rlike(r"^\d{4}-"), bare)
        .when(bare.rlike(r"^\d{4}/"), F.regexp_replace(bare, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"))
        .when(bare.rlike(r"^\d{8}$"), F.regexp_replace(bare, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
        .when(bare.rlike(STAMP_PATTERN), stamp)
        .when(bare.rlike(NAMED_PATTERN), named)
        .otherwise(bare)
    )


def parse_utc(text: Column, strict: bool = False) -> Column:
    """Text to UTC wall time; ``...Z`` and naive text are UTC, offsets are applied.

    Unparsable text is null, or fails the job when ``strict``.
    """
    return bound(as_iso(text), lambda iso: _parsed(iso, strict))


def _parsed(text: Column, strict: bool) -> Column:
    dated = text.rlike(r"\d{1,2}:\d{2}")
    wall = text.cast("timestamp_ntz") if strict else text.try_cast("timestamp_ntz")
    sign = F.when(F.regexp_extract(text, OFFSET_PATTERN, 1) == "-", -1).otherwise(1)
    hours = F.coalesce(F.regexp_extract(text, OFFSET_PATTERN, 2).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.regexp_extract(text, OFFSET_PATTERN, 3).try_cast("int"), F.lit(0))
    shift = sign * (hours * 60 + minutes)
    shifted = F.timestamp_add("MINUTE", -shift, wall)
    return F.when(dated & text.rlike(r":\d{2}.*" + OFFSET_PATTERN), shifted).otherwise(wall)


def from_utc(utc_wall: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_wall)


def to_utc(local_wall: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local_wall)


def to_local(text: Column, zone: str = "Asia/Tokyo") -> Column:
    """ISO text to the wall time of ``zone``; unparsable text is null."""
    return from_utc(parse_utc(text), zone)


def format_with_offset(local_wall: Column, offset: str = "+09:00") -> Column:
    return F.concat(F.date_format(local_wall, "yyyy-MM-dd HH:mm:ss"), F.lit(offset))


def width_seconds(width: str) -> int:
    """Seconds of a width such as ``10 minutes`` or ``1 day``."""
    number, unit = width.split()
    return int(number) * UNIT_SECONDS[unit.rstrip("s")]


def bin_start(ts: Column, width: str = "1 hour") -> Column:
    """Start of the tumbling window holding ``ts``, for widths that divide a day; null for a null time."""
    if DAY_SECONDS % width_seconds(width):
        raise ValueError(f"{width} does not divide a day; use bin_start_from")
    return bin_start_from(ts, width, ts.cast("date").cast("timestamp_ntz"))


def bin_start_from(ts: Column, width: str, origin: Column) -> Column:
    """Start of the tumbling window holding ``ts``, counted from ``origin``."""
    step = width_seconds(width)
    passed = F.floor(F.timestamp_diff("SECOND", origin, ts) / step)
    return F.timestamp_add("SECOND", (passed * step).cast("int"), origin)


def hour_floor(ts: Column) -> Column:
    return bin_start(ts, "1 hour")


def interval_start(day: Column, hour: Column) -> Column:
    """Wall time from a date and an hour of day."""
    return F.timestamp_add("HOUR", hour, day.cast("date").cast("timestamp_ntz"))


def interval_end(day: Column, hour: Column, last_day: Column) -> Column:
    """End of a labelled period; an open end reaches 23:00 of the last day in the data."""
    return F.coalesce(interval_start(day, hour), interval_start(last_day, F.lit(23)))
