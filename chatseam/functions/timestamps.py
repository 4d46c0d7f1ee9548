"""Timestamp parsing. Times are UTC; what cannot be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Above this a numeric time counts milliseconds, at or below it seconds.
MILLISECOND_THRESHOLD = 1e10

# Sixteen digits and more count microseconds.
MICROSECOND_THRESHOLD = 1e14

# Shape of the text -> patterns, the first that fits. They are tried only on text of
# their shape, because a failing parse costs far more than the test. Where day and month
# are both numbers the month comes first, unless that cannot be (14/02/2022); dots put
# the day first.
_TIME = r" \d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
_CLOCK = rf"({_TIME})?$"
_READ_CLOCK = "[ H:mm[:ss[.SSSSSSSSS]]]"
_HALF_DAY = r" \d{1,2}:\d{2}(:\d{2})? [AaPp][Mm]$"
_READ_HALF_DAY = " h:mm[:ss] a"
_SHAPES = (
    (r"^\d{8}$", ("yyyyMMdd",)),
    (r"^\d{8}T\d{6}(Z|[+-]\d{4})?$", ("yyyyMMdd'T'HHmmss[XX]",)),
    (r"^\d{4}/\d{1,2}/\d{1,2}" + _CLOCK, ("y/M/d" + _READ_CLOCK,)),
    (r"^\d{1,2}/\d{1,2}/\d{4}" + _CLOCK, ("M/d/y" + _READ_CLOCK, "d/M/y" + _READ_CLOCK)),
    (r"^\d{1,2}/\d{1,2}/\d{2}" + _CLOCK, ("M/d/yy" + _READ_CLOCK, "d/M/yy" + _READ_CLOCK)),
    (r"^\d{1,2}/\d{1,2}/\d{4}" + _HALF_DAY, ("M/d/y" + _READ_HALF_DAY, "d/M/y" + _READ_HALF_DAY)),
    (r"^\d{1,2}/\d{1,2}/\d{2}" + _HALF_DAY, ("M/d/yy" + _READ_HALF_DAY, "d/M/yy" + _READ_HALF_DAY)),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}" + _CLOCK, ("y.M.d" + _READ_CLOCK,)),
    (r"^\d{1,2}-\d{1,2}-\d{4}" + _CLOCK, ("M-d-y" + _READ_CLOCK, "d-M-y" + _READ_CLOCK)),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}" + _CLOCK, ("d.M.y" + _READ_CLOCK,)),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}:\d{2} [+-]\d{4}$", ("d MMM y H:mm:ss xx",)),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}" + _CLOCK, ("d MMM y" + _READ_CLOCK,)),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}" + _CLOCK, ("d MMMM y" + _READ_CLOCK,)),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}" + _CLOCK, ("MMM d, y" + _READ_CLOCK,)),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}" + _CLOCK, ("MMMM d, y" + _READ_CLOCK,)),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}" + _HALF_DAY, ("MMM d[,] y" + _READ_HALF_DAY,)),
    (r"^[A-Za-z]{4,9} \d{1,2},? \d{4}" + _HALF_DAY, ("MMMM d[,] y" + _READ_HALF_DAY,)),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}" + _CLOCK, ("MMM d y" + _READ_CLOCK,)),
    (r"^[A-Za-z]{3} \d{1,2} \d{1,2}:\d{2}:\d{2} \d{4}$", ("MMM d H:mm:ss y",)),
)
_ISO_SHAPE = r"^\d{4}(-\d|$)"
_NUMBER_SHAPE = r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"
# A bare year or a compact date is a calendar value, not an epoch.
_CALENDAR_SHAPE = r"^(\d{4}|(19|20)\d{6})$"
_WEEKDAY = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? +"
_UTC_NAME = r" (GMT|UTC|Z)$"


def parse_text_timestamp(text: Column) -> Column:
    """ISO forms with or without an offset, then the other known shapes."""
    text = F.trim(text)
    is_iso = text.rlike(_ISO_SHAPE)
    # The usual case is decided by one test and one cast.
    parsed = F.when(
        is_iso,
        F.coalesce(
            text.try_cast("timestamp"),
            _spaced_offset(text).try_cast("timestamp"),
            # A comma before the fraction of a second, and half days.
            F.when(text.contains(","), F.regexp_replace(text, r"(:\d{2}),(\d{1,9})", "$1.$2").try_cast("timestamp")),
            F.when(text.rlike(r"[AaPp][Mm]$"), F.try_to_timestamp(_spaced_half_day(text), F.lit("y-M-d" + _READ_HALF_DAY))),
        ),
    )
    other = F.regexp_replace(F.regexp_replace(_spaced_half_day(text), _WEEKDAY, ""), _UTC_NAME, " +0000")
    for shape, patterns in _SHAPES:
        parsed = parsed.when(other.rlike(shape), F.coalesce(*(F.try_to_timestamp(other, F.lit(p)) for p in patterns)))
    return parsed


def _spaced_half_day(text: Column) -> Column:
    """``10:00PM`` as ``10:00 PM``."""
    return F.regexp_replace(text, r"(\d)([AaPp][Mm])$", "$1 $2")


def _spaced_offset(text: Column) -> Column:
    """``... +0300`` as ``...+03:00``, and seconds where a time with an offset has none."""
    spaced = F.regexp_replace(text, r" ?([+-]\d{2}):?(\d{2})$", "$1:$2")
    return F.regexp_replace(spaced, r"([T ]\d{1,2}:\d{2})(Z|[+-]\d{2}:\d{2})$", "$1:00$2")


def from_epoch(number: Column, is_millis: Column) -> Column:
    """Seconds or milliseconds since 1970, sub-second parts kept, as a timestamp."""
    micros = F.round(number * F.when(is_millis, F.lit(1e3)).otherwise(F.lit(1e6)))
    # The calendar ends at year 9999; beyond it, or for NaN, there is no timestamp.
    in_range = micros.between(F.lit(-62135596800e6), F.lit(253402300799e6)) & ~F.isnan(micros)
    return F.when(in_range, F.timestamp_micros(micros.try_cast("bigint")))


def parse_timestamp(text: Column) -> Column:
    """Numbers are read as an epoch by their own magnitude, everything else as text."""
    trimmed = F.trim(text)
    number = trimmed.try_cast("double")
    is_epoch = trimmed.rlike(_NUMBER_SHAPE) & ~trimmed.rlike(_CALENDAR_SHAPE)
    micros = number > MICROSECOND_THRESHOLD
    return F.when(
        is_epoch, from_epoch(F.when(micros, number / 1000).otherwise(number), number > MILLISECOND_THRESHOLD)
    ).otherwise(parse_text_timestamp(text))
