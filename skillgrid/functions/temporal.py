"""Calendar and forecast-time arithmetic on timestamps without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps of six hours; 25 lagged members around a centre; the epoch of time axes.
STEP_HOURS = 6
MEMBERS, CENTRE = 25, 12
EPOCH = "1940-01-01T12:00:00"

_UNIT_MICROS = {"microseconds": 1, "milliseconds": 1000, "seconds": 10**6, "minutes": 60 * 10**6, "hours": 3600 * 10**6, "days": 86400 * 10**6}


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def plus_hours(t: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours.cast("int"), t)


def hours_between(a: Column, b: Column) -> Column:
    """Whole hours from a to b, toward zero."""
    return F.timestamp_diff("HOUR", a, b)


def valid_time(init: Column, offset: Column | None = None, units: str | None = None, position: Column | None = None) -> Column:
    """Valid time of a step: an absolute time or an interval as it is, a number in `units`
    since the start, or, without a usable offset, the position i as 6 + 6 i hours."""
    if offset is not None and units == "datetime":
        return offset.cast("timestamp_ntz")
    if offset is not None and units == "timedelta":
        return init + offset
    if offset is not None and units in _UNIT_MICROS:
        return F.timestamp_add("MICROSECOND", (offset * _UNIT_MICROS[units]).cast("long"), init)
    if position is None:
        raise ValueError("a step needs an offset with known units, or a position")
    return plus_hours(init, STEP_HOURS + STEP_HOURS * position)


def unit_of(text: str) -> str | None:
    """The unit of an offset that an axis' text names: any with microsecond (or us), hour or
    day in it, in this order; None for all others."""
    text = text.strip().lower()
    if "microsecond" in text or text in ("us", "µs"):
        return "microseconds"
    return next((unit for unit in ("hours", "days") if unit[:-1] in text), None)


def cf_time(value: Column, units: str) -> Column:
    """Time of `value` in units such as "hours since 1940-01-01T12:00"."""
    unit, _, reference = units.partition(" since ")
    reference = reference.strip().replace("T", " ")
    if unit not in _UNIT_MICROS or not reference:
        raise ValueError(f"unknown time units: {units}")
    return F.timestamp_add("MICROSECOND", (value * _UNIT_MICROS[unit]).cast("long"), ntz(reference))


def lag_init(centre: Column, index: Column) -> Column:
    """Start of a lagged member: six hours apart, member 12 at the centre."""
    return plus_hours(centre, STEP_HOURS * (index - CENTRE))


def target_date(year: Column, lead_days: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(11), F.lit(1)), lead_days.cast("int"))


def steps_to(init: Column, target: Column) -> Column:
    return F.floor(hours_between(init, target) / STEP_HOURS).cast("long")


def epoch_index(t: Column, clamp: bool = True) -> Column:
    """Six-hourly index since the epoch, not under 0 if clamped."""
    i = F.floor(hours_between(ntz(EPOCH), t) / STEP_HOURS).cast("long")
    return F.greatest(F.lit(0).cast("long"), i) if clamp else i


def same_day(year: Column, month: Column, day: Column) -> Column:
    """That date, or February 28 where the year has no February 29."""
    exact = F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.coalesce(exact, F.make_date(year, month, F.lit(28)))


def six_hour_steps(year: int | Column) -> Column:
    """All six-hourly times of a year, leap days included."""
    y, zero = F.lit(year) if isinstance(year, int) else year, F.lit(0)
    first = F.make_timestamp_ntz(y, F.lit(1), F.lit(1), zero, zero, zero)
    last = F.make_timestamp_ntz(y, F.lit(12), F.lit(31), F.lit(24 - STEP_HOURS), zero, zero)
    return F.sequence(first, last, F.expr(f"interval {STEP_HOURS} hours"))
