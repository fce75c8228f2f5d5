"""Date expressions: periods, buckets and labels, working days, clock times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Period -> (start of its bucket, label of that start).
PERIODS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "hour": (lambda t: F.date_trunc("hour", t), lambda s: F.date_format(s, "dd MMM HH:mm")),
    "day": (lambda t: F.to_date(t), lambda s: F.date_format(s, "dd MMM yyyy")),
    "week": (lambda t: F.to_date(F.date_trunc("week", t)), lambda s: F.concat(F.lit("W/C "), F.date_format(s, "dd MMM yyyy"))),
    "month": (lambda t: F.to_date(F.date_trunc("month", t)), lambda s: F.date_format(s, "MMM yyyy")),
    "quarter": (lambda t: F.to_date(F.date_trunc("quarter", t)), lambda s: F.concat(F.lit("Q"), F.quarter(s).cast("string"), F.lit(" "), F.year(s).cast("string"))),
}


def period_bounds(anchor: Column, period: str) -> tuple[Column, Column]:
    """First and last day of the month or quarter that holds the anchor."""
    if period == "month":
        return F.trunc(anchor, "month"), F.last_day(anchor)
    if period == "quarter":
        start = F.trunc(anchor, "quarter")
        return start, F.last_day(F.add_months(start, 2))
    raise ValueError(f"unknown period {period!r}")


def weekdays(start: Column, end: Column) -> Column:
    """Days from Monday to Friday in [start, end], without building the days: whole weeks, then the rest."""
    days = F.datediff(end, start) + 1
    first = F.weekday(start)  # Monday is 0
    rest = days % 7
    over = F.greatest(F.lit(0), F.least(first + rest, F.lit(7)) - F.greatest(first, F.lit(5))) + F.greatest(F.lit(0), first + rest - 12)
    return F.when(days <= 0, 0).otherwise((F.floor(days / 7) * 5 + rest - over).cast("int"))


def weekdays_after(start: Column, end: Column) -> Column:
    """Days from Monday to Friday in (start, end]."""
    return weekdays(F.date_add(start, 1), end)


def hours_between(a: Column, b: Column) -> Column:
    """Hours from a to b, 2 decimals, at least 0."""
    seconds = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return F.greatest(F.lit(0.0), F.round(seconds / 3_600_000_000, 2))


def second_of_day(t: Column) -> Column:
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def is_late(first_in: Column, start_hour: int = 9, grace_minutes: int = 15) -> Column:
    return F.coalesce(second_of_day(first_in) > start_hour * 3600 + grace_minutes * 60, F.lit(False))


def clock(seconds: Column) -> Column:
    """HH:MM of seconds since midnight, cut to the minute."""
    whole = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d", F.floor(whole / 3600).cast("int"), F.floor(whole % 3600 / 60).cast("int"))


def local_to_utc(t: Column, offset_hours: float) -> Column:
    return t - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(offset_hours * 3600))
