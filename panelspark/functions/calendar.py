"""Calendar and cyclic columns from a UTC timestamp. Monday is day 0."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The flagged period, inclusive; the end is midnight at the start of that day.
COVID_PERIOD = ("2020-03-01 00:00:00", "2020-12-31 00:00:00")


def basic(ts: Column) -> dict[str, Column]:
    return {
        "hour_of_day": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
    }


def _wave(prefix: str, k: int, turns: Column) -> dict[str, Column]:
    angle = turns * F.lit(2.0 * math.pi * k)
    return {f"sin_{prefix}_{k}": F.sin(angle), f"cos_{prefix}_{k}": F.cos(angle)}


def fourier(ts: Column) -> dict[str, Column]:
    """Two daily and three weekly harmonics."""
    hour = F.hour(ts)
    out: dict[str, Column] = {}
    for k in (1, 2):
        out |= _wave("hour", k, hour / 24)
    for k in (1, 2, 3):
        out |= _wave("week", k, (F.weekday(ts) * 24 + hour) / 168)
    return out


def annual(ts: Column) -> dict[str, Column]:
    """Two annual harmonics."""
    out: dict[str, Column] = {}
    for k in (1, 2):
        out |= _wave("year", k, F.dayofyear(ts) / F.lit(365.25))
    return out


def month_position(ts: Column) -> dict[str, Column]:
    day = F.day(ts)
    return {
        "day_of_month": day,
        "week_of_year": F.weekofyear(ts),
        "quarter": F.quarter(ts),
        "days_from_month_start": day - 1,
        "days_to_month_end": F.day(F.last_day(ts)) - day,
    }


def business_day(ts: Column, is_holiday: Column) -> Column:
    return ((F.weekday(ts) < 5) & (is_holiday == 0)).cast("int")


def in_period(ts: Column, start: str = COVID_PERIOD[0], end: str = COVID_PERIOD[1]) -> Column:
    """1 from ``start`` to ``end`` inclusive."""
    return ts.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")).cast("int")


def clock_change(ts: Column) -> Column:
    """1 on the days on which US clocks change: the second Sunday of March and the first of November, since 2007."""
    month, day = F.month(ts), F.day(ts)
    sunday = (F.weekday(ts) == 6) & (F.year(ts) >= 2007)
    return (sunday & (((month == 3) & day.between(8, 14)) | ((month == 11) & (day <= 7)))).cast("int")


def on_dates(ts: Column, dates: tuple[str, ...]) -> Column:
    """1 on any of the given days. The whole day counts."""
    return F.to_date(ts).isin(*[F.lit(d).cast("date") for d in dates]).cast("int")


def date_to_period(text: Column, hour: int) -> Column:
    """``YYYY-MM-DD`` with the hour appended; text that already has a time is kept."""
    t = F.trim(text)
    return F.when(F.contains(t, F.lit("T")), t).otherwise(F.concat(t, F.lit(f"T{hour:02d}")))
