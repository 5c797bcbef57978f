"""US federal holidays by rule, holiday periods and distances as a calendar table.

The dimension is generated from years with built-in date functions. Distances do not need a
date-by-holiday join: every period is spread over the dates it can be nearest to, and one
aggregate per date keeps the smallest distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.session import materialize, small, stored

# Distance when no other period is near, and how far a period is spread.
FAR = 365

# Holidays on a fixed day (name, month, day, first year).
FIXED_DAYS = (
    ("New Year's Day", 1, 1, 1870),
    ("Juneteenth National Independence Day", 6, 19, 2021),
    ("Independence Day", 7, 4, 1870),
    ("Veterans Day", 11, 11, 1978),
    ("Christmas Day", 12, 25, 1870),
)
# Holidays on the n-th weekday of a month (name, month, Spark day name, n, first year); n = -1 is the last.
NTH_DAYS = (
    ("Martin Luther King Jr. Day", 1, "MON", 3, 1986),
    ("Washington's Birthday", 2, "MON", 3, 1971),
    ("Memorial Day", 5, "MON", -1, 1971),
    ("Labor Day", 9, "MON", 1, 1894),
    ("Columbus Day", 10, "MON", 2, 1971),
    ("Thanksgiving Day", 11, "THU", 4, 1942),
)
# Parts of names that mark a major holiday.
MAJOR_NAMES = (
    "New Year", "Memorial Day", "Independence Day", "Labor Day", "Thanksgiving", "Christmas Day",
    "Martin Luther King Jr. Day", "Presidents' Day", "Veterans Day",
)


def _entry(name: str | Column, date: Column, when: Column) -> Column:
    label = F.lit(name) if isinstance(name, str) else name
    return F.when(when & date.isNotNull(), F.struct(date.alias("date"), label.alias("name")))


def _fixed(year: Column, name: str, month: int, day: int, since: int) -> list[Column]:
    """The day itself and the observed day (Saturday moves to Friday, Sunday to Monday)."""
    date = F.make_date(year, F.lit(month), F.lit(day))
    observed = F.when(F.weekday(date) == 5, F.date_add(date, -1)).when(
        F.weekday(date) == 6, F.date_add(date, 1)
    )
    return [
        _entry(name, date, year >= since),
        # An observed day in the year before belongs to that year, see ``_year_end``.
        _entry(f"{name} (observed)", observed, (year >= since) & (F.year(observed) == year)),
    ]


def _year_end(year: Column) -> Column:
    """31 December stands in for a New Year's Day that falls on a Saturday."""
    last = F.make_date(year, F.lit(12), F.lit(31))
    return _entry("New Year's Day (observed)", last, F.weekday(last) == 4)


def _nth(year: Column, name: str, month: int, day: str, n: int, since: int) -> Column:
    start = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        date = F.date_add(F.next_day(F.date_add(start, -1), day), 7 * (n - 1))
    else:
        date = F.next_day(F.date_add(F.last_day(start), -7), day)
    return _entry(name, date, year >= since)


def holiday_dates(years: DataFrame, keys: tuple[str, ...] = (), year: str = "year") -> DataFrame:
    """(keys, holiday_date, holiday_name) for every year of ``years``; names on one day are joined."""
    y = F.col(year)
    entries = [e for f in FIXED_DAYS for e in _fixed(y, *f)]
    entries += [_nth(y, *n) for n in NTH_DAYS] + [_year_end(y)]
    rows = years.select(*keys, F.inline(F.array_compact(F.array(*entries))))
    names = F.array_join(F.array_sort(F.collect_set("name")), "; ")  # at most two names share a day
    return rows.groupBy(*keys, F.col("date").alias("holiday_date")).agg(names.alias("holiday_name"))


def _has(name: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(name, F.lit(p)) for p in parts])


def holiday_periods(dates: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """First and last day that a holiday affects, from its name."""
    name, day = F.col("holiday_name"), F.col("holiday_date")
    before = (
        F.when(_has(name, "Thanksgiving"), 0)
        .when(_has(name, "Christmas"), 2)
        .when(_has(name, "New Year", "Independence Day"), 1)
        .when(_has(name, "Memorial Day", "Labor Day"), 2)
        .otherwise(0)
    )
    after = (
        F.when(_has(name, "Thanksgiving"), 1)
        .when(_has(name, "Christmas"), 2)
        .when(_has(name, "New Year", "Independence Day"), 1)
        .otherwise(0)
    )
    return dates.select(
        *keys, "holiday_date",
        F.date_sub(day, before).alias("start_date"), F.date_add(day, after).alias("end_date"),
        _has(name, *MAJOR_NAMES).alias("is_major"),
    )


def holiday_calendar(years: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per (keys, date) near any holiday with distances, period flags and day-before/after flags.

    Inside a period its own distance does not count: the distance is to the nearest other period. If
    periods overlap, the one of the last holiday gives the day number.
    """
    dates = holiday_dates(years, keys)
    periods = holiday_periods(dates, keys)
    reach = F.sequence(F.date_sub("start_date", FAR), F.date_add("end_date", FAR))
    near = periods.select("*", F.explode(reach).alias("date"))
    day = F.col("date")
    inside = day.between(F.col("start_date"), F.col("end_date"))
    distance = F.when(day < F.col("start_date"), F.datediff("start_date", day)).when(
        day > F.col("end_date"), F.datediff(day, "end_date")
    )
    into = F.max_by(
        F.when(inside, F.datediff(day, "start_date")), F.when(inside, F.col("holiday_date"))
    )
    one = F.datediff(day, "holiday_date")
    return near.groupBy(*keys, "date").agg(
        F.max((one == 0).cast("int")).alias("is_us_holiday"),
        F.coalesce(F.min(distance), F.lit(FAR)).alias("days_to_nearest_holiday"),
        F.coalesce(F.min(F.when(F.col("is_major"), distance)), F.lit(FAR)).alias("days_to_nearest_major_holiday"),
        F.max(inside.cast("int")).alias("is_in_holiday_period"),
        F.max((inside & F.col("is_major")).cast("int")).alias("is_in_major_holiday_period"),
        F.coalesce(into, F.lit(0)).alias("days_into_holiday_period"),
        F.max((one == -1).cast("int")).alias("is_day_before_holiday"),
        F.max((one == 1).cast("int")).alias("is_day_after_holiday"),
    )


DEFAULTS = {
    "is_us_holiday": 0, "days_to_nearest_holiday": FAR, "days_to_nearest_major_holiday": FAR,
    "is_in_holiday_period": 0, "is_in_major_holiday_period": 0, "days_into_holiday_period": 0,
    "is_day_before_holiday": 0, "is_day_after_holiday": 0,
}


def year_span(ts: str) -> list[Column]:
    """First and last year, as aggregates for ``add_holidays``."""
    return [F.min(F.year(ts)).alias("_a"), F.max(F.year(ts)).alias("_b")]


def add_holidays(df: DataFrame, ts: str, keys: tuple[str, ...] = (), span: DataFrame | None = None) -> DataFrame:
    """Join the holiday calendar on the UTC date.

    Only holidays of the years present in a series (per key) count. Series with the same first and last
    year share one calendar, so the calendar does not grow with the number of series. ``span``: a written table with the ``year_span`` of
    every series, if ``df`` already has it.
    """
    known = span is not None
    if not known:
        df = stored(df)
        span = materialize(df.groupBy(*keys).agg(*year_span(ts)))
    years = span.where("_a IS NOT NULL").select("_a", "_b").distinct().withColumn("year", F.explode(F.sequence("_a", "_b")))
    calendar = holiday_calendar(years, ("_a", "_b")).withColumnRenamed("date", "_date")
    out = df.withColumn("_date", F.to_date(ts))
    if keys:
        out = (out if known else out.join(small(span), list(keys), "left")).join(small(materialize(calendar)), ["_a", "_b", "_date"], "left")
    else:
        out = out.join(small(materialize(calendar)), "_date", "left")
    return out.drop("_a", "_b", "_date").fillna(DEFAULTS)
