"""Calendar, holidays, period flags and sun geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import calendar, holidays, weather
from panelspark.operators import cleaning
from panelspark.queries import adapters as a
from panelspark.queries.adapters import r, tidy
from panelspark.session import small


def calendar_basic(spark: SparkSession, d: str) -> DataFrame:
    grid = a.hourly_grid(spark, d).select("respondent", "period")
    return tidy(grid.withColumns(calendar.basic(F.col("period"))))


CALENDAR = f"""WITH {a.HOURLY_GRID_SQL}
SELECT respondent, period, CAST(hour(period) AS INTEGER) AS hour_of_day, CAST(isodow(period) - 1 AS INTEGER) AS day_of_week,
  CAST(month(period) AS INTEGER) AS month, CAST(isodow(period) >= 6 AS INTEGER) AS is_weekend FROM hourly_grid"""


def fourier(spark: SparkSession, d: str) -> DataFrame:
    grid = a.hourly_grid(spark, d).select("respondent", "period")
    return tidy(grid.withColumns(calendar.fourier(F.col("period")) | calendar.annual(F.col("period"))))


def _wave_sql() -> str:
    parts = []
    for k in (1, 2):
        parts.append((f"hour_{k}", f"2 * pi() * {k} * hour(period) / 24"))
    for k in (1, 2, 3):
        parts.append((f"week_{k}", f"2 * pi() * {k} * ((isodow(period) - 1) * 24 + hour(period)) / 168"))
    for k in (1, 2):
        parts.append((f"year_{k}", f"2 * pi() * {k} * dayofyear(period) / CAST(365.25 AS DOUBLE)"))
    return ", ".join(f"{r(f'{fn}({x})')} AS {fn}_{n}" for n, x in parts for fn in ("sin", "cos"))


FOURIER = f"WITH {a.HOURLY_GRID_SQL} SELECT respondent, period, {_wave_sql()} FROM hourly_grid"


def month_position(spark: SparkSession, d: str) -> DataFrame:
    grid = cleaning.regular_grid(a.daily_region(spark, d), a.DAILY).select("respondent", "period")
    return tidy(grid.withColumns(calendar.month_position(F.col("period"))))


MONTH_POSITION = f"""WITH {a.DAILY_SQL}
SELECT respondent, period, CAST(day(period) AS INTEGER) AS day_of_month, CAST(week(period) AS INTEGER) AS week_of_year,
  CAST(quarter(period) AS INTEGER) AS quarter, CAST(day(period) - 1 AS INTEGER) AS days_from_month_start,
  CAST(day(last_day(period)) - day(period) AS INTEGER) AS days_to_month_end FROM daily_grid"""


def _holiday_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = cleaning.regular_grid(a.daily_region(spark, d), a.DAILY).select("respondent", "period")
    return holidays.add_holidays(grid, "period", ("respondent",))


HOLIDAY_SQL = f"""{a.DAILY_SQL},
years AS (
  SELECT respondent, unnest(range(CAST(min(year(period)) AS BIGINT), CAST(max(year(period)) + 1 AS BIGINT))) AS y
  FROM daily_grid GROUP BY 1),
fixed_days AS (
  SELECT respondent, y, name, make_date(y, m, dd) AS day FROM years,
  (VALUES ('New Year''s Day', 1, 1, 1870), ('Juneteenth National Independence Day', 6, 19, 2021), ('Independence Day', 7, 4, 1870),
          ('Veterans Day', 11, 11, 1978), ('Christmas Day', 12, 25, 1870)) f(name, m, dd, since) WHERE y >= since),
nth_days AS (
  SELECT respondent, y, name,
    CASE WHEN n > 0 THEN make_date(y, m, 1) + CAST((dow - isodow(make_date(y, m, 1)) + 7) % 7 + 7 * (n - 1) AS INTEGER)
         ELSE last_day(make_date(y, m, 1)) - CAST((isodow(last_day(make_date(y, m, 1))) - dow + 7) % 7 AS INTEGER) END AS day
  FROM years, (VALUES ('Martin Luther King Jr. Day', 1, 1, 3), ('Washington''s Birthday', 2, 1, 3), ('Memorial Day', 5, 1, -1),
    ('Labor Day', 9, 1, 1), ('Columbus Day', 10, 1, 2), ('Thanksgiving Day', 11, 4, 4)) v(name, m, dow, n)),
observed AS (
  SELECT respondent, y, name || ' (observed)' AS name,
    CASE isodow(day) WHEN 6 THEN day - 1 WHEN 7 THEN day + 1 END AS day FROM fixed_days WHERE isodow(day) >= 6
  UNION ALL
  SELECT respondent, y, 'New Year''s Day (observed)', make_date(y, 12, 31) FROM years WHERE isodow(make_date(y, 12, 31)) = 5),
hol AS (
  SELECT respondent, CAST(day AS DATE) AS day, string_agg(name, '; ') AS name FROM (
    SELECT * FROM fixed_days UNION ALL SELECT * FROM nth_days UNION ALL SELECT * FROM observed WHERE year(day) = y)
  GROUP BY 1, 2),
periods AS (
  SELECT respondent, day,
    day - CAST(CASE WHEN name LIKE '%Thanksgiving%' THEN 0 WHEN name LIKE '%Christmas%' THEN 2
         WHEN name LIKE '%New Year%' OR name LIKE '%Independence Day%' THEN 1
         WHEN name LIKE '%Memorial Day%' OR name LIKE '%Labor Day%' THEN 2 ELSE 0 END AS INTEGER) AS s,
    day + CAST(CASE WHEN name LIKE '%Thanksgiving%' THEN 1 WHEN name LIKE '%Christmas%' THEN 2
         WHEN name LIKE '%New Year%' OR name LIKE '%Independence Day%' THEN 1 ELSE 0 END AS INTEGER) AS e,
    NOT (name LIKE 'Washington%' OR name LIKE 'Columbus%') AS major
  FROM hol),
marks AS (
  SELECT g.respondent, g.period,
    max(CASE WHEN CAST(g.period AS DATE) = p.day THEN 1 ELSE 0 END) AS is_us_holiday,
    least(365, min(CASE WHEN CAST(g.period AS DATE) < s THEN date_diff('day', CAST(g.period AS DATE), s)
             WHEN CAST(g.period AS DATE) > e THEN date_diff('day', e, CAST(g.period AS DATE)) END)) AS days_to_nearest_holiday,
    least(365, min(CASE WHEN NOT major THEN NULL WHEN CAST(g.period AS DATE) < s THEN date_diff('day', CAST(g.period AS DATE), s)
             WHEN CAST(g.period AS DATE) > e THEN date_diff('day', e, CAST(g.period AS DATE)) END)) AS days_to_nearest_major_holiday,
    max(CASE WHEN CAST(g.period AS DATE) BETWEEN s AND e THEN 1 ELSE 0 END) AS is_in_holiday_period,
    max(CASE WHEN major AND CAST(g.period AS DATE) BETWEEN s AND e THEN 1 ELSE 0 END) AS is_in_major_holiday_period,
    coalesce(arg_max(date_diff('day', s, CAST(g.period AS DATE)), p.day) FILTER (WHERE CAST(g.period AS DATE) BETWEEN s AND e), 0) AS days_into_holiday_period,
    max(CASE WHEN CAST(g.period AS DATE) = p.day - 1 THEN 1 ELSE 0 END) AS is_day_before_holiday,
    max(CASE WHEN CAST(g.period AS DATE) = p.day + 1 THEN 1 ELSE 0 END) AS is_day_after_holiday
  FROM daily_grid g JOIN periods p ON p.respondent = g.respondent GROUP BY 1, 2)"""


def _ints(names: str) -> str:
    return ", ".join(f"CAST({n} AS INTEGER) AS {n}" for n in names.split())


def holiday_flags(spark: SparkSession, d: str) -> DataFrame:
    out = _holiday_grid(spark, d)
    out = out.withColumn("is_business_day", calendar.business_day(F.col("period"), F.col("is_us_holiday")))
    return tidy(out.select("respondent", "period", "is_us_holiday", "is_business_day",
                           "is_day_before_holiday", "is_day_after_holiday"))


HOLIDAY_FLAGS = f"""WITH {HOLIDAY_SQL}
SELECT respondent, period, {_ints('is_us_holiday is_day_before_holiday is_day_after_holiday')},
  CAST(isodow(period) < 6 AND is_us_holiday = 0 AS INTEGER) AS is_business_day FROM marks"""

_DISTANCE = "days_to_nearest_holiday days_to_nearest_major_holiday is_in_holiday_period is_in_major_holiday_period days_into_holiday_period"


def holiday_distance(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_holiday_grid(spark, d).select("respondent", "period", *_DISTANCE.split()))


HOLIDAY_DISTANCE = f"WITH {HOLIDAY_SQL} SELECT respondent, period, {_ints(_DISTANCE)} FROM marks"

_DST = ("1998-04-05", "1998-10-25", "1999-04-04", "1999-10-31", "2000-04-02", "2000-10-29")


def period_flags(spark: SparkSession, d: str) -> DataFrame:
    daily = a.daily_region(spark, d).select("respondent", "period")
    return tidy(daily.withColumns({
        "is_covid_period": calendar.in_period(F.col("period"), "1998-03-01 00:00:00", "1998-12-31 00:00:00"),
        "is_dst_transition": calendar.on_dates(F.col("period"), _DST),
    }))


PERIOD_FLAGS = f"""WITH {a.DAILY_SQL}
SELECT respondent, period, CAST(period BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-12-31' AS INTEGER) AS is_covid_period,
  CAST(strftime(period, '%Y-%m-%d') IN {_DST} AS INTEGER) AS is_dst_transition FROM daily"""


def solar_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Every nation's order days; one nation has no latitude and gets the fixed values."""
    lat = F.when(F.col("n_nationkey") != 3, F.col("lat")).alias("lat")
    places = a.registry(spark, d).select(F.col("code").alias("respondent"), lat)
    days = a.daily_nation(spark, d).select("respondent", "period")
    out = days.join(small(places), "respondent")
    return tidy(out.withColumns(weather.sun_geometry(F.col("lat"), F.col("period"))).drop("lat"))


SOLAR_GEOMETRY = f"""WITH {a.NATION_SQL}, {a.REGISTRY_SQL},
sun AS (
  SELECT respondent, period, CASE WHEN n_nationkey <> 3 THEN lat END AS lat,
    CAST(23.45 AS DOUBLE) * sin(radians(CAST(360 * (284 + dayofyear(period)) AS DOUBLE) / 365)) AS decl
  FROM nation_daily JOIN registry ON code = respondent)
SELECT respondent, period,
  CASE WHEN lat IS NULL THEN CAST(12 AS DOUBLE) ELSE {r('2 * degrees(acos(least(1, greatest(-1, -tan(radians(lat)) * tan(radians(decl)))))) / 15')} END AS day_length_hours,
  CASE WHEN lat IS NULL THEN CAST(45 AS DOUBLE) ELSE {r('90 - abs(lat - decl)')} END AS solar_elevation_noon
FROM sun"""


QUERIES = {
    "calendar": (calendar_basic, CALENDAR),
    "fourier": (fourier, FOURIER),
    "month_position": (month_position, MONTH_POSITION),
    "holiday_flags": (holiday_flags, HOLIDAY_FLAGS),
    "holiday_distance": (holiday_distance, HOLIDAY_DISTANCE),
    "period_flags": (period_flags, PERIOD_FLAGS),
    "solar_geometry": (solar_geometry, SOLAR_GEOMETRY),
}
