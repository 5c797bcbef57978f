"""Weather columns and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import calendar, weather
from panelspark.operators.blocks import over_blocks
from panelspark.queries import adapters as a
from panelspark.queries.adapters import cols, r, tidy

RH_SQL = f"""{a.WEATHER_GRID_SQL},
humid AS (
  SELECT *, least(100, greatest(0, 100 * exp(CAST(17.271 AS DOUBLE) * temp_2m / (CAST(237.7 AS DOUBLE) + temp_2m)
            - CAST(17.271 AS DOUBLE) * dewpoint_2m / (CAST(237.7 AS DOUBLE) + dewpoint_2m)))) AS rh0
  FROM weather_grid),
rh AS (SELECT * EXCLUDE (rh0), CASE WHEN temp_2m IS NOT NULL THEN rh0 END AS rh FROM humid)"""


def weather_core(spark: SparkSession, d: str) -> DataFrame:
    return tidy(a.weather_grid(spark, d).select("respondent", "period", *weather.CORE))


WEATHER_CORE = f"WITH {a.WEATHER_GRID_SQL} SELECT respondent, period, {cols(' '.join(weather.CORE))} FROM weather_grid"


def thermal(spark: SparkSession, d: str) -> DataFrame:
    grid = a.weather_grid(spark, d).withColumns(weather.thermal(F.col("temp_2m")))
    return tidy(grid.select("respondent", "period", "hdd", "cdd", "hdd_sq", "cdd_sq"))


_H = "CASE WHEN temp_2m IS NOT NULL THEN greatest(0, CAST(18.3 AS DOUBLE) - temp_2m) END"
_C = "CASE WHEN temp_2m IS NOT NULL THEN greatest(0, temp_2m - CAST(18.3 AS DOUBLE)) END"
THERMAL = f"""WITH {a.WEATHER_GRID_SQL}
SELECT respondent, period, {r(_H)} AS hdd, {r(_C)} AS cdd, {r(f'pow({_H}, 2)')} AS hdd_sq, {r(f'pow({_C}, 2)')} AS cdd_sq FROM weather_grid"""


def humidity_heat_index(spark: SparkSession, d: str) -> DataFrame:
    grid = a.weather_grid(spark, d).withColumn("relative_humidity", weather.humidity(F.col("temp_2m"), F.col("dewpoint_2m")))
    out = grid.withColumn("apparent_temp", weather.apparent(F.col("temp_2m"), F.col("relative_humidity")))
    return tidy(out.select("respondent", "period", "relative_humidity", "apparent_temp"))


_HI = """-8.784694755e0 + 1.61139411e0 * temp_2m + 2.338548839e0 * rh - 0.14611605e0 * temp_2m * rh - 0.012308094e0 * temp_2m ** 2
  - 0.016424828e0 * rh ** 2 + 0.002211732e0 * temp_2m ** 2 * rh + 0.00072546e0 * temp_2m * rh ** 2 - 0.000003582e0 * temp_2m ** 2 * rh ** 2"""
HUMIDITY = f"""WITH {RH_SQL}
SELECT respondent, period, {r('rh')} AS relative_humidity, {r(f'CASE WHEN temp_2m > 27 THEN {_HI} ELSE temp_2m END')} AS apparent_temp FROM rh"""


def comfort(spark: SparkSession, d: str) -> DataFrame:
    rh = weather.humidity(F.col("temp_2m"), F.col("dewpoint_2m"))
    out = a.weather_grid(spark, d).select(
        "respondent", "period", (F.col("temp_2m") - F.col("dewpoint_2m")).alias("dewpoint_depression"),
        weather.heat_humidity_index(F.col("temp_2m"), rh).alias("thi"), weather.wind_chill(F.col("temp_2m"), F.col("windspeed_10m")).alias("wind_chill"))
    return tidy(out)


_F = "(temp_2m * 9 / 5 + 32)"
_THI = f"({_F} - 0.55e0 * (1 - rh / 100) * ({_F} - 58) - 32) * 5 / 9"
_WCI = "13.12e0 + 0.6215e0 * temp_2m - 11.37e0 * pow(windspeed_10m, 0.16e0) + 0.3965e0 * temp_2m * pow(windspeed_10m, 0.16e0)"
COMFORT = f"""WITH {RH_SQL}
SELECT respondent, period, {r('temp_2m - dewpoint_2m')} AS dewpoint_depression,
  {r(f'CASE WHEN temp_2m > 18 THEN {_THI} ELSE temp_2m END')} AS thi,
  {r(f'CASE WHEN temp_2m < 10 THEN {_WCI} ELSE temp_2m END')} AS wind_chill FROM rh"""


def temp_windows(spark: SparkSession, d: str) -> DataFrame:
    grid = a.weather_grid(spark, d).select("respondent", "period", "temp_2m")
    out = over_blocks(grid, a.HOURLY, weather.temp_windows()).withColumns(weather.temp_changes())
    return tidy(out.drop("temp_2m"))


def _roll(fn: str, width: int, need: int) -> str:
    over = f"OVER (PARTITION BY respondent ORDER BY period ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(temp_2m) {over} >= {need} THEN {r(f'{fn}(temp_2m) {over}')} END"


TEMP_WINDOWS = f"""WITH {a.WEATHER_GRID_SQL}
SELECT respondent, period, {r('lag(temp_2m, 24) OVER w')} AS temp_lag_48h, {r('lag(temp_2m, 144) OVER w')} AS temp_lag_168h,
  {r('temp_2m - lag(temp_2m, 24) OVER w')} AS temp_delta_24h, {_roll('avg', 6, 3)} AS temp_rolling_mean_6h,
  {_roll('avg', 24, 12)} AS temp_rolling_mean_24h, {_roll('avg', 48, 24)} AS temp_rolling_mean_48h,
  {_roll('max', 24, 12)} AS temp_rolling_max_24h, {_roll('min', 24, 12)} AS temp_rolling_min_24h,
  {_roll('max', 24, 12)} AS temp_daily_max, {_roll('min', 24, 12)} AS temp_daily_min,
  {r('(' + 'max(temp_2m) OVER d - min(temp_2m) OVER d' + ')')} * CASE WHEN count(temp_2m) OVER d >= 12 THEN 1 END AS temp_daily_range,
  {_roll('sum', 48, 24)} AS temp_cumulative_48h
FROM weather_grid WINDOW w AS (PARTITION BY respondent ORDER BY period),
  d AS (PARTITION BY respondent ORDER BY period ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""


def temp_weighted(spark: SparkSession, d: str) -> DataFrame:
    """On hours whose temperature was carried over short gaps, so that full windows occur."""
    grid = a.weather_grid(spark, d).select("respondent", "period", F.coalesce("temp_2m", F.when(
        F.dayofyear("period") > 4, F.lit(15.0))).alias("temp_2m"))
    return tidy(over_blocks(grid, a.HOURLY_SHORT, weather.temp_weighted()).drop("temp_2m"))


_W = [f"exp(-{47 - j} / 12.0e0) / total * CASE WHEN rn > {j} THEN lag(temp_2m, {j}) OVER w ELSE 0 END" for j in range(48)]
TEMP_WEIGHTED = f"""WITH {a.WEATHER_GRID_SQL},
temps AS (
  SELECT respondent, period, coalesce(temp_2m, CASE WHEN dayofyear(period) > 4 THEN CAST(15 AS DOUBLE) END) AS temp_2m,
         row_number() OVER (PARTITION BY respondent ORDER BY period) AS rn,
         (SELECT sum(exp(-i / 12.0e0)) FROM range(48) t(i)) AS total
  FROM weather_grid)
SELECT respondent, period, CASE WHEN count(temp_2m) OVER f >= 24 THEN {r(' + '.join(_W))} END AS temp_weighted_48h
FROM temps WINDOW w AS (PARTITION BY respondent ORDER BY period),
  f AS (PARTITION BY respondent ORDER BY period ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)"""


def weather_interactions(spark: SparkSession, d: str) -> DataFrame:
    grid = a.weather_grid(spark, d).withColumns(weather.thermal(F.col("temp_2m"))).withColumns(calendar.basic(F.col("period")))
    rh = weather.humidity(F.col("temp_2m"), F.col("dewpoint_2m"))
    made = weather.interactions(F.col("temp_2m"), rh, F.col("hour_of_day"), F.col("month"), F.col("is_weekend"), F.col("hdd"), F.col("cdd"))
    return tidy(grid.select("respondent", "period", *[c.alias(n) for n, c in made.items()]))


INTERACTIONS = f"""WITH {RH_SQL}
SELECT respondent, period, {r('rh * temp_2m')} AS humidity_x_temp, {r('temp_2m * hour(period)')} AS temp_x_hour,
  {r('temp_2m * month(period)')} AS temp_x_month, {r(f'({_C}) * hour(period)')} AS cdd_x_hour, {r(f'({_H}) * hour(period)')} AS hdd_x_hour,
  {r('temp_2m * CASE WHEN isodow(period) >= 6 THEN 1 ELSE 0 END')} AS temp_x_is_weekend FROM rh"""


#: Types in the order of the supply regions R0 ... R4.
_KINDS = ("click", "error", "purchase", "signup", "view")


def supply_interactions(spark: SparkSession, d: str) -> DataFrame:
    """Wind and sun times the shares of the supply region that goes with each type, in the same hours."""
    from panelspark.functions import fuel

    mix = fuel.mix(a.FUELS)
    region = F.create_map(*[F.lit(x) for i, kind in enumerate(_KINDS) for x in (f"R{i}", kind)])
    shares = a.supply_shifted(spark, d).select(
        region[F.col("respondent")].alias("respondent"), "period", mix["wind_pct"].alias("wind_pct"), mix["solar_pct"].alias("solar_pct"))
    out = a.weather_hourly(spark, d).join(shares, ["respondent", "period"], "left")
    made = weather.supply_interactions(F.col("windspeed_10m"), F.col("solar_irradiance"), F.col("wind_pct"), F.col("solar_pct"))
    return tidy(out.select("respondent", "period", *[c.alias(n) for n, c in made.items()]))


SUPPLY_INTERACTIONS = f"""WITH {a.WEATHER_SQL}, {a.SUPPLY_SQL}, regions AS (SELECT unnest({list(_KINDS)}) AS kind, unnest(['R0', 'R1', 'R2', 'R3', 'R4']) AS region)
SELECT w.respondent, w.period, CASE WHEN t.period IS NOT NULL THEN {r('windspeed_10m * coalesce(wnd / total4, 0)')} END AS wind_x_wind_pct,
  CASE WHEN t.period IS NOT NULL THEN {r('solar_irradiance * coalesce(sun / total4, 0)')} END AS solar_x_solar_pct
FROM weather_hourly w JOIN regions g ON g.kind = w.respondent LEFT JOIN totals t ON t.period = w.period AND t.respondent = g.region"""


QUERIES = {
    "weather_core": (weather_core, WEATHER_CORE),
    "thermal": (thermal, THERMAL),
    "humidity_heat_index": (humidity_heat_index, HUMIDITY),
    "comfort": (comfort, COMFORT),
    "temp_windows": (temp_windows, TEMP_WINDOWS),
    "temp_weighted": (temp_weighted, TEMP_WEIGHTED),
    "weather_interactions": (weather_interactions, INTERACTIONS),
    "supply_interactions": (supply_interactions, SUPPLY_INTERACTIONS),
}
