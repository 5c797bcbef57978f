"""Error history of the official forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import demand, forecast_error as fe
from panelspark.operators.blocks import over_blocks

from panelspark.queries import adapters as a
from panelspark.queries.adapters import cols, r, tidy


def _history(spark: SparkSession, d: str, align: bool = False) -> DataFrame:
    grid = a.hourly_grid(spark, d).select("respondent", "period", "demand_mw", "eia_forecast_mw")
    return fe.add_error_history(grid, a.HOURLY, align=align)


ERROR_SQL = f"""{a.HOURLY_GRID_SQL},
errors AS (
  SELECT respondent, period, demand_mw, eia_forecast_mw AS f, lag(demand_mw, 24) OVER w AS lag_24h, lag(demand_mw, 48) OVER w AS lag_48h,
    lag(eia_forecast_mw, 24) OVER w AS f24, lag(eia_forecast_mw, 48) OVER w AS f48,
    lag(eia_forecast_mw, 24) OVER w - lag(demand_mw, 48) OVER w AS eia_error_48h,
    lag(eia_forecast_mw, 48) OVER w - lag(demand_mw, 72) OVER w AS eia_error_72h,
    lag(eia_forecast_mw, 24) OVER w - lag(demand_mw, 24) OVER w AS aligned_48h
  FROM hourly_grid WINDOW w AS (PARTITION BY respondent ORDER BY period))"""


def _roll(fn: str, c: str, width: int, need: int) -> str:
    over = f"OVER (PARTITION BY respondent ORDER BY period ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {over} >= {need} THEN {fn}({c}) {over} END"


def fcst_error(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_history(spark, d).select("respondent", "period", "eia_error_48h", "eia_error_72h", "eia_bias_24h", "eia_bias_48h"))


FCST_ERROR = f"""WITH {ERROR_SQL} SELECT respondent, period, {cols('eia_error_48h eia_error_72h')},
  {r(_roll('avg', 'eia_error_48h', 24, 12))} AS eia_bias_24h, {r(_roll('avg', 'eia_error_48h', 48, 24))} AS eia_bias_48h FROM errors"""


def fcst_error_aligned(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_history(spark, d, align=True).select("respondent", "period", "eia_error_48h", "eia_bias_24h"))


FCST_ERROR_ALIGNED = f"""WITH {ERROR_SQL} SELECT respondent, period, {r('aligned_48h')} AS eia_error_48h,
  {r(_roll('avg', 'aligned_48h', 24, 12))} AS eia_bias_24h FROM errors"""


def fcst_bias_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """Over 168 rows of the same hour, at least 24; the driver table has 30 days."""
    rows = _history(spark, d).withColumn("hour_of_day", F.hour("period"))
    out = fe.bias_by_hour(rows, a.HOURLY.with_(block=512))
    return tidy(out.select("respondent", "period", "eia_bias_by_hour"))


FCST_BIAS_BY_HOUR = f"""WITH {ERROR_SQL}
SELECT respondent, period, CASE WHEN count(eia_error_48h) OVER w >= 24 THEN {r('avg(eia_error_48h) OVER w')} END AS eia_bias_by_hour
FROM errors WINDOW w AS (PARTITION BY respondent, hour(period) ORDER BY period ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)"""


def fcst_range(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_history(spark, d).select("respondent", "period", "eia_forecast_change_24h", "eia_forecast_change_48h",
                                          "eia_forecast_accel", "eia_forecast_volatility", "eia_forecast_range_168h"))


FCST_RANGE = f"""WITH {ERROR_SQL} SELECT respondent, period, {r('f - f24')} AS eia_forecast_change_24h, {r('f24 - f48')} AS eia_forecast_change_48h,
  {r('(f - f24) - (f24 - f48)')} AS eia_forecast_accel, {r(_roll('stddev_samp', 'f', 24, 12))} AS eia_forecast_volatility,
  {r(_roll('max', 'f', 168, 72) + ' - ' + _roll('min', 'f', 168, 72))} AS eia_forecast_range_168h FROM errors"""


def fcst_trend(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_history(spark, d).select("respondent", "period", "eia_error_trend"))


FCST_TREND = f"""WITH {ERROR_SQL} SELECT respondent, period,
  {r(_roll('avg', 'eia_error_48h', 24, 12) + ' - ' + _roll('avg', 'eia_error_48h', 168, 72))} AS eia_error_trend FROM errors"""


def fcst_vs_persistence(spark: SparkSession, d: str) -> DataFrame:
    grid = a.hourly_grid(spark, d).select("respondent", "period", "demand_mw", "eia_forecast_mw")
    lagged = over_blocks(grid, a.HOURLY_SHORT, {k: v for k, v in demand.lags().items() if k != "lag_168h"})
    return tidy(lagged.select("respondent", "period", fe.versus_persistence().alias("eia_vs_persistence")))


FCST_VS_PERSISTENCE = f"""WITH {ERROR_SQL} SELECT respondent, period,
  CAST(coalesce(abs(f - lag_24h) < abs(lag_48h - lag_24h), false) AS INTEGER) AS eia_vs_persistence FROM errors"""


def fcst_weather_bias(spark: SparkSession, d: str) -> DataFrame:
    temps = a.weather_hourly(spark, d).select("respondent", "period", "temp_2m")
    rows = _history(spark, d).select("respondent", "period", "eia_bias_24h").join(temps, ["respondent", "period"], "left")
    made = fe.weather_bias(F.col("temp_2m"))
    return tidy(rows.select("respondent", "period", *[c.alias(n) for n, c in made.items()]))


FCST_WEATHER_BIAS = f"""WITH {ERROR_SQL}, {a.WEATHER_SQL},
bias AS (SELECT respondent, period, {_roll('avg', 'eia_error_48h', 24, 12)} AS b FROM errors)
SELECT x.respondent, x.period, {r('CASE WHEN temp_2m > 30 THEN b END')} AS eia_bias_hot, {r('CASE WHEN temp_2m < 0 THEN b END')} AS eia_bias_cold
FROM bias x LEFT JOIN weather_hourly h ON h.respondent = x.respondent AND h.period = x.period"""


QUERIES = {
    "fcst_error": (fcst_error, FCST_ERROR),
    "fcst_error_aligned": (fcst_error_aligned, FCST_ERROR_ALIGNED),
    "fcst_bias_by_hour": (fcst_bias_by_hour, FCST_BIAS_BY_HOUR),
    "fcst_range": (fcst_range, FCST_RANGE),
    "fcst_trend": (fcst_trend, FCST_TREND),
    "fcst_vs_persistence": (fcst_vs_persistence, FCST_VS_PERSISTENCE),
    "fcst_weather_bias": (fcst_weather_bias, FCST_WEATHER_BIAS),
}
