"""Error history of the official forecast.

As coded in the original definition the error compares the forecast at t - 24 with the demand at t - 48
(``align=False``). With ``align=True`` both refer to the same hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.nulls import flag
from panelspark.operators.blocks import Over, lag, over_blocks, rolling
from panelspark.panel import DAY, Panel


def lagged(forecast: str = "eia_forecast_mw", demand: str = "demand_mw", align: bool = False) -> dict[str, Over]:
    known = 0 if align else 24
    return {
        "_f24": lag(forecast, 24), "_f48": lag(forecast, 48),
        "_a24": lag(demand, 24 + known), "_a48": lag(demand, 48 + known),
    }


def errors() -> dict[str, Column]:
    return {"eia_error_48h": F.col("_f24") - F.col("_a24"), "eia_error_72h": F.col("_f48") - F.col("_a48")}


def bias(error: str = "eia_error_48h", forecast: str = "eia_forecast_mw") -> dict[str, Over]:
    return {
        "eia_bias_24h": rolling(F.avg, error, 24, 12),
        "eia_bias_48h": rolling(F.avg, error, 48, 24),
        "_bias_168h": rolling(F.avg, error, 168, 72),
        "eia_forecast_volatility": rolling(F.stddev_samp, forecast, 24, 12),
        "_f_max": rolling(F.max, forecast, 168, 72),
        "_f_min": rolling(F.min, forecast, 168, 72),
    }


def changes(forecast: str = "eia_forecast_mw") -> dict[str, Column]:
    recent, older = F.col(forecast) - F.col("_f24"), F.col("_f24") - F.col("_f48")
    return {
        "eia_forecast_change_24h": recent,
        "eia_forecast_change_48h": older,
        "eia_forecast_accel": recent - older,
        "eia_forecast_range_168h": F.col("_f_max") - F.col("_f_min"),
        "eia_error_trend": F.col("eia_bias_24h") - F.col("_bias_168h"),
    }


def versus_persistence(forecast: str = "eia_forecast_mw", lag_24: str = "lag_24h", lag_48: str = "lag_48h") -> Column:
    """1 where the forecast is closer to the value of one day ago than the value of two days ago is."""
    actual = F.col(lag_24)
    return flag(F.abs(F.col(forecast) - actual) < F.abs(F.col(lag_48) - actual))


def weather_bias(temp: Column, bias_24: str = "eia_bias_24h") -> dict[str, Column]:
    return {
        "eia_bias_hot": F.when(temp > 30, F.col(bias_24)),
        "eia_bias_cold": F.when(temp < 0, F.col(bias_24)),
    }


def bias_by_hour(df: DataFrame, panel: Panel, error: str = "eia_error_48h", hour: str = "hour_of_day",
                 rows: int = 168, need: int = 24) -> DataFrame:
    """Rolling mean error over the last ``rows`` rows of the same hour of day (one row per day)."""
    hourly = panel.with_(keys=(*panel.keys, hour), step=DAY)
    return over_blocks(df, hourly, {"eia_bias_by_hour": rolling(F.avg, error, rows, need)})


def add_error_history(df: DataFrame, panel: Panel, forecast: str = "eia_forecast_mw",
                      demand: str = "demand_mw", align: bool = False) -> DataFrame:
    """All error columns but the by-hour bias, with one exchange."""
    out = over_blocks(df, panel, lagged(forecast, demand, align), errors(), bias(forecast=forecast), changes(forecast))
    return out.drop("_f24", "_f48", "_a24", "_a48", "_bias_168h", "_f_max", "_f_min")
