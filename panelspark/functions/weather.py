"""Weather-derived columns: humidity, comfort indices, degree hours, thermal memory, sun geometry.

Weather is used at t itself (a perfect forecast is assumed), so ``temp_lag_48h`` is 24 rows and
``temp_lag_168h`` is 144 rows back. Wind chill expects km/h.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.nulls import clip
from panelspark.operators.blocks import Over, lag, rolling

CORE = ("temp_2m", "dewpoint_2m", "windspeed_10m", "solar_irradiance", "cloudcover", "precipitation")
# Magnus coefficients and the base of degree hours in degrees C.
MAGNUS_A, MAGNUS_B = 17.271, 237.7
BASE_TEMP = 18.3
# Heat index coefficients for (1, T, R, T R, T^2, R^2, T^2 R, T R^2, T^2 R^2).
HEAT_INDEX = (
    -8.784694755, 1.61139411, 2.338548839, -0.14611605, -0.012308094, -0.016424828, 0.002211732,
    0.00072546, -0.000003582,
)
# Sun elevation and day length without coordinates.
UNKNOWN_DAY_LENGTH, UNKNOWN_ELEVATION = 12.0, 45.0
THERMAL_ROWS = 48


def humidity(temp: Column, dew: Column, corrected: bool = False) -> Column:
    """Relative humidity in percent from temperature and dew point.

    The original definition divides the pressures the wrong way round, so it is 100 wherever the dew point
    is below the temperature. That is the default; ``corrected=True`` gives the physical value.
    """
    if corrected:
        temp, dew = dew, temp

    def pressure(t: Column) -> Column:
        return t * MAGNUS_A / (t + MAGNUS_B)

    return clip(F.exp(pressure(temp) - pressure(dew)) * 100, 0.0, 100.0)


def apparent(temp: Column, rh: Column) -> Column:
    """Heat index above 27 degrees, otherwise the temperature."""
    terms = (F.lit(1.0), temp, rh, temp * rh, temp * temp, rh * rh, temp * temp * rh,
             temp * rh * rh, temp * temp * rh * rh)
    index = F.lit(0.0)
    for weight, term in zip(HEAT_INDEX, terms):
        index = index + term * weight
    return F.when(temp > 27, index).otherwise(temp)


def thermal(temp: Column) -> dict[str, Column]:
    hdd, cdd = clip(F.lit(BASE_TEMP) - temp, 0.0), clip(temp - BASE_TEMP, 0.0)
    return {"hdd": hdd, "cdd": cdd, "hdd_sq": hdd * hdd, "cdd_sq": cdd * cdd}


def heat_humidity_index(temp: Column, rh: Column) -> Column:
    """THI (Fahrenheit formula) above 18 degrees, otherwise the temperature."""
    f = temp * 9 / 5 + 32
    thi = f - (F.lit(1.0) - rh / 100) * 0.55 * (f - 58)
    return F.when(temp > 18, (thi - 32) * 5 / 9).otherwise(temp)


def wind_chill(temp: Column, wind: Column) -> Column:
    """Wind chill below 10 degrees, otherwise the temperature."""
    v = F.pow(wind, F.lit(0.16))
    index = F.lit(13.12) + temp * 0.6215 - v * 11.37 + temp * v * 0.3965
    return F.when(temp < 10, index).otherwise(temp)


def temp_windows(temp: str = "temp_2m") -> dict[str, Over]:
    out = {"temp_lag_48h": lag(temp, 24), "temp_lag_168h": lag(temp, 144)}
    for width, need in ((6, 3), (24, 12), (48, 24)):
        out[f"temp_rolling_mean_{width}h"] = rolling(F.avg, temp, width, need)
    out["temp_rolling_max_24h"] = rolling(F.max, temp, 24, 12)
    out["temp_rolling_min_24h"] = rolling(F.min, temp, 24, 12)
    out["temp_cumulative_48h"] = rolling(F.sum, temp, THERMAL_ROWS, 24)
    return out


def temp_changes(temp: str = "temp_2m") -> dict[str, Column]:
    high, low = F.col("temp_rolling_max_24h"), F.col("temp_rolling_min_24h")
    return {
        "temp_delta_24h": F.col(temp) - F.col("temp_lag_48h"),
        "temp_daily_max": high, "temp_daily_min": low, "temp_daily_range": high - low,
    }


def thermal_weights(rows: int = THERMAL_ROWS, decay: float = 12.0) -> list[float]:
    """Exponential weights that sum to 1; the first (largest) belongs to the oldest row."""
    raw = [math.exp(-i / decay) for i in range(rows)]
    total = sum(raw)
    return [r / total for r in raw]


def temp_weighted(temp: str = "temp_2m", rows: int = THERMAL_ROWS, need: int = 24) -> dict[str, Over]:
    """Weighted sum of the last ``rows`` values, oldest weighted most.

    Rows before the start of the series count as 0 without rescaling the weights; a missing value inside
    the window makes the result missing.
    """
    weights = thermal_weights(rows)
    present = rolling(F.count, temp, rows)

    def build(w) -> Column:
        total = F.lit(0.0)
        for back, weight in enumerate(reversed(weights)):
            # The default stands in only where the series has no row; a missing value stays missing.
            total = total + F.lag(temp, back, 0.0).over(w) * weight
        return F.when(present.build(w) >= need, total)

    return {"temp_weighted_48h": Over(build, back=rows - 1, needs=present.needs)}


def interactions(temp: Column, rh: Column, hour: Column, month: Column, weekend: Column,
                 hdd: Column, cdd: Column) -> dict[str, Column]:
    return {
        "humidity_x_temp": rh * temp, "temp_x_hour": temp * hour, "temp_x_month": temp * month,
        "cdd_x_hour": cdd * hour, "hdd_x_hour": hdd * hour, "temp_x_is_weekend": temp * weekend,
    }


def supply_interactions(wind: Column, solar: Column, wind_pct: Column, solar_pct: Column) -> dict[str, Column]:
    return {"wind_x_wind_pct": wind * wind_pct, "solar_x_solar_pct": solar * solar_pct}


def sun_geometry(lat: Column, ts: Column) -> dict[str, Column]:
    """Day length and noon elevation from latitude and day of year; fixed values without a latitude."""
    declination = F.sin(F.radians((F.dayofyear(ts) + 284) * 360 / F.lit(365.0))) * 23.45
    cos_hour = clip(-F.tan(F.radians(lat)) * F.tan(F.radians(declination)), -1.0, 1.0)
    length = F.degrees(F.acos(cos_hour)) * 2 / 15
    elevation = F.lit(90.0) - F.abs(lat - declination)
    return {
        "day_length_hours": F.coalesce(length, F.lit(UNKNOWN_DAY_LENGTH)),
        "solar_elevation_noon": F.coalesce(elevation, F.lit(UNKNOWN_ELEVATION)),
    }
