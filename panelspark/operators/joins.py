"""Alignment, pivots, time-offset joins and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.blocks import lead, over_blocks
from panelspark.panel import Panel

REGION_TYPES = ("D", "DF", "NG", "TI")


def series_scan(df: DataFrame, respondent: str, dtype: str, start: str | None = None,
                end: str | None = None, ts: str = "period") -> DataFrame:
    """One series, both ends inclusive, in time order. All filters reach the scan."""
    out = df.where((F.col("respondent") == respondent) & (F.col("type") == dtype))
    if start:
        out = out.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return out.orderBy(ts)


def wide(df: DataFrame, panel: Panel, column: str, codes: tuple[str, ...], value: str = "value",
         names: dict[str, str] | None = None) -> DataFrame:
    """Codes side by side, outer aligned on the time; one aggregate with a fixed list of codes."""
    names = names or {}
    cols = [F.max(F.when(F.col(column) == c, F.col(value))).alias(names.get(c, c)) for c in codes]
    return df.groupBy(*panel.keys, panel.ts).agg(*cols)


def fuel_wide(df: DataFrame, panel: Panel, codes: tuple[str, ...], value: str = "value",
              base: tuple[str, ...] = ()) -> DataFrame:
    """Fuel columns per time. A base fuel a series never reports is 0, not missing."""
    out = wide(df, panel, "fueltype", codes, value)
    seen = df.where(F.col("fueltype").isin(*base) & F.col(value).isNotNull()) if base else None
    if seen is None:
        return out
    known = seen.groupBy(*panel.keys).agg(F.collect_set("fueltype").alias("_known"))  # at most len(base) codes
    out = out.join(known, list(panel.keys), "left")
    never = {c: ~F.coalesce(F.array_contains("_known", c), F.lit(False)) for c in base}
    return out.withColumns({c: F.when(never[c], F.lit(0.0)).otherwise(F.col(c)) for c in base}).drop("_known")


def align(spine: DataFrame, panel: Panel, *others: DataFrame) -> DataFrame:
    """Left joins on (keys, time). All sides share one partitioning, so the spine moves once."""
    on = [*panel.keys, panel.ts]
    for other in others:
        spine = spine.join(other, on, "left")
    return spine


def with_flags(spine: DataFrame, flags: DataFrame, panel: Panel,
               cols: tuple[str, ...] = ("is_imputed", "is_anomaly")) -> DataFrame:
    """Add flag columns; rows without a flag get 0."""
    on = [*panel.keys, panel.ts]
    return spine.join(flags.select(*on, *cols), on, "left").fillna(0, list(cols))


def difference(all_codes: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Codes of the first frame that the second does not hold."""
    return all_codes.join(present.select(*on).distinct(), on, "left_anti")


def target_rebuild(df: DataFrame, panel: Panel, fallback: Column, lag_24: str = "lag_24h",
                   out: str = "y_rebuilt") -> DataFrame:
    """Target at t from the one-day lag found at t + 24, else the lag at t, else ``fallback``."""
    ahead = over_blocks(df, panel, {"_ahead": lead(lag_24, 24)})
    return ahead.withColumn(out, F.coalesce("_ahead", F.col(lag_24), fallback)).drop("_ahead")


def horizon_pick(df: DataFrame, forecasts: DataFrame, panel: Panel, hours: int = 24,
                 lag_24: str = "lag_24h", out: str = "prediction") -> DataFrame:
    """Forecast made exactly ``hours`` before the target time (mean of duplicates), else the lag."""
    lead_time = F.unix_seconds(F.col("ds").cast("timestamp")) - F.unix_seconds(F.col("cutoff").cast("timestamp"))
    at = forecasts.where(lead_time == hours * 3600).groupBy(*panel.keys, F.col("ds").alias(panel.ts)).agg(
        F.avg("yhat").alias("_yhat")
    )
    joined = df.join(at, [*panel.keys, panel.ts], "left")
    return joined.withColumn(out, F.coalesce("_yhat", lag_24)).drop("_yhat")
