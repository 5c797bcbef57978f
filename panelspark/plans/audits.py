"""Data-quality and completeness checks per region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.nulls import nan_to_null
from panelspark.operators.quantiles import exact_quantiles
from panelspark.session import stored

HIGH = 500_000.0
OUTLIER_FACTOR = 10.0
MAX_MISSING = 0.02


def quality_audit(df: DataFrame, key: str, demand: str = "demand_mw", forecast: str = "eia_forecast_mw") -> DataFrame:
    """Counts of impossible values, outliers and missing values with an issue list and a verdict."""
    d, f = F.col(demand), F.col(forecast)
    df = stored(df)
    median = exact_quantiles(df, [key], demand, {"median": 0.5})

    def hits(condition: Column, name: str) -> Column:
        return F.count(F.when(condition, 1)).alias(name)

    stats = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(demand).alias("max_demand"),
        hits(d > HIGH, "n_overflow"), hits(d < 0, "n_negative"), hits(d == 0, "n_zero"),
        hits(f > HIGH, "n_forecast_overflow"), hits(f < 0, "n_forecast_negative"), hits(f == 0, "n_forecast_zero"),
        hits(d.isNull(), "n_missing"),
    ).join(median, key, "left")
    missing = F.col("n_missing") / F.col("n_rows")
    issues = [
        F.when(F.col("n_overflow") > 0, "OVERFLOW"), F.when(F.col("n_negative") > 0, "NEGATIVE"),
        F.when(F.col("n_zero") > 0, "ZERO"), F.when(F.col("n_forecast_overflow") > 0, "EIA_OVERFLOW"),
        F.when(F.col("n_forecast_negative") > 0, "EIA_NEG"), F.when(F.col("n_forecast_zero") > 0, "EIA_ZERO"),
        F.when(F.col("max_demand") > F.col("median") * OUTLIER_FACTOR, "OUTLIER"),
        F.when(missing > MAX_MISSING, "HIGH_NaN"),
    ]
    listed = F.array_join(F.array_compact(F.array(*issues)), "|")
    return stats.withColumn("issues", listed).withColumn(
        "verdict", F.when(F.col("issues") == "", "OK").otherwise("ISSUE")
    )


def completeness(df: DataFrame, key: str, ts: str, start: str, end: str, core: tuple[str, ...],
                 codes: DataFrame | None = None, edge_days: int = 7) -> DataFrame:
    """First failing reason per region, or ``Valid``. Regions of ``codes`` without rows are empty."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    edge = F.make_dt_interval(F.lit(edge_days))
    hours = (F.unix_seconds(hi.cast("timestamp")) - F.unix_seconds(lo.cast("timestamp"))) / 3600
    stats = df.groupBy(key).agg(
        F.min(ts).alias("first_period"), F.max(ts).alias("last_period"), F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"_null_{c}") for c in core],
    )
    if codes is not None:
        stats = codes.select(key).join(stats, key, "left").fillna(0, ["n_rows"])
    reason = F.when(F.col("n_rows") == 0, "Empty dataframe")
    reason = reason.when(F.col("first_period") > lo + edge, "Start date too late")
    reason = reason.when(F.col("last_period") < hi - edge, "End date too early")
    for c in core:
        reason = reason.when(F.col(f"_null_{c}") / F.col("n_rows") > 0.5, f"Too many NaN in {c}")
    reason = reason.when(F.col("n_rows") < hours * 0.9, "Too few rows").otherwise("Valid")
    return stats.select(key, "n_rows", "first_period", "last_period", reason.alias("reason")).withColumn(
        "is_valid", (F.col("reason") == "Valid").cast("int")
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def range_stats(df: DataFrame, key: str, ts: str, value: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Minimum, maximum and mean per region over a time range, both ends inclusive."""
    if start:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return df.groupBy(key).agg(
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("avg_value")
    )


def ranked_mean(df: DataFrame, key: str, ts: str, value: str, month: int | None = None) -> DataFrame:
    """Mean per region, lowest first; optionally of one month only."""
    rows = df.where(F.month(ts) == month) if month else df
    return rows.groupBy(key).agg(F.avg(value).alias("avg_value")).orderBy("avg_value", key)


def fetch_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows and share of missing values per type."""
    n, missing = F.count(F.lit(1)), F.count(F.when(F.col(value).isNull(), 1))
    return df.groupBy(by).agg(n.alias("n_rows"), (missing * 100.0 / n).alias("pct_missing"))


def correlations(df: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    """|Pearson correlation| of every feature with the target in one aggregate; 0 if undefined."""
    def corr(c: str) -> Column:
        # F.corr fails in ANSI mode for a constant column.
        x, y = F.when(F.col(target).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(target))
        return F.try_divide(F.covar_pop(c, target), F.stddev_pop(x) * F.stddev_pop(y))

    pairs = [
        F.struct(F.lit(c).alias("feature"), F.coalesce(nan_to_null(F.abs(corr(c))), F.lit(0.0)).alias("abs_corr"))
        for c in features
    ]
    return df.groupBy(*keys).agg(F.array(*pairs).alias("_p")).select(*keys, F.inline("_p"))
