"""Feature tables, weather caches, result files and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.weather import CORE
from panelspark.sources.raw_csv import code_of

#: Runs that a complete log holds.
COMPLETE_RUNS = 51


def write_features(df: DataFrame, path: str, key: str = "respondent") -> None:
    """One Parquet dataset, one folder per region. Regions without rows get no folder."""
    df.write.mode("overwrite").partitionBy(key).option("maxRecordsPerFile", 5_000_000).parquet(path)


def read_features(spark: SparkSession, path: str, codes: list[str] | None = None, key: str = "respondent") -> DataFrame:
    """Read all regions, or only the folders of the given codes."""
    df = spark.read.parquet(path)
    return df.where(F.col(key).isin(*codes)) if codes else df


def write_results(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("header", True).csv(path)


def read_weather_cache(spark: SparkSession, path: str, columns: tuple[str, ...] = CORE) -> DataFrame:
    """Cached weather of all regions in a fixed column order.

    The region comes from the file name if the files have no such column; measures a file lacks are NULL.
    """
    df = spark.read.option("mergeSchema", True).parquet(path)
    from_file = code_of(F.col("_metadata.file_name"))
    if "respondent" in df.columns:
        code = F.coalesce(F.col("respondent"), from_file)
    else:
        code = from_file
    measures = [
        (F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c) for c in columns
    ]
    name = next(c for c in ("period", "time", "__index_level_0__") if c in df.columns)
    time = F.col(name)
    if dict(df.dtypes)[name] == "bigint":  # nanoseconds
        time = F.timestamp_micros(F.floor(time / 1000))
    return df.select(time.cast("timestamp_ntz").alias("period"), code.alias("respondent"), *measures)


def add_late_columns(cache: DataFrame, late: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Add or complete columns that arrived later, matched by key."""
    found = late.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = cache.join(found, keys, "left")
    fill = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in cache.columns else F.col(f"_{c}") for c in columns}
    return joined.withColumns(fill).drop(*[f"_{c}" for c in columns])


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row (model, log) per log file; the file stem names the model."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("model"), F.col("value").alias("log"))


def log_leaderboard(logs: DataFrame, complete: int = COMPLETE_RUNS) -> DataFrame:
    """Wins, runs and mean RMSE of the model and of the official forecast, read from run logs."""
    def numbers(pattern) -> Column:
        found = F.regexp_extract_all("log", pattern, F.lit(1))
        return F.transform(found, lambda x: F.regexp_replace(x, ",", "").cast("double"))

    def mean(values) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
        return F.coalesce(F.try_divide(total, F.size(values)), F.lit(0.0))

    own = F.concat(F.regexp_replace("model", r"([^A-Za-z0-9_])", r"\\$1"), F.lit(r"\s+RMSE=\s*([\d,]+)"))
    out = logs.select(
        "model", F.regexp_count("log", F.lit("BEAT")).alias("beats"), F.regexp_count("log", F.lit("vs EIA DF")).alias("total"),
        mean(numbers(F.lit(r"EIA DF RMSE=\s*([\d,]+)"))).alias("benchmark_mean"), mean(numbers(own)).alias("model_mean"),
    )
    diff = F.coalesce(F.try_divide((F.col("model_mean") - F.col("benchmark_mean")) * 100, F.col("benchmark_mean")), F.lit(0.0))
    status = F.when(F.col("total") == 0, "not started").when(F.col("total") == complete, "DONE").otherwise("running")
    return out.withColumns({"diff_pct": diff, "status": status})
