"""JSON documents: API pages, weather responses and the fetch-progress document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.nulls import nan_to_null
from panelspark.sources.raw_csv import PERIOD_FORMAT

PAGE_SCHEMA = (
    "response struct<data: array<struct<period: string, respondent: string, type: string, "
    "`type-name`: string, value: string>>, total: string>, error string, message string"
)
# Names in the weather response and in our tables.
WEATHER_NAMES = {
    "temperature_2m": "temp_2m", "apparent_temperature": "apparent_temp", "dewpoint_2m": "dewpoint_2m",
    "relative_humidity_2m": "relative_humidity", "windspeed_10m": "windspeed_10m",
    "shortwave_radiation": "solar_irradiance", "cloudcover": "cloudcover", "precipitation": "precipitation",
    "surface_pressure": "surface_pressure",
}
PROGRESS_SCHEMA = (
    "map<string, map<string, struct<status: string, rows: bigint, file: string, completed_at: string, "
    "error: string, failed_at: string>>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row (doc, source_file) per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("doc"), F.col("_metadata.file_name").alias("source_file"))


def parse_pages(docs: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(rows, errors). A page without a ``response`` is an error with its message, or with the whole document if it has none.

    Rows with an unreadable period are skipped, unreadable values become NULL.
    """
    parsed = docs.withColumn("_p", F.from_json(doc, PAGE_SCHEMA))
    failed = F.col("_p.response").isNull()
    text = F.coalesce(F.col("_p.error"), F.col("_p.message"), F.col(doc))
    errors = parsed.where(failed).withColumn("error_msg", text).drop("_p", doc)
    rows = parsed.where(~failed).select(F.inline("_p.response.data"))
    period = F.try_to_timestamp("period", F.lit(PERIOD_FORMAT)).cast("timestamp_ntz")
    good = rows.select(
        period.alias("period"), F.coalesce("respondent", F.lit("")).alias("respondent"),
        F.coalesce("type", F.lit("")).alias("type"), F.coalesce("type-name", F.lit("")).alias("type_name"),
        nan_to_null(F.expr("try_cast(value AS double)")).alias("value_mwh"), F.current_timestamp().alias("fetched_at"),
    ).where("period IS NOT NULL")
    return good, errors


def parse_weather(docs: DataFrame, keep: list[str], doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(rows, errors) from parallel arrays. A variable that is absent becomes a NULL column.

    Errors are (keep, time, error_msg): a response without times, with the whole document as its message, or a row whose time cannot be read.
    """
    arrays = ", ".join(f"{n}: array<double>" for n in WEATHER_NAMES)
    parsed = docs.withColumn("_h", F.from_json(doc, f"hourly struct<time: array<string>, {arrays}>")["hourly"])
    size = F.size("_h.time")
    columns = [F.col("_h.time").alias("time")] + [
        F.coalesce(F.col(f"_h.{n}"), F.array_repeat(F.lit(None).cast("double"), size)).alias(n) for n in WEATHER_NAMES
    ]
    arrays_only = parsed.where(size > 0).select(*keep, *columns)
    rows = arrays_only.select(*keep, F.inline(F.arrays_zip("time", *WEATHER_NAMES)))
    period = F.try_to_timestamp("time", F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz")
    values = [nan_to_null(F.col(n)).alias(c) for n, c in WEATHER_NAMES.items()]
    good = rows.select(*keep, period.alias("period"), *values).where("period IS NOT NULL")
    unread = rows.where(period.isNull()).select(*keep, "time", F.lit("time cannot be read").alias("error_msg"))
    empty = parsed.where(F.coalesce(size, F.lit(-1)) <= 0).select(*keep, F.lit(None).cast("string").alias("time"), F.col(doc).alias("error_msg"))
    return good, unread.unionByName(empty)


def progress_rows(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(endpoint, code, status, rows, file, ...) from the nested progress document."""
    outer = docs.select(F.explode(F.from_json(doc, PROGRESS_SCHEMA)).alias("endpoint", "_codes"))
    return outer.select("endpoint", F.explode("_codes").alias("code", "_s")).select("endpoint", "code", "_s.*")


def progress_rollup(rows: DataFrame) -> DataFrame:
    """Done, failed, fetched rows and failed codes per endpoint."""
    done, failed = F.col("status") == "done", F.col("status") == "failed"
    return rows.groupBy("endpoint").agg(
        F.count(F.when(done, 1)).alias("n_done"), F.count(F.when(failed, 1)).alias("n_failed"),
        F.coalesce(F.sum(F.when(done, F.col("rows"))), F.lit(0)).alias("total_rows"),
        F.array_join(F.array_sort(F.collect_set(F.when(failed, F.col("code")))), ", ").alias("failed_codes"),
    )
