"""Parsing of raw text, JSON pages, weather responses, logs and progress documents made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from panelspark.plans import reports
from panelspark.queries import adapters as a
from panelspark.queries.adapters import cols, r, tidy
from panelspark.queries.scoring import VERSUS_SQL, _versus
from panelspark.session import checkpoint_root
from panelspark.sources import json_pages, raw_csv, registry as reg, tables


def _raw_text(spark: SparkSession, d: str) -> DataFrame:
    """Hourly rows as raw text: some periods cannot be read, some values are no numbers."""
    rows = a.hourly_long(spark, d)
    text = F.date_format("period", "yyyy-MM-dd'T'HH")
    period = F.when((F.hour("period") == 5) & (F.col("type") == "D"), F.concat(F.lit("2024-13-"), F.substring(text, 9, 5))).otherwise(text)
    value = F.when(F.hour("period") == 7, F.lit("n/a")).otherwise(F.col("value").cast("long").cast("string"))
    return rows.select(period.alias("period"), "respondent", F.col("type"), F.col("type").alias("type-name"), value.alias("value"))


def _raw_files(spark: SparkSession, d: str) -> str:
    """The raw rows as CSV files of the endpoint, written by Spark."""
    path = f"{checkpoint_root(spark)}/raw-{uuid.uuid4().hex}"
    names = raw_csv.ENDPOINTS["region-data"]
    text = _raw_text(spark, d).select(*[F.col(f"`{c}`") if c in ("period", "respondent", "type", "type-name", "value") else F.lit("x").alias(c) for c in names])
    # the writer chooses file names; the folder carries the name of the endpoint
    text.write.option("header", True).csv(f"{path}/region-data")
    return f"{path}/region-data"


def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Real files, written from the table and read back as text; columns are checked against the headers."""
    good, _ = raw_csv.parse_raw(raw_csv.read_files(spark, _raw_files(spark, d), "region-data"))
    return tidy(raw_csv.table_columns(good, "region-data"))


CSV_SCAN = f"""WITH {a.HOURLY_LONG_SQL}
SELECT respondent, 'x' AS respondent_name, period, type, type AS type_name, CASE WHEN hour(period) <> 7 THEN {r('value')} END AS value_mwh
FROM hourly_long WHERE NOT (hour(period) = 5 AND type = 'D')"""


def csv_rejected(spark: SparkSession, d: str) -> DataFrame:
    _, rejected = raw_csv.parse_raw(_raw_text(spark, d))
    return rejected.groupBy("respondent", "type").agg(F.count(F.lit(1)).alias("n_rejected"))


CSV_REJECTED = f"WITH {a.HOURLY_LONG_SQL} SELECT respondent, type, count(*) AS n_rejected FROM hourly_long WHERE hour(period) = 5 AND type = 'D' GROUP BY 1, 2"


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Endpoint and region code read from file names, one per customer segment, nation and endpoint."""
    eps = F.explode(F.array(*[F.lit(e) for e in raw_csv.ENDPOINTS])).alias("ep")
    names = a.table(spark, d, "customer").select("c_mktsegment", "c_custkey", eps).select(
        F.concat(F.substring("c_mktsegment", 1, 4), F.col("c_custkey").cast("string"), F.lit("_20240101_20240130_"), F.upper("ep"), F.lit(".csv")).alias("file_name"))
    return names.select(raw_csv.endpoint_of(F.col("file_name")).alias("endpoint"), raw_csv.code_of(F.col("file_name")).alias("code"))


FILE_NAMES = """SELECT ep AS endpoint, substr(c_mktsegment, 1, 4) || CAST(c_custkey AS VARCHAR) AS code FROM customer,
(VALUES ('region-sub-ba-data'), ('fuel-type-data'), ('interchange-data'), ('region-data')) e(ep)"""


def period_text(spark: SparkSession, d: str) -> DataFrame:
    """Order dates as period text; dates that already carry a time are kept."""
    from panelspark.functions.calendar import date_to_period

    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    mixed = F.when(F.col("o_orderkey") % 3 == 0, F.concat(text, F.lit("T07"))).otherwise(F.concat(F.lit(" "), text))
    return a.table(spark, d, "orders").select("o_orderkey", date_to_period(mixed, 0).alias("start_period"), date_to_period(mixed, 23).alias("end_period"))


PERIOD_TEXT = """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 0 THEN 'T07' ELSE 'T00' END AS start_period,
strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 0 THEN 'T07' ELSE 'T23' END AS end_period FROM orders"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """One JSON page per region and day (at most 96 rows); every tenth day is an error page."""
    row = F.struct("period", "respondent", "type", F.col("type-name"), "value")
    raw = _raw_text(spark, d).withColumn("day", F.substring("period", 1, 10))
    packed = raw.groupBy("respondent", "day").agg(F.collect_list(row).alias("data"))
    page = F.to_json(F.struct(F.struct(F.col("data"), F.size("data").alias("total")).alias("response")))
    error = F.to_json(F.struct(F.concat(F.lit("no data for "), F.col("day")).alias("error")))
    bad = F.col("day").endswith("0")
    return packed.select("respondent", "day", F.when(bad, error).otherwise(page).alias("doc"))


def json_rows(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = json_pages.parse_pages(_pages(spark, d))
    return tidy(rows.drop("fetched_at"))


JSON_ROWS = f"""WITH {a.HOURLY_LONG_SQL}
SELECT respondent, period, type, type AS type_name, CASE WHEN hour(period) <> 7 THEN {r('value')} END AS value_mwh
FROM hourly_long WHERE NOT (hour(period) = 5 AND type = 'D') AND day(period) % 10 <> 0"""


def json_errors(spark: SparkSession, d: str) -> DataFrame:
    _, errors = json_pages.parse_pages(_pages(spark, d))
    return errors


JSON_ERRORS = f"""WITH {a.HOURLY_LONG_SQL},
days AS (
  SELECT DISTINCT respondent, CASE WHEN hour(period) = 5 AND type = 'D' THEN '2024-13-' || strftime(period, '%d') ELSE strftime(period, '%Y-%m-%d') END AS day
  FROM hourly_long WHERE day(period) % 10 = 0)
SELECT respondent, day, 'no data for ' || day AS error_msg FROM days"""


def _responses(spark: SparkSession, d: str) -> DataFrame:
    names = {"temp_2m": "temperature_2m", "dewpoint_2m": "dewpoint_2m", "windspeed_10m": "windspeed_10m", "precipitation": "precipitation"}
    w = a.weather_hourly(spark, d)
    row = F.struct(F.when((F.day("period") % 10 == 0) & (F.hour("period") == 5), F.date_format("period", "yyyy-MM-dd'T'25:mm")).otherwise(
        F.date_format("period", "yyyy-MM-dd'T'HH:mm")).alias("time"), *[F.col(c).alias(n) for c, n in names.items()])
    packed = w.groupBy("respondent", F.to_date("period").alias("day")).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    full = F.to_json(F.struct(F.struct(*[F.col(f"_r.{n}").alias(n) for n in ("time", *names.values())]).alias("hourly")))
    part = F.to_json(F.struct(F.struct(*[F.col(f"_r.{n}").alias(n) for n in ("time", *list(names.values())[:3])]).alias("hourly")))
    docs = packed.select("respondent", F.when(F.day("day") % 3 == 0, part).otherwise(full).alias("doc"))
    return docs


def weather_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one response per type and day with parallel arrays (at most 24 entries); some days lack a variable, one hour of every tenth day cannot be read."""
    rows, _ = json_pages.parse_weather(_responses(spark, d), ["respondent"])
    return tidy(rows.select("respondent", "period", "temp_2m", "dewpoint_2m", "windspeed_10m", "precipitation", "solar_irradiance"))


def weather_errors(spark: SparkSession, d: str) -> DataFrame:
    """What could not be read of the same responses."""
    _, errors = json_pages.parse_weather(_responses(spark, d), ["respondent"])
    return errors


WEATHER_JSON = f"""WITH {a.WEATHER_SQL} SELECT respondent, period, {cols('temp_2m dewpoint_2m windspeed_10m')},
CASE WHEN day(period) % 3 <> 0 THEN {r('precipitation')} END AS precipitation, CAST(NULL AS DOUBLE) AS solar_irradiance FROM weather_hourly WHERE NOT (day(period) % 10 = 0 AND hour(period) = 5)"""

WEATHER_ERRORS = f"""WITH {a.WEATHER_SQL} SELECT respondent, strftime(period, '%Y-%m-%dT25:%M') AS time, 'time cannot be read' AS error_msg
FROM weather_hourly WHERE day(period) % 10 = 0 AND hour(period) = 5"""


def _fetches(spark: SparkSession, d: str) -> DataFrame:
    """Orders per priority (endpoint) and customer group (code) as fetches; some fail."""
    o = a.table(spark, d, "orders")
    runs = o.groupBy(F.col("o_orderpriority").alias("endpoint"), F.concat(F.lit("C"), (F.col("o_custkey") % 40).cast("string")).alias("code")).agg(
        F.count(F.lit(1)).alias("rows"))
    return runs.withColumn("failed", F.col("rows") % 5 == 0)


FETCHES_SQL = """fetches AS (
  SELECT o_orderpriority AS endpoint, 'C' || CAST(o_custkey % 40 AS VARCHAR) AS code, count(*) AS n, count(*) % 5 = 0 AS failed FROM orders GROUP BY 1, 2)"""


def progress_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The nested progress document, written as JSON and read back (40 codes per endpoint)."""
    f = _fetches(spark, d)
    status = F.struct(F.when(F.col("failed"), "failed").otherwise("done").alias("status"), F.col("rows"))
    codes = f.groupBy("endpoint").agg(F.map_from_entries(F.collect_list(F.struct("code", status))).alias("m"))
    docs = codes.select(F.to_json(F.create_map("endpoint", "m")).alias("doc"))
    return json_pages.progress_rollup(json_pages.progress_rows(docs))


PROGRESS_ROLLUP = f"""WITH {FETCHES_SQL}
SELECT endpoint, count(CASE WHEN NOT failed THEN 1 END) AS n_done, count(CASE WHEN failed THEN 1 END) AS n_failed,
  CAST(coalesce(sum(CASE WHEN NOT failed THEN n END), 0) AS BIGINT) AS total_rows, coalesce(string_agg(CASE WHEN failed THEN code END, ', ' ORDER BY code), '') AS failed_codes
FROM fetches GROUP BY 1"""


def ingest_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A log in which failed fetches of an even number of rows were tried again with success, and every fetch had failed a day earlier."""
    log = _fetches(spark, d).select(
        "endpoint", F.col("code").alias("respondent"), F.col("rows").alias("rows_ingested"),
        F.when(F.col("failed"), "error").otherwise("success").alias("status"), F.lit("2024-01-02 00:00:00").cast("timestamp").alias("run_at"))
    before = log.withColumns({"status": F.lit("error"), "run_at": F.lit("2024-01-01 00:00:00").cast("timestamp")})
    again = log.where("status = 'error' AND rows_ingested % 2 = 0").withColumns({"status": F.lit("success"), "run_at": F.lit("2024-01-03 00:00:00").cast("timestamp")})
    log = log.unionByName(before).unionByName(again)
    return reports.ingest_rollup(log)


INGEST_ROLLUP = f"""WITH {FETCHES_SQL}, latest AS (SELECT endpoint, code, n, failed AND n % 2 <> 0 AS failed FROM fetches)
SELECT endpoint, count(CASE WHEN NOT failed THEN 1 END) AS n_success, count(CASE WHEN failed THEN 1 END) AS n_failed,
  CAST(coalesce(sum(CASE WHEN NOT failed THEN n END), 0) AS BIGINT) AS rows_ingested, coalesce(string_agg(CASE WHEN failed THEN code END, ',' ORDER BY code), '') AS failed
FROM latest GROUP BY 1"""


def fetch_plan(spark: SparkSession, d: str) -> DataFrame:
    return tidy(reg.fetch_plan(reg.select_regions(a.registry(spark, d))))


FETCH_PLAN = f"""WITH {a.REGISTRY_SQL}
SELECT coalesce(endpoint, 'total') AS endpoint, count(DISTINCT code) AS n_regions, CAST(sum(n) AS BIGINT) AS est_rows, {r('sum(n) / 5000')} AS est_pages, {r('sum(n) / 5000 * 0.5e0 / 3600')} AS est_hours
FROM registry, (VALUES ('region-data', 254760), ('fuel-type-data', 456871), ('interchange-data', 624813), ('region-sub-ba-data', 381739)) e(endpoint, n)
WHERE enabled GROUP BY GROUPING SETS ((endpoint), ())"""


def log_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Run logs written from the scores (one line per nation), then read back."""
    v = _versus(spark, d)

    def whole(c: str):
        return F.coalesce(F.format_number(F.floor(c), 0), F.lit("nan"))

    line = F.concat(
        F.lit("  Baselines:  EIA DF RMSE="), F.lpad(whole("benchmark_rmse"), 12, " "), F.lit("\n    "), F.col("model"), F.lit("  RMSE="),
        F.lpad(whole("rmse"), 12, " "), F.lit("\n      vs EIA DF: "), F.coalesce(F.col("vs_benchmark_pct").cast("string"), F.lit("nan")), F.lit("%  "), F.col("verdict"), F.lit("\n"))
    logs = v.groupBy("model").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("log"))
    return tidy(tables.log_leaderboard(logs, complete=25))


LOG_LEADERBOARD = f"""WITH {VERSUS_SQL}
SELECT model, CAST(count(CASE WHEN verdict = 'BEAT' THEN 1 END) AS INTEGER) AS beats, CAST(count(*) AS INTEGER) AS total, {r('avg(floor(benchmark_rmse))')} AS benchmark_mean,
  {r('avg(floor(rmse))')} AS model_mean, {r('100 * (avg(floor(rmse)) - avg(floor(benchmark_rmse))) / avg(floor(benchmark_rmse))')} AS diff_pct,
  CASE WHEN count(*) = 25 THEN 'DONE' ELSE 'running' END AS status FROM versus GROUP BY 1"""


QUERIES = {
    "csv_scan": (csv_scan, CSV_SCAN),
    "csv_rejected": (csv_rejected, CSV_REJECTED),
    "file_names": (file_names, FILE_NAMES),
    "period_text": (period_text, PERIOD_TEXT),
    "json_pages": (json_rows, JSON_ROWS),
    "json_errors": (json_errors, JSON_ERRORS),
    "weather_json": (weather_json, WEATHER_JSON),
    "weather_errors": (weather_errors, WEATHER_ERRORS),
    "progress_rollup": (progress_rollup, PROGRESS_ROLLUP),
    "ingest_rollup": (ingest_rollup, INGEST_ROLLUP),
    "fetch_plan": (fetch_plan, FETCH_PLAN),
    "log_leaderboard": (log_leaderboard, LOG_LEADERBOARD),
}
