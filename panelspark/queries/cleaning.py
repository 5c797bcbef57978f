"""Grid, gap fill, anomalies, bounds, de-duplication, upsert and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import cleaning, joins, splits, upsert
from panelspark.queries import adapters as a
from panelspark.queries.adapters import r, tidy


def hourly_grid(spark: SparkSession, d: str) -> DataFrame:
    return tidy(a.hourly_grid(spark, d))


HOURLY_GRID = f"WITH {a.HOURLY_GRID_SQL} SELECT respondent, period, {a.cols('demand_mw eia_forecast_mw ng ti')} FROM hourly_grid"


def _fill_sql(source: str, keys: str, value: str, unit: str, gap: int) -> str:
    """Nearest known values over the whole series, run length from their times."""
    return f"""
known AS (
  SELECT {keys}, period, {value} AS v,
    last_value({value} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv,
    last_value(CASE WHEN {value} IS NOT NULL THEN period END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt,
    first_value({value} IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nv,
    first_value(CASE WHEN {value} IS NOT NULL THEN period END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt,
    max(period) OVER (PARTITION BY {keys}) AS hi
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY period)),
filled AS (
  SELECT {keys}, period, v,
    CASE WHEN v IS NOT NULL THEN v WHEN pt IS NULL THEN NULL
         WHEN nt IS NOT NULL THEN CASE WHEN date_diff('{unit}', pt, nt) - 1 <= {gap}
              THEN pv + (nv - pv) * date_diff('{unit}', pt, period) / date_diff('{unit}', pt, nt) END
         WHEN date_diff('{unit}', pt, hi) <= {gap} THEN pv END AS value_filled
  FROM known)"""


FILLED_COLS = f"{r('value_filled')} AS value_filled, CAST(CASE WHEN v IS NULL AND value_filled IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS is_imputed"


def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one missing hour are filled, longer runs stay empty."""
    grid = a.hourly_grid(spark, d).select("respondent", "period", "demand_mw")
    return tidy(cleaning.fill_gaps(grid, a.HOURLY_SHORT, "demand_mw", max_gap=1).drop("demand_mw"))


GAP_FILL = f"""WITH {a.HOURLY_GRID_SQL}, {_fill_sql('hourly_grid', 'respondent', 'demand_mw', 'HOUR', 1)}
SELECT respondent, period, {FILLED_COLS} FROM filled"""


def gap_fill_edges(spark: SparkSession, d: str) -> DataFrame:
    """Daily series after the absolute bounds: longer runs, also at both ends of a series."""
    grid = cleaning.regular_grid(a.daily_nation(spark, d), a.DAILY)
    bounded = cleaning.absolute_bounds(grid, "demand_mw").select("respondent", "period", "demand_mw")
    return tidy(cleaning.fill_gaps(bounded, a.DAILY, "demand_mw", max_gap=3).drop("demand_mw"))


GAP_FILL_EDGES = f"""WITH {a.NATION_SQL},
bounded AS (SELECT respondent, period, CASE WHEN demand_mw > 0 AND demand_mw <= 500000 THEN demand_mw END AS demand_mw FROM nation_daily_grid),
{_fill_sql('bounded', 'respondent', 'demand_mw', 'DAY', 3)}
SELECT respondent, period, {FILLED_COLS} FROM filled"""


def _anomalies(threshold: float):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return tidy(cleaning.clean_series(a.hourly_long(spark, d), a.TYPED, "value", threshold=threshold))

    return query


def _anomaly_sql(threshold: float, digits: int | None = 6) -> str:
    value = "value_filled" if digits is None else r("value_filled", digits)
    return f"""WITH {a.HOURLY_LONG_SQL},
points AS (
  SELECT respondent, type, unnest(generate_series(min(period), max(period), INTERVAL 1 HOUR)) AS period
  FROM hourly_long GROUP BY respondent, type),
grid AS (
  SELECT p.respondent, p.type, p.period, value FROM points p
  LEFT JOIN hourly_long h ON h.respondent = p.respondent AND h.type = p.type AND h.period = p.period),
{_fill_sql('grid', 'respondent, type', 'value', 'HOUR', 6)},
stats AS (
  SELECT *, count(value_filled) OVER w AS n, avg(value_filled) OVER w AS m, stddev_samp(value_filled) OVER w AS s
  FROM filled WINDOW w AS (PARTITION BY respondent, type ORDER BY period ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING))
SELECT respondent, type, period, {value} AS value_mwh,
       CAST(CASE WHEN v IS NULL AND value_filled IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS is_imputed,
       CAST(CASE WHEN n >= 24 AND s > 0 AND abs(value_filled - m) / s > {threshold} THEN 1 ELSE 0 END AS INTEGER) AS is_anomaly
FROM stats"""


def centered_stats(spark: SparkSession, d: str) -> DataFrame:
    """Centred mean and deviation behind the anomaly flag, on demand with all short gaps left empty."""
    grid = a.hourly_grid(spark, d).select("respondent", "period", "demand_mw")
    out = cleaning.flag_anomalies(grid, a.HOURLY, "demand_mw", threshold=3.0, keep_stats=True)
    return tidy(out.select("respondent", "period", F.col("_mean").alias("mean_168h"),
                           F.col("_std").alias("std_168h"), "is_anomaly"))


CENTERED_STATS = f"""WITH {a.HOURLY_GRID_SQL},
stats AS (
  SELECT respondent, period, demand_mw, count(demand_mw) OVER w AS n, avg(demand_mw) OVER w AS m, stddev_samp(demand_mw) OVER w AS s
  FROM hourly_grid WINDOW w AS (PARTITION BY respondent ORDER BY period ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING))
SELECT respondent, period, CASE WHEN n >= 24 THEN {r('m')} END AS mean_168h, CASE WHEN n >= 24 THEN {r('s')} END AS std_168h,
       CAST(CASE WHEN n >= 24 AND s > 0 AND abs(demand_mw - m) / s > 3 THEN 1 ELSE 0 END AS INTEGER) AS is_anomaly
FROM stats"""


def clean_bounds(spark: SparkSession, d: str) -> DataFrame:
    return tidy(cleaning.absolute_bounds(a.daily_region(spark, d), "demand_mw", "eia_forecast_mw"))


CLEAN_BOUNDS = f"""WITH {a.DAILY_SQL}
SELECT respondent, period, CASE WHEN demand_mw > 0 AND demand_mw <= 500000 THEN {r('demand_mw')} END AS demand_mw,
       CASE WHEN eia_forecast_mw > 0 AND eia_forecast_mw <= 500000 THEN {r('eia_forecast_mw')} END AS eia_forecast_mw
FROM daily"""


def clean_p95_cap(spark: SparkSession, d: str) -> DataFrame:
    daily = a.daily_region(spark, d).select("respondent", "period", "demand_mw")
    return tidy(cleaning.statistical_cap(daily, a.DAILY, "demand_mw", factor=1.5))


CLEAN_P95_CAP = f"""WITH {a.DAILY_SQL},
caps AS (SELECT respondent, count(demand_mw) AS n, greatest(1.5 * quantile_cont(demand_mw, 0.95), 1000) AS cap FROM daily GROUP BY 1)
SELECT d.respondent, period, CASE WHEN n <= 100 OR demand_mw <= cap THEN {r('demand_mw')} END AS demand_mw
FROM daily d JOIN caps c ON c.respondent = d.respondent"""


def keep_first(spark: SparkSession, d: str) -> DataFrame:
    """First event per type and hour, in event order."""
    ev = a.table(spark, d, "events").select(
        F.col("event_type").alias("respondent"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("period"),
        "event_id", "value")
    return tidy(cleaning.keep_first(ev, a.HOURLY, ["event_id"]))


KEEP_FIRST = f"""SELECT event_type AS respondent, date_trunc('hour', ts) AS period, event_id, {r('value')} AS value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) = 1"""


def series_meta(spark: SparkSession, d: str) -> DataFrame:
    ev = a.table(spark, d, "events").select(
        F.col("event_type").alias("respondent"), F.col("ts").alias("period"), "user_id", "props")
    return cleaning.series_meta(ev, a.HOURLY, ["user_id", "props"])


SERIES_META = """SELECT event_type AS respondent, user_id, props FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts) = 1"""


def clean_stats(spark: SparkSession, d: str) -> DataFrame:
    cleaned = cleaning.clean_series(a.hourly_long(spark, d), a.TYPED, "value", threshold=3.0)
    return cleaning.clean_stats(cleaned, ["respondent", "type"])


CLEAN_STATS = f"""SELECT respondent, type, count(*) AS n_rows, CAST(sum(is_imputed) AS BIGINT) AS n_imputed,
       CAST(sum(is_anomaly) AS BIGINT) AS n_anomaly FROM ({_anomaly_sql(3.0)}) GROUP BY 1, 2"""


def generic_clean(spark: SparkSession, d: str) -> DataFrame:
    """Line item quantities as text, with a mark that is not a number, without full-row duplicates."""
    li = a.table(spark, d, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_linenumber",
        F.when(F.col("l_quantity") < 3, F.lit("n/a")).otherwise(F.col("l_quantity").cast("int").cast("string")).alias("value"))
    return tidy(cleaning.generic_clean(li))


GENERIC_CLEAN = """SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber,
  CASE WHEN l_quantity < 3 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) END AS value FROM lineitem"""


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Events as repeated corrections of an hour: last value, name of the first insert."""
    ev = a.table(spark, d, "events").select(
        F.col("event_type").alias("respondent"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("period"),
        "value", F.col("user_id").alias("respondent_name"), "event_id")
    return tidy(upsert.merge_rows(ev, ["respondent", "period"], "event_id", ["value"], ["respondent_name"]))


UPSERT_LATEST = f"""SELECT event_type AS respondent, date_trunc('hour', ts) AS period,
  {r('arg_max(value, event_id)')} AS value, arg_min(user_id, event_id) AS respondent_name FROM events GROUP BY 1, 2"""


def flag_join(spark: SparkSession, d: str) -> DataFrame:
    """Demand hours with the flags of the generation among the cleaned series; hours without a cleaned row get 0."""
    flags = cleaning.clean_series(a.hourly_long(spark, d).where("value IS NOT NULL"), a.TYPED, "value", threshold=3.0).where("type = 'NG'").drop("type")
    spine = a.hourly_wide(spark, d).select("respondent", "period", F.col("D").alias("demand_mw"))
    return tidy(joins.with_flags(spine, flags, a.HOURLY))


FLAG_JOIN = f"""WITH {a.HOURLY_LONG_SQL},
ng_rows AS (SELECT respondent, period, value FROM hourly_long WHERE type = 'NG' AND value IS NOT NULL),
points AS (SELECT respondent, unnest(generate_series(min(period), max(period), INTERVAL 1 HOUR)) AS period FROM ng_rows GROUP BY 1),
grid AS (SELECT p.respondent, p.period, value FROM points p LEFT JOIN ng_rows n ON n.respondent = p.respondent AND n.period = p.period),
{_fill_sql('grid', 'respondent', 'value', 'HOUR', 6)},
stats AS (
  SELECT *, count(value_filled) OVER w AS n, avg(value_filled) OVER w AS m, stddev_samp(value_filled) OVER w AS s
  FROM filled WINDOW w AS (PARTITION BY respondent ORDER BY period ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING)),
flags AS (
  SELECT respondent, period, CASE WHEN v IS NULL AND value_filled IS NOT NULL THEN 1 ELSE 0 END AS is_imputed,
         CASE WHEN n >= 24 AND s > 0 AND abs(value_filled - m) / s > 3 THEN 1 ELSE 0 END AS is_anomaly FROM stats)
SELECT h.respondent, h.period, {r('d')} AS demand_mw, CAST(coalesce(is_imputed, 0) AS INTEGER) AS is_imputed,
       CAST(coalesce(is_anomaly, 0) AS INTEGER) AS is_anomaly
FROM hourly_wide h LEFT JOIN flags f ON f.respondent = h.respondent AND f.period = h.period"""


def warmup_drop(spark: SparkSession, d: str) -> DataFrame:
    grid = a.hourly_grid(spark, d).select("respondent", "period", "demand_mw")
    return tidy(splits.drop_warmup(grid, a.HOURLY_SHORT, "demand_mw"))


WARMUP_DROP = f"""WITH {a.HOURLY_GRID_SQL},
placed AS (SELECT respondent, period, demand_mw, row_number() OVER (PARTITION BY respondent ORDER BY period) AS pos FROM hourly_grid)
SELECT respondent, period, {r('demand_mw')} AS demand_mw FROM placed WHERE pos > 168 AND demand_mw IS NOT NULL"""


QUERIES = {
    "hourly_grid": (hourly_grid, HOURLY_GRID),
    "gap_fill": (gap_fill, GAP_FILL),
    "gap_fill_edges": (gap_fill_edges, GAP_FILL_EDGES),
    "anomaly_flags": (_anomalies(4.0), _anomaly_sql(4.0)),
    "anomaly_flags_3std": (_anomalies(3.0), _anomaly_sql(3.0)),
    "centered_stats": (centered_stats, CENTERED_STATS),
    "clean_bounds": (clean_bounds, CLEAN_BOUNDS),
    "clean_p95_cap": (clean_p95_cap, CLEAN_P95_CAP),
    "keep_first": (keep_first, KEEP_FIRST),
    "series_meta": (series_meta, SERIES_META),
    "clean_stats": (clean_stats, CLEAN_STATS),
    "generic_clean": (generic_clean, GENERIC_CLEAN),
    "upsert_latest": (upsert_latest, UPSERT_LATEST),
    "flag_join": (flag_join, FLAG_JOIN),
    "warmup_drop": (warmup_drop, WARMUP_DROP),
}
