"""The assembled feature matrix on tables made from events."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import cleaning
from panelspark.plans import features
from panelspark.queries import adapters as a
from panelspark.queries.adapters import cols, r, tidy

FUEL_CODES = ("WND", "SUN", "COL", "NG", "NUC")


def region_table(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_series(a.hourly_long(spark, d), a.TYPED, "value", threshold=3.0)


def fuel_table(spark: SparkSession, d: str) -> DataFrame:
    """Supply by type; that of ``view`` belongs to a place that has no demand."""
    place = F.when(F.col("event_type") == "view", "elsewhere").otherwise(F.col("event_type"))
    ev = a.table(spark, d, "events").withColumn("event_type", place)
    code = F.element_at(F.array(*[F.lit(f) for f in FUEL_CODES]), (F.col("user_id") % 5 + 1).cast("int"))
    return ev.groupBy(F.col("event_type").alias("respondent"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("period"),
                      code.alias("fueltype")).agg(F.sum(a.cents("value")).cast("double").alias("value_mwh"))


def flow_table(spark: SparkSession, d: str) -> DataFrame:
    """Every event flows from its type to the type its user number names."""
    types = F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])
    to = F.element_at(types, (F.col("user_id") % 5 + 1).cast("int"))
    ev = a.table(spark, d, "events").withColumn("toba", to).where("toba <> event_type")
    return ev.groupBy(F.col("event_type").alias("fromba"), "toba", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("period")).agg(
        F.sum(a.cents("value")).cast("double").alias("value_mwh"))


def tables(spark: SparkSession, d: str) -> features.Tables:
    codes = a.table(spark, d, "events").select(F.col("event_type").alias("respondent")).distinct()
    members = codes.select("respondent", F.when(F.col("respondent") < "p", "north").otherwise("south").alias("region"), F.lit(True).alias("enabled"))
    first = codes.select("respondent", F.ascii(F.substring("respondent", 1, 1)).alias("_c"))
    near = first.select("respondent", F.explode(F.array(F.col("_c") - 2, F.col("_c") + 2, F.col("_c") + 3, F.col("_c") - 3)).alias("_c"))
    edges = near.join(first.withColumnRenamed("respondent", "peer"), "_c").select("respondent", "peer")
    coordinates = codes.where("respondent <> 'view'").select("respondent", F.lit(40.0).alias("lat"))
    return features.Tables(region_table(spark, d), fuel_table(spark, d), flow_table(spark, d), a.weather_hourly(spark, d),
                           members, edges, coordinates)


def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """All columns; checked by rows here, by value in the narrower queries and the tests."""
    return tidy(features.feature_matrix(tables(spark, d), a.HOURLY, 2024))


_CORE = ("demand_mw", "eia_forecast_mw", "lag_24h", "lag_48h", "lag_168h", "lag_336h", "rolling_mean_24h", "rolling_std_24h",
         "rolling_mean_168h", "rolling_std_168h", "demand_diff_24h", "demand_momentum", "ng_mw_lag24", "ng_change_24h",
         "demand_minus_ng_lag24", "interchange_net_lag24", "interchange_vol_24h", "wind_pct", "renewable_pct",
         "total_gen_mw_lag24", "gen_demand_ratio_lag24", "temp_2m", "temp_rolling_mean_24h", "temp_lag_168h",
         "regional_demand_index", "neighbor_demand_avg", "demand_delta_vs_neighbors", "grid_stress_index")
_INTS = ("is_imputed", "is_anomaly", "hour_of_day", "fold", "is_import_stress", "is_export_stress")


def feature_matrix_core(spark: SparkSession, d: str) -> DataFrame:
    return feature_matrix(spark, d).select("respondent", "period", *_CORE, *_INTS)


def _core_sql() -> str:
    from panelspark.queries.cleaning import _anomaly_sql

    roll = "(PARTITION BY respondent ORDER BY period ROWS BETWEEN {0} PRECEDING AND {1} PRECEDING)"
    return f"""WITH region AS ({_anomaly_sql(3.0, None)}),
wide0 AS (
  SELECT respondent, period, max(CASE WHEN type = 'D' THEN value_mwh END) AS raw, max(CASE WHEN type = 'DF' THEN value_mwh END) AS raw_df,
    max(CASE WHEN type = 'NG' THEN value_mwh END) AS ng, max(CASE WHEN type = 'D' THEN is_imputed END) AS is_imputed, max(CASE WHEN type = 'D' THEN is_anomaly END) AS is_anomaly
  FROM region GROUP BY 1, 2),
bounded AS (
  SELECT *, CASE WHEN raw > 0 AND raw <= 500000 THEN raw END AS d1, CASE WHEN raw_df > 0 AND raw_df <= 500000 THEN raw_df END AS f1 FROM wide0),
caps AS (
  SELECT respondent, CASE WHEN count(d1) > 100 THEN greatest(5 * quantile_cont(d1, 0.95), 1000) END AS cap_d,
    CASE WHEN count(f1) > 100 THEN greatest(5 * quantile_cont(f1, 0.95), 1000) END AS cap_f FROM bounded GROUP BY 1),
spine AS (
  SELECT b.respondent, b.period, raw, ng, is_imputed, is_anomaly, CASE WHEN cap_d IS NULL OR d1 <= cap_d THEN d1 END AS demand_mw,
    CASE WHEN cap_f IS NULL OR f1 <= cap_f THEN f1 END AS eia_forecast_mw
  FROM bounded b JOIN caps c ON c.respondent = b.respondent),
fuel AS (
  SELECT event_type AS respondent, date_trunc('hour', ts) AS period,
    {', '.join(f"CAST(sum(CASE WHEN user_id % 5 = {i} THEN CAST(round(value * 100) AS BIGINT) END) AS DOUBLE) AS f{i}" for i in range(5))}
  FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
ends AS (
  SELECT event_type AS a, list_extract(['click', 'error', 'purchase', 'signup', 'view'], CAST(user_id % 5 + 1 AS INTEGER)) AS b, date_trunc('hour', ts) AS period,
    CAST(round(value * 100) AS BIGINT) AS v FROM events),
net AS (
  SELECT respondent, period, CAST(sum(v) AS DOUBLE) AS net FROM (
    SELECT a AS respondent, period, v FROM ends WHERE a <> b UNION ALL SELECT b, period, -v FROM ends WHERE a <> b) GROUP BY 1, 2),
{a.WEATHER_SQL},
types AS (SELECT DISTINCT event_type AS t FROM events),
peer AS (SELECT x.t AS respondent, y.t AS peer FROM types x JOIN types y ON x.t <> y.t AND (x.t < 'p') = (y.t < 'p')),
regional AS (SELECT p.respondent, s.period + INTERVAL 24 HOUR AS period, sum(raw) AS total FROM peer p JOIN spine s ON s.respondent = p.peer GROUP BY 1, 2),
near AS (
  SELECT x.t AS respondent, s.period + INTERVAL 24 HOUR AS period, avg(raw) AS near_avg
  FROM types x JOIN types y ON abs(ascii(x.t) - ascii(y.t)) IN (2, 3) JOIN spine s ON s.respondent = y.t GROUP BY 1, 2),
base AS (
  SELECT s.*, f0, f1, f2, f3, f4, net, temp_2m, coalesce(total, 0) AS regional_demand_index, near_avg
  FROM spine s LEFT JOIN fuel f ON f.respondent = s.respondent AND f.period = s.period LEFT JOIN net n ON n.respondent = s.respondent AND n.period = s.period
  LEFT JOIN weather_hourly h ON h.respondent = s.respondent AND h.period = s.period
  LEFT JOIN regional g ON g.respondent = s.respondent AND g.period = s.period LEFT JOIN near e ON e.respondent = s.respondent AND e.period = s.period),
win AS (
  SELECT *, row_number() OVER w AS rn, lag(demand_mw, 24) OVER w AS lag_24h, lag(demand_mw, 48) OVER w AS lag_48h, lag(demand_mw, 72) OVER w AS lag_72h,
    lag(demand_mw, 168) OVER w AS lag_168h, lag(demand_mw, 336) OVER w AS lag_336h,
    CASE WHEN count(demand_mw) OVER day >= 12 THEN avg(demand_mw) OVER day END AS rolling_mean_24h, CASE WHEN count(demand_mw) OVER day >= 12 THEN stddev_samp(demand_mw) OVER day END AS rolling_std_24h,
    CASE WHEN count(demand_mw) OVER week >= 84 THEN avg(demand_mw) OVER week END AS rolling_mean_168h, CASE WHEN count(demand_mw) OVER week >= 84 THEN stddev_samp(demand_mw) OVER week END AS rolling_std_168h,
    lag(ng, 24) OVER w AS ng_mw_lag24, lag(ng, 48) OVER w AS ng48, lag(net, 24) OVER w AS interchange_net_lag24,
    CASE WHEN count(net) OVER day >= 12 THEN stddev_samp(net) OVER day END AS interchange_vol_24h,
    {', '.join(f'coalesce(lag(f{i}, 24) OVER w, 0) AS g{i}' for i in range(5))},
    CASE WHEN count(temp_2m) OVER now >= 12 THEN avg(temp_2m) OVER now END AS temp_rolling_mean_24h, lag(temp_2m, 144) OVER w AS temp_lag_168h,
    max(near_avg) OVER (PARTITION BY respondent) AS top_near, max(regional_demand_index) OVER (PARTITION BY respondent) AS top_reg
  FROM base WINDOW w AS (PARTITION BY respondent ORDER BY period), day AS {roll.format(47, 24)}, week AS {roll.format(191, 24)},
    now AS (PARTITION BY respondent ORDER BY period ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
q AS (SELECT respondent, quantile_cont(interchange_net_lag24, 0.9) AS p90, quantile_cont(interchange_net_lag24, 0.1) AS p10 FROM win GROUP BY 1),
mix AS (SELECT *, nullif(g0 + g1 + g2 + g3, 0) AS t4, nullif(g0 + g1 + g2 + g3 + g4, 0) AS t5 FROM win)
SELECT m.respondent, period, {cols('demand_mw eia_forecast_mw lag_24h lag_48h lag_168h lag_336h rolling_mean_24h rolling_std_24h rolling_mean_168h rolling_std_168h')},
  {r('lag_24h - lag_48h')} AS demand_diff_24h, {r('lag_24h - 2 * lag_48h + lag_72h')} AS demand_momentum, {r('ng_mw_lag24')} AS ng_mw_lag24,
  {r('ng_mw_lag24 - ng48')} AS ng_change_24h, {r('lag_24h - ng_mw_lag24')} AS demand_minus_ng_lag24, {cols('interchange_net_lag24 interchange_vol_24h')},
  {r('coalesce(g0 / t4, 0)')} AS wind_pct, {r('coalesce((g0 + g1) / t5, 0)')} AS renewable_pct,
  CASE WHEN m.respondent = 'view' THEN CAST(0 AS DOUBLE) ELSE {r('t5')} END AS total_gen_mw_lag24,
  CASE WHEN m.respondent = 'view' THEN CAST(0 AS DOUBLE) WHEN t5 IS NOT NULL AND nullif(lag_24h, 0) IS NOT NULL THEN {r('least(5, greatest(0, t5 / nullif(lag_24h, 0)))')} END AS gen_demand_ratio_lag24,
  {cols('temp_2m temp_rolling_mean_24h temp_lag_168h regional_demand_index')}, {r('near_avg')} AS neighbor_demand_avg,
  {r('lag_24h - near_avg')} AS demand_delta_vs_neighbors,
  CASE WHEN top_near IS NULL THEN {r('regional_demand_index / top_reg')} ELSE {r('(regional_demand_index / top_reg + near_avg / top_near) / 2')} END AS grid_stress_index,
  is_imputed, is_anomaly, CAST(hour(period) AS INTEGER) AS hour_of_day, CAST(greatest(-1, least(5, year(period) - 2024)) AS INTEGER) AS fold,
  CAST(coalesce(interchange_net_lag24 > p90, false) AS INTEGER) AS is_import_stress, CAST(coalesce(interchange_net_lag24 < p10, false) AS INTEGER) AS is_export_stress
FROM mix m JOIN q ON q.respondent = m.respondent WHERE rn > 168 AND demand_mw IS NOT NULL"""


def feature_matrix_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The same matrix from tables in which every row of weather, members, neighbours and coordinates is there twice."""
    t = tables(spark, d)
    twice = {n: getattr(t, n).union(getattr(t, n)) for n in ("weather", "members", "neighbours", "coordinates")}
    return tidy(features.feature_matrix(replace(t, **twice), a.HOURLY, 2024).select("respondent", "period", *_CORE, *_INTS))


QUERIES = {
    "feature_matrix_duplicates": (feature_matrix_duplicates, _core_sql()),
    "feature_matrix": (feature_matrix, None),
    "feature_matrix_core": (feature_matrix_core, _core_sql()),
}
