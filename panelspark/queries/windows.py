"""Lags, rolling statistics, momentum, generation, flows and supply mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import demand, fuel
from panelspark.operators import cleaning, flows, joins
from panelspark.operators.blocks import over_blocks, rolling
from panelspark.queries import adapters as a
from panelspark.queries.adapters import cols, r, tidy


def _demand(spark: SparkSession, d: str) -> DataFrame:
    return a.hourly_grid(spark, d).select("respondent", "period", "demand_mw")


def lags(spark: SparkSession, d: str) -> DataFrame:
    return tidy(over_blocks(_demand(spark, d), a.HOURLY, demand.lags()).drop("demand_mw"))


LAGS = f"""WITH {a.HOURLY_GRID_SQL}
SELECT respondent, period, {r('lag(demand_mw, 24) OVER w')} AS lag_24h, {r('lag(demand_mw, 48) OVER w')} AS lag_48h,
       {r('lag(demand_mw, 168) OVER w')} AS lag_168h
FROM hourly_grid WINDOW w AS (PARTITION BY respondent ORDER BY period)"""


def rolling_anchored(spark: SparkSession, d: str) -> DataFrame:
    return tidy(over_blocks(_demand(spark, d), a.HOURLY, demand.anchored()).drop("demand_mw"))


ROLLING_ANCHORED = f"""WITH {a.HOURLY_GRID_SQL}
SELECT respondent, period,
  CASE WHEN count(demand_mw) OVER day >= 12 THEN {r('avg(demand_mw) OVER day')} END AS rolling_mean_24h,
  CASE WHEN count(demand_mw) OVER day >= 12 THEN {r('stddev_samp(demand_mw) OVER day')} END AS rolling_std_24h,
  CASE WHEN count(demand_mw) OVER week >= 84 THEN {r('avg(demand_mw) OVER week')} END AS rolling_mean_168h,
  CASE WHEN count(demand_mw) OVER week >= 84 THEN {r('stddev_samp(demand_mw) OVER week')} END AS rolling_std_168h
FROM hourly_grid WINDOW day AS (PARTITION BY respondent ORDER BY period ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING),
  week AS (PARTITION BY respondent ORDER BY period ROWS BETWEEN 191 PRECEDING AND 24 PRECEDING)"""


def momentum(spark: SparkSession, d: str) -> DataFrame:
    stage = demand.lags() | demand.long_lags()
    out = over_blocks(_demand(spark, d), a.HOURLY, stage).withColumns(demand.momentum())
    return tidy(out.select("respondent", "period", "lag_336h", "demand_diff_24h", "demand_momentum"))


MOMENTUM = f"""WITH {a.HOURLY_GRID_SQL}
SELECT respondent, period, {r('lag(demand_mw, 336) OVER w')} AS lag_336h,
  {r('lag(demand_mw, 24) OVER w - lag(demand_mw, 48) OVER w')} AS demand_diff_24h,
  {r('lag(demand_mw, 24) OVER w - 2 * lag(demand_mw, 48) OVER w + lag(demand_mw, 72) OVER w')} AS demand_momentum
FROM hourly_grid WINDOW w AS (PARTITION BY respondent ORDER BY period)"""


def grid_features(spark: SparkSession, d: str) -> DataFrame:
    stage = {"lag_24h": demand.lags()["lag_24h"], **demand.generation()}
    out = over_blocks(a.hourly_grid(spark, d), a.HOURLY_SHORT, stage).withColumns(demand.generation_changes())
    return tidy(out.select("respondent", "period", "ng_mw_lag24", "ti_mw_lag24", "ng_rolling_mean_24h",
                           "ti_rolling_mean_24h", "ng_change_24h", "demand_minus_ng_lag24"))


GRID_FEATURES = f"""WITH {a.HOURLY_GRID_SQL}
SELECT respondent, period, {r('lag(ng, 24) OVER w')} AS ng_mw_lag24, {r('lag(ti, 24) OVER w')} AS ti_mw_lag24,
  CASE WHEN count(ng) OVER day >= 12 THEN {r('avg(ng) OVER day')} END AS ng_rolling_mean_24h,
  CASE WHEN count(ti) OVER day >= 12 THEN {r('avg(ti) OVER day')} END AS ti_rolling_mean_24h,
  {r('lag(ng, 24) OVER w - lag(ng, 48) OVER w')} AS ng_change_24h,
  {r('lag(demand_mw, 24) OVER w - lag(ng, 24) OVER w')} AS demand_minus_ng_lag24
FROM hourly_grid WINDOW w AS (PARTITION BY respondent ORDER BY period),
  day AS (PARTITION BY respondent ORDER BY period ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING)"""


def net_interchange(spark: SparkSession, d: str) -> DataFrame:
    return tidy(flows.net_interchange(a.flows_daily(spark, d)))


NET_SQL = f"""{a.FLOWS_SQL},
ends AS (
  SELECT fromba AS respondent, period, sum(coalesce(value, 0)) AS exports, 0 AS imports FROM flows GROUP BY 1, 2
  UNION ALL SELECT toba, period, 0, sum(coalesce(value, 0)) FROM flows GROUP BY 1, 2),
net AS (
  SELECT respondent, period, sum(exports) AS exports, sum(imports) AS imports, sum(exports) - sum(imports) AS net_interchange
  FROM ends GROUP BY 1, 2)"""
NET_INTERCHANGE = f"WITH {NET_SQL} SELECT respondent, period, {cols('exports imports net_interchange')} FROM net"

NET_GRID_SQL = NET_SQL + """,
net_points AS (SELECT respondent, unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS period FROM net GROUP BY 1),
net_grid AS (
  SELECT p.respondent, p.period, net_interchange FROM net_points p
  LEFT JOIN net n ON n.respondent = p.respondent AND n.period = p.period)"""


def net_grid(spark: SparkSession, d: str) -> DataFrame:
    net = flows.net_interchange(a.flows_daily(spark, d)).select("respondent", "period", "net_interchange")
    return cleaning.regular_grid(net, a.DAILY)


def interchange_vol(spark: SparkSession, d: str) -> DataFrame:
    return tidy(over_blocks(net_grid(spark, d), a.DAILY, demand.interchange()).drop("net_interchange"))


INTERCHANGE_VOL = f"""WITH {NET_GRID_SQL}
SELECT respondent, period, {r('lag(net_interchange, 24) OVER w')} AS interchange_net_lag24,
  CASE WHEN count(net_interchange) OVER day >= 12 THEN {r('stddev_samp(net_interchange) OVER day')} END AS interchange_vol_24h
FROM net_grid WINDOW w AS (PARTITION BY respondent ORDER BY period),
  day AS (PARTITION BY respondent ORDER BY period ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING)"""


def wide_pivot(spark: SparkSession, d: str) -> DataFrame:
    return tidy(joins.wide(a.hourly_long(spark, d), a.HOURLY, "type", joins.REGION_TYPES,
                           names={"D": "demand_mw", "DF": "eia_forecast_mw", "NG": "ng", "TI": "ti"}))


WIDE_PIVOT = f"WITH {a.HOURLY_WIDE_SQL} SELECT respondent, period, {r('d')} AS demand_mw, {r('df')} AS eia_forecast_mw, {cols('ng ti')} FROM hourly_wide"


def fuel_wide(spark: SparkSession, d: str) -> DataFrame:
    """Fuel columns; the sun of one region carries another code, so that it never reports a base fuel there."""
    other = (F.col("respondent") == "R1") & (F.col("fueltype") == "SUN")
    long = a.fuel_long(spark, d).withColumn("fueltype", F.when(other, "OTH").otherwise(F.col("fueltype")))
    return tidy(joins.fuel_wide(long, a.HOURLY, a.FUELS, base=fuel.BASE_FUELS))


FUEL_WIDE = f"""WITH {a.FUEL_SQL},
kept AS (SELECT * REPLACE (CASE WHEN respondent = 'R1' AND fueltype = 'SUN' THEN 'OTH' ELSE fueltype END AS fueltype) FROM fuel_long)
SELECT respondent, period, max(CASE WHEN fueltype = 'WND' THEN {r('value')} END) AS "WND",
  CASE WHEN respondent = 'R1' THEN CAST(0 AS DOUBLE) ELSE max(CASE WHEN fueltype = 'SUN' THEN {r('value')} END) END AS "SUN",
  max(CASE WHEN fueltype = 'COL' THEN {r('value')} END) AS "COL", max(CASE WHEN fueltype = 'NG' THEN {r('value')} END) AS "NG",
  max(CASE WHEN fueltype = 'NUC' THEN {r('value')} END) AS "NUC"
FROM kept GROUP BY 1, 2"""


def fuel_mix(spark: SparkSession, d: str) -> DataFrame:
    mix = fuel.mix(a.FUELS)
    names = [n for n in mix if n.endswith("_pct")]
    out = a.supply_shifted(spark, d).withColumns(mix)
    return tidy(out.select("respondent", "period", *names))


FUEL_MIX = f"""WITH {a.SUPPLY_SQL}
SELECT respondent, period, {r('coalesce(wnd / total4, 0)')} AS wind_pct, {r('coalesce(sun / total4, 0)')} AS solar_pct,
  {r('coalesce(col / total4, 0)')} AS coal_pct, {r('coalesce(ng / total4, 0)')} AS ng_pct,
  {r('coalesce(nuc / total_all, 0)')} AS nuclear_pct, CAST(0 AS DOUBLE) AS hydro_pct,
  {r('coalesce((greatest(coalesce(wnd, 0), 0) + greatest(coalesce(sun, 0), 0)) / total_all, 0)')} AS renewable_pct
FROM totals"""


def fuel_ratio(spark: SparkSession, d: str) -> DataFrame:
    out = a.supply_shifted(spark, d).withColumns(fuel.mix(a.FUELS))
    return tidy(out.select("respondent", "period", "total_gen_mw_lag24", "gen_demand_ratio_lag24"))


FUEL_RATIO = f"""WITH {a.SUPPLY_SQL}
SELECT respondent, period, {r('total_all')} AS total_gen_mw_lag24,
  CASE WHEN total_all IS NOT NULL AND nullif(lag_24h, 0) IS NOT NULL THEN {r('least(5, greatest(0, total_all / nullif(lag_24h, 0)))')} END AS gen_demand_ratio_lag24
FROM totals"""


def _spiked(spark: SparkSession, d: str) -> DataFrame:
    """Every 97th hour is ten million times too large."""
    hit = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', period) % 97 = 0")
    return _demand(spark, d).withColumn("demand_mw", F.when(hit, F.col("demand_mw") * 1e7).otherwise(F.col("demand_mw")))


_SPIKED_SQL = f"""{a.HOURLY_GRID_SQL}, spiked AS (
  SELECT respondent, period, CASE WHEN datediff('hour', TIMESTAMP '2024-01-01', period) % 97 = 0 THEN demand_mw * 1e7 ELSE demand_mw END AS demand_mw
  FROM hourly_grid)"""


def rolling_after_spike(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the frames that hold no spike; spikes elsewhere in the block must not touch them."""
    stage = {"top": rolling(F.max, "demand_mw", 24), "rolling_mean_24h": rolling(F.avg, "demand_mw", 24, 12), "rolling_std_24h": rolling(F.stddev_samp, "demand_mw", 24, 12)}
    return tidy(over_blocks(_spiked(spark, d), a.HOURLY, stage).where("top < 1e10").drop("demand_mw", "top"))


ROLLING_AFTER_SPIKE = f"""WITH {_SPIKED_SQL}, stats AS (
  SELECT respondent, period, max(demand_mw) OVER day AS top, CASE WHEN count(demand_mw) OVER day >= 12 THEN {r('avg(demand_mw) OVER day')} END AS rolling_mean_24h,
    list(demand_mw) OVER day AS frame, count(demand_mw) OVER day AS n
  FROM spiked WINDOW day AS (PARTITION BY respondent ORDER BY period ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT respondent, period, rolling_mean_24h, CASE WHEN n >= 12 THEN {r('list_stddev_samp(frame)')} END AS rolling_std_24h FROM stats WHERE top < 1e10"""


def anomaly_after_spike(spark: SparkSession, d: str) -> DataFrame:
    """Flags on the series with spikes."""
    return tidy(cleaning.flag_anomalies(_spiked(spark, d), a.HOURLY, "demand_mw").drop("demand_mw"))


ANOMALY_AFTER_SPIKE = f"""WITH {_SPIKED_SQL}, stats AS (
  SELECT respondent, period, demand_mw, count(demand_mw) OVER w AS n, avg(demand_mw) OVER w AS mean, nullif(stddev_samp(demand_mw) OVER w, 0) AS std
  FROM spiked WINDOW w AS (PARTITION BY respondent ORDER BY period ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING))
SELECT respondent, period, CAST(coalesce(n >= 24 AND abs(demand_mw - mean) / std > 4, false) AS INTEGER) AS is_anomaly FROM stats"""


QUERIES = {
    "rolling_after_spike": (rolling_after_spike, ROLLING_AFTER_SPIKE),
    "anomaly_after_spike": (anomaly_after_spike, ANOMALY_AFTER_SPIKE),
    "lags": (lags, LAGS),
    "rolling_anchored": (rolling_anchored, ROLLING_ANCHORED),
    "momentum": (momentum, MOMENTUM),
    "grid_features": (grid_features, GRID_FEATURES),
    "net_interchange": (net_interchange, NET_INTERCHANGE),
    "interchange_vol": (interchange_vol, INTERCHANGE_VOL),
    "wide_pivot": (wide_pivot, WIDE_PIVOT),
    "fuel_wide": (fuel_wide, FUEL_WIDE),
    "fuel_mix": (fuel_mix, FUEL_MIX),
    "fuel_ratio": (fuel_ratio, FUEL_RATIO),
}
