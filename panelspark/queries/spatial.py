"""Other regions' demand and weather, stress indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import demand
from panelspark.operators import cleaning, joins, spatial
from panelspark.operators.blocks import lag, over_blocks
from panelspark.queries import adapters as a
from panelspark.queries.adapters import cols, r, tidy
from panelspark.session import stored
from panelspark.queries.windows import NET_GRID_SQL, net_grid


def _nation_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = cleaning.regular_grid(a.daily_nation(spark, d), a.DAILY)
    return stored(grid.select("respondent", "period", "demand_mw"))


def regional_demand(spark: SparkSession, d: str) -> DataFrame:
    """One region is left out, as its group is in the default settings."""
    out = spatial.regional_demand(_nation_grid(spark, d), a.members(spark, d), a.DAILY, skip=("EUROPE",))
    return tidy(out.drop("demand_mw"))


REGIONAL_SQL = f"""{a.NATION_SQL}, {a.REGISTRY_SQL},
peers AS (
  SELECT x.code AS respondent, y.code AS peer FROM registry x JOIN registry y ON x.region = y.region AND x.code <> y.code
  WHERE y.enabled AND x.region <> 'EUROPE'),
n_peers AS (SELECT respondent, count(*) AS n FROM peers GROUP BY 1),
sums AS (
  SELECT p.respondent, g.period + INTERVAL 24 DAY AS period, sum(g.demand_mw) AS total
  FROM peers p JOIN nation_daily_grid g ON g.respondent = p.peer GROUP BY 1, 2),
regional AS (
  SELECT g.respondent, g.period, demand_mw, CASE WHEN n > 0 THEN coalesce(total, 0) END AS regional_demand_index,
         CASE WHEN n > 0 THEN coalesce(total, 0) / n END AS regional_demand_per_ba
  FROM nation_daily_grid g LEFT JOIN n_peers c ON c.respondent = g.respondent
  LEFT JOIN sums s ON s.respondent = g.respondent AND s.period = g.period)"""
REGIONAL_DEMAND = f"WITH {REGIONAL_SQL} SELECT respondent, period, {cols('regional_demand_index regional_demand_per_ba')} FROM regional"


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    grid = _nation_grid(spark, d)
    stats = spatial.neighbour_demand(grid, a.edges(spark, d), a.DAILY)
    lagged = over_blocks(grid, a.DAILY, {"lag_24h": lag("demand_mw", 24)})
    return joins.align(lagged, a.DAILY, stats)


def neighbor_stats(spark: SparkSession, d: str) -> DataFrame:
    out = _neighbours(spark, d)
    delta = F.col("lag_24h") - F.col("neighbor_demand_avg")
    return tidy(out.withColumn("demand_delta_vs_neighbors", delta).drop("demand_mw", "lag_24h"))


NEIGHBOUR_SQL = f"""{a.NATION_SQL}, {a.REGISTRY_SQL},
near AS (
  SELECT e.respondent, g.period + INTERVAL 24 DAY AS period, avg(g.demand_mw) AS neighbor_demand_avg,
         max(g.demand_mw) AS neighbor_demand_max, min(g.demand_mw) AS neighbor_demand_min
  FROM edges e JOIN nation_daily_grid g ON g.respondent = e.peer GROUP BY 1, 2),
neighbours AS (
  SELECT g.respondent, g.period, g.lag_24h, neighbor_demand_avg, neighbor_demand_max, neighbor_demand_min
  FROM (SELECT *, lag(demand_mw, 24) OVER (PARTITION BY respondent ORDER BY period) AS lag_24h FROM nation_daily_grid) g
  LEFT JOIN near n ON n.respondent = g.respondent AND n.period = g.period)"""
NEIGHBOR_STATS = f"""WITH {NEIGHBOUR_SQL} SELECT respondent, period, {cols('neighbor_demand_avg neighbor_demand_max neighbor_demand_min')},
  {r('lag_24h - neighbor_demand_avg')} AS demand_delta_vs_neighbors FROM neighbours"""


def _event_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every event type has the types next to it in the alphabet as neighbours."""
    types = a.table(spark, d, "events").select(F.col("event_type").alias("respondent")).distinct()
    code = F.ascii(F.substring("respondent", 1, 1))
    first = types.withColumn("_c", code)
    near = F.explode(F.array(F.col("_c") - 2, F.col("_c") + 2)).alias("_c")
    return first.select("respondent", near).join(
        first.withColumnRenamed("respondent", "peer"), "_c").select("respondent", "peer")


def temp_delta(spark: SparkSession, d: str) -> DataFrame:
    grid = stored(a.weather_grid(spark, d).select("respondent", "period", "temp_2m"))
    near = spatial.neighbour_weather(grid, _event_edges(spark, d), a.HOURLY)
    out = joins.align(grid, a.HOURLY, near)
    return tidy(out.select("respondent", "period", (F.col("temp_2m") - F.col("neighbor_temp_2m")).alias("temp_delta_vs_neighbors")))


TEMP_DELTA = f"""WITH {a.WEATHER_GRID_SQL},
types AS (SELECT DISTINCT event_type AS t FROM events),
near AS (
  SELECT x.t AS respondent, g.period + INTERVAL 24 HOUR AS period, avg(temp_2m) AS near_temp
  FROM types x JOIN types y ON abs(ascii(x.t) - ascii(y.t)) = 2 JOIN weather_grid g ON g.respondent = y.t GROUP BY 1, 2)
SELECT g.respondent, g.period, {r('temp_2m - near_temp')} AS temp_delta_vs_neighbors
FROM weather_grid g LEFT JOIN near n ON n.respondent = g.respondent AND n.period = g.period"""


def stress_flags(spark: SparkSession, d: str) -> DataFrame:
    lagged = over_blocks(net_grid(spark, d), a.DAILY, {"interchange_net_lag24": demand.interchange()["interchange_net_lag24"]})
    return tidy(spatial.stress_flags(lagged, a.DAILY).drop("net_interchange"))


STRESS_FLAGS = f"""WITH {NET_GRID_SQL},
lagged AS (SELECT respondent, period, lag(net_interchange, 24) OVER (PARTITION BY respondent ORDER BY period) AS net FROM net_grid),
q AS (SELECT respondent, quantile_cont(net, 0.9) AS p90, quantile_cont(net, 0.1) AS p10 FROM lagged GROUP BY 1)
SELECT l.respondent, period, {r('net')} AS interchange_net_lag24, CAST(coalesce(net > p90, false) AS INTEGER) AS is_import_stress,
  CAST(coalesce(net < p10, false) AS INTEGER) AS is_export_stress FROM lagged l JOIN q ON q.respondent = l.respondent"""


def grid_stress(spark: SparkSession, d: str) -> DataFrame:
    grid = _nation_grid(spark, d)
    regional = spatial.regional_demand(grid, a.members(spark, d), a.DAILY, skip=("EUROPE",))
    near = spatial.neighbour_demand(grid, a.edges(spark, d), a.DAILY)
    out = spatial.grid_stress(joins.align(regional, a.DAILY, near), a.DAILY)
    return tidy(out.select("respondent", "period", "grid_stress_index"))


GRID_STRESS = f"""WITH {REGIONAL_SQL},
near AS (
  SELECT e.respondent, g.period + INTERVAL 24 DAY AS period, avg(g.demand_mw) AS near_avg
  FROM edges e JOIN nation_daily_grid g ON g.respondent = e.peer GROUP BY 1, 2),
parts AS (
  SELECT x.respondent, x.period, regional_demand_index / max(regional_demand_index) OVER w AS a, near_avg / max(near_avg) OVER w AS b,
         max(regional_demand_index) OVER w AS top_a, max(near_avg) OVER w AS top_b
  FROM regional x LEFT JOIN near n ON n.respondent = x.respondent AND n.period = x.period WINDOW w AS (PARTITION BY x.respondent))
SELECT respondent, period, CASE WHEN top_a IS NULL THEN {r('b')} WHEN top_b IS NULL THEN {r('a')} ELSE {r('(a + b) / 2')} END AS grid_stress_index FROM parts"""


QUERIES = {
    "regional_demand": (regional_demand, REGIONAL_DEMAND),
    "neighbor_stats": (neighbor_stats, NEIGHBOR_STATS),
    "temp_delta_neighbors": (temp_delta, TEMP_DELTA),
    "stress_flags": (stress_flags, STRESS_FLAGS),
    "grid_stress": (grid_stress, GRID_STRESS),
}
