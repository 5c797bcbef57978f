"""Panels derived from the driver tables, once for Spark and once as SQL common table expressions.

Amounts are summed as whole cents or whole units, so sums are exact and do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import fuel
from panelspark.operators import cleaning, splits
from panelspark.operators.blocks import lag, over_blocks
from panelspark.panel import DAY, HOUR, Panel
from panelspark.session import configure

HOURLY = Panel(step=HOUR, block=2048)
HOURLY_SHORT = HOURLY.with_(block=512)
TYPED = HOURLY.with_(keys=("respondent", "type"))
DAILY = Panel(step=DAY, block=512)
BASE_YEAR = 1996
FOLDS = ("0", "1", "2", "3", "4", "overall")

FUEL_OF_EVENT = {"view": "WND", "signup": "SUN", "click": "COL", "error": "NG", "purchase": "NUC"}
FUELS = tuple(FUEL_OF_EVENT.values())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded doubles, plain integers and zone-free timestamps for comparison."""
    cols = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind == "double":
            c = F.round(c, digits)
        elif kind in ("byte", "short", "boolean"):
            c = c.cast("int")
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


# --- hourly panel from events -------------------------------------------------------------------

def hourly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    c = cents("value")
    return ev.groupBy(
        F.col("event_type").alias("respondent"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("period"),
    ).agg(
        F.sum(c).cast("double").alias("D"),
        (F.count(F.lit(1)) * 5000).cast("double").alias("DF"),
        F.sum(F.when(F.col("user_id") % 2 == 0, c)).cast("double").alias("NG"),
    ).withColumn("TI", F.col("D") - F.col("NG"))


def hourly_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = [F.struct(F.lit(t).alias("type"), F.col(t).alias("value")) for t in ("D", "DF", "NG", "TI")]
    return hourly_wide(spark, sf_dir).select("respondent", "period", F.inline(F.array(*types)))


def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free hours with demand_mw, eia_forecast_mw, ng and ti."""
    renamed = hourly_wide(spark, sf_dir).withColumnsRenamed(
        {"D": "demand_mw", "DF": "eia_forecast_mw", "NG": "ng", "TI": "ti"})
    return cleaning.regular_grid(renamed, HOURLY)


HOURLY_WIDE_SQL = """
hourly_base AS (
  SELECT event_type AS respondent, date_trunc('hour', ts) AS period,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS d,
         CAST(count(*) * 5000 AS DOUBLE) AS df,
         CAST(sum(CASE WHEN user_id % 2 = 0 THEN CAST(round(value * 100) AS BIGINT) END) AS DOUBLE) AS ng
  FROM events GROUP BY 1, 2),
hourly_wide AS (SELECT *, d - ng AS ti FROM hourly_base)"""

HOURLY_LONG_SQL = HOURLY_WIDE_SQL + """,
hourly_long AS (
  SELECT respondent, period, 'D' AS type, d AS value FROM hourly_wide
  UNION ALL SELECT respondent, period, 'DF', df FROM hourly_wide
  UNION ALL SELECT respondent, period, 'NG', ng FROM hourly_wide
  UNION ALL SELECT respondent, period, 'TI', ti FROM hourly_wide)"""

HOURLY_GRID_SQL = HOURLY_WIDE_SQL + """,
hourly_points AS (
  SELECT respondent, unnest(generate_series(min(period), max(period), INTERVAL 1 HOUR)) AS period
  FROM hourly_wide GROUP BY respondent),
hourly_grid AS (
  SELECT p.respondent, p.period, d AS demand_mw, df AS eia_forecast_mw, ng, ti
  FROM hourly_points p LEFT JOIN hourly_wide h ON h.respondent = p.respondent AND h.period = p.period)"""


# --- supply by fuel from events -----------------------------------------------------------------

def fuel_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    code = F.create_map(*[F.lit(x) for pair in FUEL_OF_EVENT.items() for x in pair])[F.col("event_type")]
    return ev.groupBy(
        F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string")).alias("respondent"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("period"),
        code.alias("fueltype"),
    ).agg((F.sum(cents("value")) - 2000).cast("double").alias("value"))


def supply_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free hours of the fuel regions with demand and one column per fuel."""
    long = fuel_long(spark, sf_dir)
    wide = long.groupBy("respondent", "period").agg(
        F.sum(F.col("value") + 2000.0).alias("demand_mw"),
        *[F.max(F.when(F.col("fueltype") == f, F.col("value"))).alias(f) for f in FUELS],
    )
    return cleaning.regular_grid(wide, HOURLY)


def supply_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = {"lag_24h": lag("demand_mw", 24), **fuel.shifted(FUELS)}
    return over_blocks(supply_grid(spark, sf_dir), HOURLY_SHORT, stage)


FUEL_SQL = """
fuel_long AS (
  SELECT 'R' || CAST(user_id % 5 AS VARCHAR) AS respondent, date_trunc('hour', ts) AS period,
         CASE event_type WHEN 'view' THEN 'WND' WHEN 'signup' THEN 'SUN' WHEN 'click' THEN 'COL'
              WHEN 'error' THEN 'NG' WHEN 'purchase' THEN 'NUC' END AS fueltype,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) - 2000 AS DOUBLE) AS value
  FROM events GROUP BY 1, 2, 3)"""

SUPPLY_SQL = FUEL_SQL + """,
supply_wide AS (
  SELECT respondent, period, sum(value + 2000) AS demand_mw,
         max(CASE WHEN fueltype = 'WND' THEN value END) AS wnd, max(CASE WHEN fueltype = 'SUN' THEN value END) AS sun,
         max(CASE WHEN fueltype = 'COL' THEN value END) AS col, max(CASE WHEN fueltype = 'NG' THEN value END) AS ng,
         max(CASE WHEN fueltype = 'NUC' THEN value END) AS nuc
  FROM fuel_long GROUP BY 1, 2),
supply_points AS (
  SELECT respondent, unnest(generate_series(min(period), max(period), INTERVAL 1 HOUR)) AS period
  FROM supply_wide GROUP BY respondent),
supply_grid AS (
  SELECT p.respondent, p.period, demand_mw, wnd, sun, col, ng, nuc
  FROM supply_points p LEFT JOIN supply_wide w ON w.respondent = p.respondent AND w.period = p.period),
shifted AS (
  SELECT respondent, period, demand_mw, lag(demand_mw, 24) OVER w AS lag_24h, lag(wnd, 24) OVER w AS wnd,
         lag(sun, 24) OVER w AS sun, lag(col, 24) OVER w AS col, lag(ng, 24) OVER w AS ng, lag(nuc, 24) OVER w AS nuc
  FROM supply_grid WINDOW w AS (PARTITION BY respondent ORDER BY period)),
totals AS (
  SELECT *, nullif(coalesce(wnd, 0) + coalesce(sun, 0) + coalesce(col, 0) + coalesce(ng, 0), 0) AS total4,
         nullif(greatest(coalesce(wnd, 0), 0) + greatest(coalesce(sun, 0), 0) + greatest(coalesce(col, 0), 0)
                + greatest(coalesce(ng, 0), 0) + greatest(coalesce(nuc, 0), 0), 0) AS total_all
  FROM shifted)"""


# --- weather from events ------------------------------------------------------------------------

def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    c = cents("value")
    base = ev.groupBy(
        F.col("event_type").alias("respondent"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("period"),
    ).agg(F.sum(c).alias("_s"), F.count(F.lit(1)).alias("_n"), F.max(c).alias("_hi"), F.min(c).alias("_lo"))
    temp = F.least(F.expr("_s div (50 * _n)"), F.lit(200)) / F.lit(4.0) - 10  # quarter degrees, so sums are exact
    return base.select(
        "respondent", "period", temp.alias("temp_2m"), (temp - F.col("_n") % 10).alias("dewpoint_2m"),
        ((F.col("_hi") % 6000) / F.lit(100.0)).alias("windspeed_10m"), (F.col("_s") / F.lit(100.0)).alias("solar_irradiance"),
        ((F.col("_lo") % 10000) / F.lit(100.0)).alias("cloudcover"), (F.col("_n") % 4).cast("double").alias("precipitation"),
    )


def weather_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.regular_grid(weather_hourly(spark, sf_dir), HOURLY)


WEATHER_SQL = """
weather_base AS (
  SELECT event_type AS respondent, date_trunc('hour', ts) AS period,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS s, count(*) AS n,
         max(CAST(round(value * 100) AS BIGINT)) AS hi, min(CAST(round(value * 100) AS BIGINT)) AS lo
  FROM events GROUP BY 1, 2),
weather_temp AS (
  SELECT *, CAST(least(s // (50 * n), 200) AS DOUBLE) / 4 - 10 AS temp FROM weather_base),
weather_hourly AS (
  SELECT respondent, period, temp AS temp_2m, temp - n % 10 AS dewpoint_2m,
         CAST(hi % 6000 AS DOUBLE) / 100 AS windspeed_10m, CAST(s AS DOUBLE) / 100 AS solar_irradiance,
         CAST(lo % 10000 AS DOUBLE) / 100 AS cloudcover, CAST(n % 4 AS DOUBLE) AS precipitation
  FROM weather_temp)"""

WEATHER_GRID_SQL = WEATHER_SQL + """,
weather_points AS (
  SELECT respondent, unnest(generate_series(min(period), max(period), INTERVAL 1 HOUR)) AS period
  FROM weather_hourly GROUP BY respondent),
weather_grid AS (
  SELECT p.respondent, p.period, temp_2m, dewpoint_2m, windspeed_10m, solar_irradiance, cloudcover, precipitation
  FROM weather_points p LEFT JOIN weather_hourly h ON h.respondent = p.respondent AND h.period = p.period)"""


# --- daily panels from orders -------------------------------------------------------------------

def _daily(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """Orders per day of a region (``r_name``) or nation (``n_name``).

    Orders are reduced to one row per customer and day before the join, so that a customer with very
    many orders does not dominate a join task.
    """
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(
        F.sum(F.round("o_totalprice").cast("long")).alias("_amount"), F.count(F.lit(1)).alias("_n"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col(level).alias("respondent"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("respondent", F.col("o_orderdate").alias("period")).agg(
        F.sum("_amount").cast("double").alias("demand_mw"),
        (F.sum("_n") * 250000).cast("double").alias("eia_forecast_mw"),
    )


def daily_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir, "r_name")


def daily_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir, "n_name")


def _daily_sql(name: str, level: str) -> str:
    return f"""
{name} AS (
  SELECT {level} AS respondent, o_orderdate AS period,
         CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS DOUBLE) AS demand_mw,
         CAST(count(*) * 250000 AS DOUBLE) AS eia_forecast_mw
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
{name}_points AS (
  SELECT respondent, unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS period
  FROM {name} GROUP BY respondent),
{name}_grid AS (
  SELECT p.respondent, p.period, demand_mw, eia_forecast_mw
  FROM {name}_points p LEFT JOIN {name} d ON d.respondent = p.respondent AND d.period = p.period)"""


DAILY_SQL = _daily_sql("daily", "r_name")
NATION_SQL = _daily_sql("nation_daily", "n_name")


def daily_scored(spark: SparkSession, sf_dir: str, level: str = "r_name") -> DataFrame:
    """Gap-free days with the naive forecasts (lags of 1, 2 and 7 days) and the fold."""
    grid = cleaning.regular_grid(_daily(spark, sf_dir, level), DAILY)
    lagged = over_blocks(grid, DAILY, {
        "lag_24h": lag("demand_mw", 1), "lag_48h": lag("demand_mw", 2), "lag_168h": lag("demand_mw", 7)})
    return lagged.withColumn("fold", splits.fold_label(F.col("period"), BASE_YEAR))


def scored_sql(name: str) -> str:
    return f"""
scored AS (
  SELECT *, lag(demand_mw, 1) OVER w AS lag_24h, lag(demand_mw, 2) OVER w AS lag_48h, lag(demand_mw, 7) OVER w AS lag_168h,
         CAST(greatest(-1, least(5, year(period) - {BASE_YEAR})) AS INTEGER) AS fold
  FROM {name}_grid WINDOW w AS (PARTITION BY respondent ORDER BY period))"""


# --- flows from line items ----------------------------------------------------------------------

def flows_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped quantity from the supplier's to the customer's region per day.

    Line items are reduced per supplier, destination and day before the supplier join.
    """
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    to_region = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("r_name").alias("toba"))
    order_to = orders.join(to_region, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "toba")
    from_region = supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("r_name").alias("fromba"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_quantity")
    reduced = items.join(order_to, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        "l_suppkey", "toba", "l_shipdate").agg(F.sum("l_quantity").alias("_q"))
    return reduced.join(from_region, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        "fromba", "toba", F.col("l_shipdate").alias("period")).agg(F.sum("_q").alias("value"))


FLOWS_SQL = """
flows AS (
  SELECT rs.r_name AS fromba, rc.r_name AS toba, l_shipdate AS period, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN region rc ON nc.n_regionkey = rc.r_regionkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey
  JOIN region rs ON ns.n_regionkey = rs.r_regionkey GROUP BY 1, 2, 3)"""


# --- registry from nation and region ------------------------------------------------------------

def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("code"), F.col("r_name").alias("region"), "n_nationkey",
        (F.col("n_nationkey") % 5 + 1).alias("priority"), (F.col("n_nationkey") != 24).alias("enabled"),
        (F.col("n_nationkey") + 25).cast("double").alias("lat"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).select(F.col("code").alias("respondent"), "region", "enabled")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours: the nations with the next lower and higher key, if enabled."""
    reg = registry(spark, sf_dir)
    near = F.explode(F.array(F.col("n_nationkey") - 1, F.col("n_nationkey") + 1)).alias("_peer")
    peers = reg.where("enabled").select(F.col("n_nationkey").alias("_peer"), F.col("code").alias("peer"))
    return reg.select(F.col("code").alias("respondent"), near).join(peers, "_peer").select("respondent", "peer")


REGISTRY_SQL = """
registry AS (
  SELECT n_name AS code, r_name AS region, n_nationkey, n_nationkey % 5 + 1 AS priority, n_nationkey <> 24 AS enabled,
         CAST(n_nationkey + 25 AS DOUBLE) AS lat
  FROM nation JOIN region ON n_regionkey = r_regionkey),
edges AS (
  SELECT a.code AS respondent, b.code AS peer FROM registry a JOIN registry b
  ON abs(a.n_nationkey - b.n_nationkey) = 1 WHERE b.enabled)"""


def r(expr: str, digits: int = 6) -> str:
    """SQL for a rounded double without a negative zero."""
    return f"(CASE WHEN round(CAST({expr} AS DOUBLE), {digits}) = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST({expr} AS DOUBLE), {digits}) END)"


def cols(names: str, digits: int = 6) -> str:
    """Rounded columns that keep their names."""
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names.split())
