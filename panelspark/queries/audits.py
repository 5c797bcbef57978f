"""Audits, range statistics, registry look-ups, imputation, scaling and look-up joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import demand, scaling
from panelspark.operators import joins
from panelspark.operators.blocks import lag, over_blocks
from panelspark.operators.quantiles import exact_quantiles
from panelspark.plans import audits, reports
from panelspark.queries import adapters as a
from panelspark.queries.adapters import cols, r, tidy
from panelspark.session import stored
from panelspark.sources import registry as reg


def quality_audit(spark: SparkSession, d: str) -> DataFrame:
    """Nation days with a few impossible values made from the day number."""
    daily = a.daily_nation(spark, d)
    doy = F.dayofyear("period")
    bad = F.when(doy == 10, -F.col("demand_mw")).when(doy == 20, F.lit(0.0)).when(
        (doy == 30) & (F.col("respondent") < "NATION_2"), F.col("demand_mw") * 100).when(
        (doy > 340) & F.col("respondent").startswith("NATION_1"), F.lit(None)).otherwise(F.col("demand_mw"))
    return tidy(audits.quality_audit(daily.withColumn("demand_mw", bad), "respondent"))


QUALITY_AUDIT = f"""WITH {a.NATION_SQL},
bad AS (
  SELECT respondent, eia_forecast_mw AS f, CASE WHEN dayofyear(period) = 10 THEN -demand_mw WHEN dayofyear(period) = 20 THEN 0
    WHEN dayofyear(period) = 30 AND respondent < 'NATION_2' THEN demand_mw * 100
    WHEN dayofyear(period) > 340 AND respondent LIKE 'NATION_1%' THEN NULL ELSE demand_mw END AS v FROM nation_daily),
s AS (
  SELECT respondent, count(*) AS n_rows, max(v) AS max_demand, count(CASE WHEN v > 500000 THEN 1 END) AS n_overflow, count(CASE WHEN v < 0 THEN 1 END) AS n_negative,
    count(CASE WHEN v = 0 THEN 1 END) AS n_zero, count(CASE WHEN f > 500000 THEN 1 END) AS n_forecast_overflow, count(CASE WHEN f < 0 THEN 1 END) AS n_forecast_negative,
    count(CASE WHEN f = 0 THEN 1 END) AS n_forecast_zero, count(*) - count(v) AS n_missing, median(v) AS median FROM bad GROUP BY 1),
i AS (
  SELECT *, concat_ws('|', CASE WHEN n_overflow > 0 THEN 'OVERFLOW' END, CASE WHEN n_negative > 0 THEN 'NEGATIVE' END, CASE WHEN n_zero > 0 THEN 'ZERO' END,
    CASE WHEN n_forecast_overflow > 0 THEN 'EIA_OVERFLOW' END, CASE WHEN n_forecast_negative > 0 THEN 'EIA_NEG' END, CASE WHEN n_forecast_zero > 0 THEN 'EIA_ZERO' END,
    CASE WHEN max_demand > 10 * median THEN 'OUTLIER' END, CASE WHEN CAST(n_missing AS DOUBLE) / n_rows > 0.02e0 THEN 'HIGH_NaN' END) AS issues FROM s)
SELECT * REPLACE ({r('max_demand')} AS max_demand, {r('median')} AS median), CASE WHEN issues = '' THEN 'OK' ELSE 'ISSUE' END AS verdict FROM i"""


def completeness_check(spark: SparkSession, d: str) -> DataFrame:
    """Weather per type: one type starts late, one ends early, one lacks values, one has no rows at all; their rows carry a code that is not asked for."""
    w = a.weather_hourly(spark, d)
    kind, day = F.col("respondent"), F.day("period")
    away = ((kind == "click") & (day < 12)) | ((kind == "error") & (day > 20)) | (kind == "view")
    w = w.withColumn("respondent", F.when(away, "elsewhere").otherwise(kind))
    w = w.withColumn("dewpoint_2m", F.when((kind != "purchase") | (F.col("windspeed_10m") > 45), F.col("dewpoint_2m")))
    codes = a.table(spark, d, "events").select(F.col("event_type").alias("respondent")).distinct()
    return tidy(audits.completeness(w, "respondent", "period", "2024-01-01 00:00:00", "2024-01-31 00:00:00",
                                    ("temp_2m", "dewpoint_2m", "windspeed_10m"), codes))


COMPLETENESS = f"""WITH {a.WEATHER_SQL},
w AS (
  SELECT respondent, period, temp_2m, CASE WHEN respondent <> 'purchase' OR windspeed_10m > 45 THEN dewpoint_2m END AS dewpoint_2m, windspeed_10m
  FROM weather_hourly WHERE NOT (respondent = 'click' AND day(period) < 12) AND NOT (respondent = 'error' AND day(period) > 20) AND respondent <> 'view'),
s AS (
  SELECT c.respondent, count(period) AS n_rows, min(period) AS first_period, max(period) AS last_period,
    count(period) - count(temp_2m) AS a, count(period) - count(dewpoint_2m) AS b, count(period) - count(windspeed_10m) AS c
  FROM (SELECT DISTINCT event_type AS respondent FROM events) c LEFT JOIN w ON w.respondent = c.respondent GROUP BY 1),
x AS (
  SELECT respondent, n_rows, first_period, last_period, CASE WHEN n_rows = 0 THEN 'Empty dataframe' WHEN first_period > TIMESTAMP '2024-01-08' THEN 'Start date too late'
    WHEN last_period < TIMESTAMP '2024-01-24' THEN 'End date too early' WHEN a > n_rows * 0.5e0 THEN 'Too many NaN in temp_2m'
    WHEN b > n_rows * 0.5e0 THEN 'Too many NaN in dewpoint_2m' WHEN c > n_rows * 0.5e0 THEN 'Too many NaN in windspeed_10m'
    WHEN n_rows < 720 * 0.9e0 THEN 'Too few rows' ELSE 'Valid' END AS reason FROM s)
SELECT *, CAST(reason = 'Valid' AS INTEGER) AS is_valid FROM x"""


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
          "labels", "conversations")


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return audits.table_counts({n: a.table(spark, d, n) for n in TABLES})


TABLE_COUNTS = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}"
    for n in TABLES)


def range_stats(spark: SparkSession, d: str) -> DataFrame:
    return tidy(audits.range_stats(a.daily_region(spark, d), "respondent", "period", "demand_mw",
                                   "1997-01-01 00:00:00", "1999-12-31 00:00:00"))


RANGE_STATS = f"""WITH {a.DAILY_SQL} SELECT respondent, {r('min(demand_mw)')} AS min_value, {r('max(demand_mw)')} AS max_value, {r('avg(demand_mw)')} AS avg_value
FROM daily WHERE period BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31' GROUP BY 1"""


def ranked_avg(spark: SparkSession, d: str) -> DataFrame:
    return tidy(audits.ranked_mean(a.daily_nation(spark, d), "respondent", "period", "demand_mw"))


RANKED_AVG = f"WITH {a.NATION_SQL} SELECT respondent, {r('avg(demand_mw)')} AS avg_value FROM nation_daily GROUP BY 1"


def month_avg(spark: SparkSession, d: str) -> DataFrame:
    return tidy(audits.ranked_mean(a.daily_nation(spark, d), "respondent", "period", "demand_mw", month=7))


MONTH_AVG = f"WITH {a.NATION_SQL} SELECT respondent, {r('avg(demand_mw)')} AS avg_value FROM nation_daily WHERE month(period) = 7 GROUP BY 1"


def period_extent(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "events").agg(
        F.min("ts").alias("first_period"), F.max("ts").alias("last_period"), F.count(F.lit(1)).alias("n_rows"))


PERIOD_EXTENT = "SELECT min(ts) AS first_period, max(ts) AS last_period, count(*) AS n_rows FROM events"


def fetch_stats(spark: SparkSession, d: str) -> DataFrame:
    return tidy(audits.fetch_stats(a.hourly_long(spark, d), "type", "value"))


FETCH_STATS = f"WITH {a.HOURLY_LONG_SQL} SELECT type, count(*) AS n_rows, {r('100.0e0 * (count(*) - count(value)) / count(*)')} AS pct_missing FROM hourly_long GROUP BY 1"


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """All series at one hour."""
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return tidy(a.hourly_long(spark, d).where(F.col("period") == at))


POINT_LOOKUP = f"WITH {a.HOURLY_LONG_SQL} SELECT respondent, period, type, {r('value')} AS value FROM hourly_long WHERE period = TIMESTAMP '2024-01-15 12:00:00'"


def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    """First five rows in a stable order: the look at a table the checks print."""
    return tidy(a.weather_hourly(spark, d).orderBy("period", "respondent").limit(5))


SAMPLE_ROWS = f"WITH {a.WEATHER_SQL} SELECT respondent, period, {cols('temp_2m dewpoint_2m windspeed_10m solar_irradiance cloudcover precipitation')} FROM weather_hourly ORDER BY period, respondent LIMIT 5"


def registry_filter(spark: SparkSession, d: str) -> DataFrame:
    out = reg.select_regions(a.registry(spark, d), region="europe", max_priority=4)
    return tidy(out.select("code", "region", "priority"))


REGISTRY_FILTER = f"WITH {a.REGISTRY_SQL} SELECT code, region, priority FROM registry WHERE enabled AND lower(region) = 'europe' AND priority <= 4"


def resolve_regions(spark: SparkSession, d: str) -> DataFrame:
    """Customer segments and nations as requested codes: the segments are not known."""
    nations = a.table(spark, d, "nation").select(F.lower("n_name").alias("code"))
    segments = a.table(spark, d, "customer").select(F.col("c_mktsegment").alias("code")).distinct()
    return reg.resolve(nations.unionByName(segments), a.registry(spark, d))


RESOLVE_REGIONS = """SELECT upper(n_name) AS code, 1 AS is_known FROM nation UNION ALL SELECT DISTINCT upper(c_mktsegment), 0 FROM customer"""


def missing_entities(spark: SparkSession, d: str) -> DataFrame:
    """Nations without coordinates: those where the balances of all suppliers are at most 9000."""
    best = a.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("best"))
    coordinates = best.where("best > 9000").join(
        a.registry(spark, d), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lower("code").alias("code"))
    return reg.without_coordinates(a.registry(spark, d).select("code"), coordinates)


MISSING_ENTITIES = "SELECT n_name AS code FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING max(s_acctbal) > 9000)"


def not_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Customers (as codes) whose orders are all less than urgent, or that have none."""
    codes = a.table(spark, d, "customer").select(F.col("c_custkey").alias("code"))
    first = a.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.min("o_orderpriority").alias("p"))
    loaded = first.where("p = '1-URGENT'").select("code")
    return joins.difference(codes, loaded, ["code"])


NOT_LOADED = "SELECT c_custkey AS code FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING min(o_orderpriority) = '1-URGENT')"


def distinct_codes(spark: SparkSession, d: str) -> DataFrame:
    return a.hourly_long(spark, d).select("respondent", "type").distinct()


DISTINCT_CODES = f"WITH {a.HOURLY_LONG_SQL} SELECT DISTINCT respondent, type FROM hourly_long"


def range_scan(spark: SparkSession, d: str) -> DataFrame:
    return tidy(joins.series_scan(a.hourly_long(spark, d), "click", "NG", "2024-01-05 06:00:00", "2024-01-20 18:00:00"))


RANGE_SCAN = f"""WITH {a.HOURLY_LONG_SQL} SELECT respondent, period, type, {r('value')} AS value FROM hourly_long
WHERE respondent = 'click' AND type = 'NG' AND period BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'"""


def align_left(spark: SparkSession, d: str) -> DataFrame:
    """Weather and generation aligned to the demand hours; weather is missing in dry hours, generation where it does not exceed the flow."""
    spine = a.hourly_grid(spark, d).select("respondent", "period", "demand_mw")
    wet = F.col("precipitation") > 0
    weather = a.weather_hourly(spark, d).select("respondent", "period", *[F.when(wet, F.col(c)).alias(c) for c in ("temp_2m", "windspeed_10m")])
    ng = a.hourly_wide(spark, d).select("respondent", "period", F.when(F.col("TI") > 0, F.col("NG")).alias("ng"))
    return tidy(joins.align(spine, a.HOURLY, weather, ng))


ALIGN_LEFT = f"""WITH {a.HOURLY_GRID_SQL}, {a.WEATHER_SQL}
SELECT g.respondent, g.period, {r('demand_mw')} AS demand_mw, {cols('temp_2m windspeed_10m')}, {r('n.ng')} AS ng
FROM hourly_grid g LEFT JOIN (SELECT * FROM weather_hourly WHERE precipitation > 0) w ON w.respondent = g.respondent AND w.period = g.period
LEFT JOIN (SELECT * FROM hourly_wide WHERE ti > 0) n ON n.respondent = g.respondent AND n.period = g.period"""

_FEATURES = ("lag_24h", "lag_48h", "ng", "eia_forecast_mw", "constant")


def _feature_rows(spark: SparkSession, d: str) -> DataFrame:
    grid = a.hourly_grid(spark, d)
    stage = {k: v for k, v in demand.lags().items() if k != "lag_168h"}
    return over_blocks(grid, a.HOURLY_SHORT, stage).withColumn("constant", F.lit(7.0))


FEATURE_SQL = f"""{a.HOURLY_GRID_SQL},
feats AS (
  SELECT *, lag(demand_mw, 24) OVER w AS lag_24h, lag(demand_mw, 48) OVER w AS lag_48h, CAST(7 AS DOUBLE) AS constant
  FROM hourly_grid WINDOW w AS (PARTITION BY respondent ORDER BY period))"""


def corr_importance(spark: SparkSession, d: str) -> DataFrame:
    return tidy(audits.correlations(_feature_rows(spark, d), ["respondent"], list(_FEATURES), "demand_mw"))


CORR_IMPORTANCE = f"WITH {FEATURE_SQL} " + " UNION ALL ".join(
    f"SELECT respondent, '{f}' AS feature, {r('0' if f == 'constant' else f'coalesce(abs(corr({f}, demand_mw)), 0)')} AS abs_corr FROM feats GROUP BY 1"
    for f in _FEATURES)


def median_impute(spark: SparkSession, d: str) -> DataFrame:
    grid = a.hourly_grid(spark, d).select("respondent", "period", "demand_mw", "ng", "ti")
    return tidy(scaling.impute_median(grid, ["respondent"], ["demand_mw", "ng", "ti"]))


MEDIAN_IMPUTE = f"""WITH {a.HOURLY_GRID_SQL}, m AS (SELECT respondent, median(demand_mw) AS a, median(ng) AS b, median(ti) AS c FROM hourly_grid GROUP BY 1)
SELECT g.respondent, period, {r('coalesce(demand_mw, a)')} AS demand_mw, {r('coalesce(ng, b)')} AS ng, {r('coalesce(ti, c)')} AS ti
FROM hourly_grid g JOIN m ON m.respondent = g.respondent"""


def clip_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Limit of 2 instead of 5, so that values are cut on both sides."""
    grid = a.hourly_grid(spark, d).select("respondent", "period", "demand_mw", "ng")
    return tidy(scaling.robust_scale(grid, ["respondent"], ["demand_mw", "ng"], limit=2.0))


CLIP_SCALED = f"""WITH {a.HOURLY_GRID_SQL},
q AS (SELECT respondent, {', '.join(f'quantile_cont({c}, {p}) AS {c}_{n}' for c in ('demand_mw', 'ng') for n, p in (('lo', 0.25), ('mid', 0.5), ('hi', 0.75)))} FROM hourly_grid GROUP BY 1)
SELECT g.respondent, period, {', '.join(f"CASE WHEN {c} IS NOT NULL THEN {r(f'greatest(-2, least(2, ({c} - {c}_mid) / ({c}_hi - {c}_lo)))')} END AS {c}" for c in ('demand_mw', 'ng'))}
FROM hourly_grid g JOIN q ON q.respondent = g.respondent"""


def target_standardise(spark: SparkSession, d: str) -> DataFrame:
    grid = a.hourly_grid(spark, d).select("respondent", "period", "demand_mw")
    return tidy(scaling.standardise(grid, ["respondent"], ["demand_mw"], keep_stats=True), 5)


TARGET_STANDARDISE = f"""WITH {a.HOURLY_GRID_SQL}, s AS (SELECT respondent, avg(demand_mw) AS m, coalesce(nullif(stddev_pop(demand_mw), 0), 1) AS sd FROM hourly_grid GROUP BY 1)
SELECT g.respondent, period, {r('(demand_mw - m) / sd', 5)} AS demand_mw, {r('m', 5)} AS mean_demand_mw, {r('sd', 5)} AS std_demand_mw
FROM hourly_grid g JOIN s ON s.respondent = g.respondent"""


def target_rebuild(spark: SparkSession, d: str) -> DataFrame:
    grid = a.hourly_grid(spark, d).select("respondent", "period", "demand_mw")
    lagged = stored(over_blocks(grid, a.HOURLY_SHORT, {"lag_24h": lag("demand_mw", 24)}))
    median = exact_quantiles(lagged, ["respondent"], "demand_mw", {"_median": 0.5})
    out = joins.target_rebuild(lagged.join(median, "respondent"), a.HOURLY_SHORT, F.col("_median"))
    return tidy(out.select("respondent", "period", "y_rebuilt"))


TARGET_REBUILD = f"""WITH {FEATURE_SQL}, m AS (SELECT respondent, median(demand_mw) AS med FROM hourly_grid GROUP BY 1)
SELECT f.respondent, period, {r('coalesce(lead(lag_24h, 24) OVER (PARTITION BY f.respondent ORDER BY period), lag_24h, med)')} AS y_rebuilt
FROM feats f JOIN m ON m.respondent = f.respondent"""


def horizon_pick(spark: SparkSession, d: str) -> DataFrame:
    """Events as forecasts for 24 or 48 hours later; several forecasts for one hour are averaged."""
    made = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    hours = F.when(F.col("user_id") % 2 == 0, 24).otherwise(48)
    forecasts = a.table(spark, d, "events").select(
        F.col("event_type").alias("respondent"), made.alias("cutoff"),
        (made + F.make_dt_interval(F.lit(0), hours)).alias("ds"), a.cents("value").cast("double").alias("yhat"))
    grid = a.hourly_grid(spark, d).select("respondent", "period", "demand_mw")
    lagged = over_blocks(grid, a.HOURLY_SHORT, {"lag_24h": lag("demand_mw", 24)})
    return tidy(joins.horizon_pick(lagged, forecasts, a.HOURLY).drop("demand_mw"))


HORIZON_PICK = f"""WITH {FEATURE_SQL},
fc AS (
  SELECT event_type AS respondent, date_trunc('hour', ts) + INTERVAL 24 HOUR AS ds, avg(round(value * 100)) AS yhat
  FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2)
SELECT f.respondent, period, {r('lag_24h')} AS lag_24h, {r('coalesce(yhat, lag_24h)')} AS prediction
FROM feats f LEFT JOIN fc ON fc.respondent = f.respondent AND fc.ds = f.period"""


def _importance_rows(spark: SparkSession, d: str) -> DataFrame:
    """Correlations as importances per type; the vector of one type lacks an entry and is skipped."""
    pairs = audits.correlations(_feature_rows(spark, d), ["respondent"], list(_FEATURES), "demand_mw")
    packed = pairs.groupBy("respondent").agg(F.array_sort(F.collect_list(F.struct("feature", "abs_corr"))).alias("_p"))
    names, values = F.col("_p.feature"), F.col("_p.abs_corr")
    cut = F.when(F.col("respondent") == "view", F.slice(values, 1, 3)).otherwise(values)
    model = F.when(F.col("respondent").isin("click", "error"), "first").otherwise("second")
    return packed.select(model.alias("model"), names.alias("feature_names"), cut.alias("feature_importance"))


def top_importance(spark: SparkSession, d: str) -> DataFrame:
    return tidy(reports.top_importance(_importance_rows(spark, d), top=4))


TOP_IMPORTANCE = f"""WITH {FEATURE_SQL}, c AS ({' UNION ALL '.join(
    f"SELECT respondent, '{f}' AS feature, {'0' if f == 'constant' else f'coalesce(abs(corr({f}, demand_mw)), 0)'} AS v FROM feats GROUP BY 1" for f in _FEATURES)}),
s AS (
  SELECT CASE WHEN respondent IN ('click', 'error') THEN 'first' ELSE 'second' END AS model, feature, avg(v) AS m, stddev_pop(v) AS sd
  FROM c WHERE respondent <> 'view' GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN m > 0 THEN sd / m ELSE 99 END AS cv, CAST(row_number() OVER (PARTITION BY model ORDER BY m DESC, feature) AS INTEGER) AS rank FROM s)
SELECT model, feature, {r('m')} AS mean_importance, {r('sd')} AS std_importance, {r('cv')} AS cv, rank,
  CASE WHEN cv < 0.3e0 THEN '***' WHEN cv < 0.6e0 THEN '**' ELSE '*' END AS consistency FROM k WHERE rank <= 4"""


QUERIES = {
    "quality_audit": (quality_audit, QUALITY_AUDIT),
    "completeness_check": (completeness_check, COMPLETENESS),
    "table_counts": (table_counts, TABLE_COUNTS),
    "range_stats": (range_stats, RANGE_STATS),
    "ranked_avg": (ranked_avg, RANKED_AVG),
    "month_avg": (month_avg, MONTH_AVG),
    "period_extent": (period_extent, PERIOD_EXTENT),
    "fetch_stats": (fetch_stats, FETCH_STATS),
    "point_lookup": (point_lookup, POINT_LOOKUP),
    "sample_rows": (sample_rows, SAMPLE_ROWS),
    "registry_filter": (registry_filter, REGISTRY_FILTER),
    "resolve_regions": (resolve_regions, RESOLVE_REGIONS),
    "missing_entities": (missing_entities, MISSING_ENTITIES),
    "not_loaded": (not_loaded, NOT_LOADED),
    "distinct_codes": (distinct_codes, DISTINCT_CODES),
    "range_scan": (range_scan, RANGE_SCAN),
    "align_left": (align_left, ALIGN_LEFT),
    "corr_importance": (corr_importance, CORR_IMPORTANCE),
    "median_impute": (median_impute, MEDIAN_IMPUTE),
    "clip_scaled": (clip_scaled, CLIP_SCALED),
    "target_standardise": (target_standardise, TARGET_STANDARDISE),
    "target_rebuild": (target_rebuild, TARGET_REBUILD),
    "horizon_pick": (horizon_pick, HORIZON_PICK),
    "top_importance": (top_importance, TOP_IMPORTANCE),
}
