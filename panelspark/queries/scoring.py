"""Folds, naive forecasts, walk-forward scores and reports built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import cleaning, scoring, splits
from panelspark.operators.blocks import lag, over_blocks
from panelspark.plans import monitoring, reports
from panelspark.queries import adapters as a
from panelspark.queries.adapters import r, tidy
from panelspark.session import stored

MODELS = (scoring.PERSISTENCE_24H, scoring.SEASONAL_168H, scoring.OFFICIAL)
NAME = {scoring.PERSISTENCE_24H: "p24", scoring.SEASONAL_168H: "seasonal"}


def fold_labels(spark: SparkSession, d: str) -> DataFrame:
    daily = a.daily_region(spark, d).select("respondent", "period")
    return tidy(daily.withColumn("fold", splits.fold_label(F.col("period"), a.BASE_YEAR)))


FOLD_LABELS = f"""WITH {a.DAILY_SQL} SELECT respondent, period, CAST(greatest(-1, least(5, year(period) - {a.BASE_YEAR})) AS INTEGER) AS fold FROM daily"""


def baseline_predictions(spark: SparkSession, d: str) -> DataFrame:
    """All four naive forecasts per day (here a lag of one row stands for one hour)."""
    grid = cleaning.regular_grid(a.daily_region(spark, d), a.DAILY)
    rows = over_blocks(grid, a.DAILY, {
        "lag_1h": lag("demand_mw", 1), "lag_24h": lag("demand_mw", 24), "lag_168h": lag("demand_mw", 168)})
    rows = rows.withColumn("eia_forecast_mw", F.when(F.dayofmonth("period") != 15, F.col("eia_forecast_mw")))
    preds = {n: scoring.baseline(rows, n) for n in scoring.BASELINES}
    return tidy(scoring.stack_predictions(rows, ["respondent", "period", "demand_mw"], preds))


BASELINE_PREDICTIONS = f"""WITH {a.DAILY_SQL},
lagged AS (
  SELECT respondent, period, demand_mw, CASE WHEN day(period) <> 15 THEN eia_forecast_mw END AS f, lag(demand_mw, 1) OVER w AS l1,
    lag(demand_mw, 24) OVER w AS l24, lag(demand_mw, 168) OVER w AS l168 FROM daily_grid WINDOW w AS (PARTITION BY respondent ORDER BY period))
SELECT respondent, period, {r('demand_mw')} AS demand_mw, model, {r('p')} AS prediction FROM (
  SELECT *, '{scoring.PERSISTENCE_1H}' AS model, l1 AS p FROM lagged UNION ALL SELECT *, '{scoring.PERSISTENCE_24H}', l24 FROM lagged
  UNION ALL SELECT *, '{scoring.SEASONAL_168H}', l168 FROM lagged UNION ALL SELECT *, '{scoring.OFFICIAL}', coalesce(f, l168) FROM lagged)"""


def _scores(spark: SparkSession, d: str, level: str = "r_name", keys: tuple[str, ...] = ("respondent",)) -> DataFrame:
    rows = a.daily_scored(spark, d, level)
    return scoring.compare(rows, list(keys), {m: scoring.baseline(rows, m) for m in MODELS})


def scores_sql(panel_sql: str, name: str, keys: str = "respondent") -> str:
    return f"""{panel_sql}, {a.scored_sql(name)},
predictions AS (
  SELECT {keys}, fold, demand_mw AS y, '{scoring.PERSISTENCE_24H}' AS model, lag_24h AS p FROM scored
  UNION ALL SELECT {keys}, fold, demand_mw, '{scoring.SEASONAL_168H}', lag_168h FROM scored
  UNION ALL SELECT {keys}, fold, demand_mw, '{scoring.OFFICIAL}', coalesce(eia_forecast_mw, lag_168h) FROM scored),
usable AS (
  SELECT x.* FROM predictions x JOIN (SELECT {keys}, min(fold) AS first_fold FROM scored GROUP BY {keys}) f USING ({keys})
  WHERE fold BETWEEN 0 AND 4 AND first_fold < fold),
scores AS (
  SELECT {keys}, model, coalesce(CAST(fold AS VARCHAR), 'overall') AS fold, {r('avg(abs(y - p))', 2)} AS mae,
    {r('sqrt(avg((y - p) ** 2))', 2)} AS rmse,
    {r('avg(CASE WHEN abs(y) + abs(p) > 0 THEN 200 * abs(y - p) / (abs(y) + abs(p)) END)', 3)} AS smape, count(y - p) AS n_rows
  FROM usable GROUP BY GROUPING SETS (({keys}, model, fold), ({keys}, model)))"""


SCORES_SQL = scores_sql(a.DAILY_SQL, "daily")
NATION_SCORES_SQL = scores_sql(a.NATION_SQL, "nation_daily")


def walk_forward_scores(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_scores(spark, d))


WALK_FORWARD = f"WITH {SCORES_SQL} SELECT * FROM scores"


def evaluate_own_model(spark: SparkSession, d: str) -> DataFrame:
    """A user-defined model: per region and weekday the mean of the training folds."""
    rows = a.daily_scored(spark, d).withColumn("dow", F.weekday("period"))

    def fit_predict(train: DataFrame, valid: DataFrame) -> DataFrame:
        means = train.groupBy("respondent", "dow").agg(F.avg("demand_mw").alias("prediction"))
        return valid.join(means, ["respondent", "dow"], "left")

    return tidy(scoring.evaluate_model(rows, ["respondent"], fit_predict, "weekday-mean"))


EVALUATE_OWN = f"""WITH {a.DAILY_SQL}, {a.scored_sql('daily')},
folds AS (SELECT unnest(range(0, 5)) AS k),
means AS (
  SELECT respondent, k, isodow(period) AS dow, avg(demand_mw) AS p FROM scored JOIN folds ON fold < k GROUP BY 1, 2, 3),
pairs AS (
  SELECT s.respondent, fold, demand_mw AS y, p FROM scored s LEFT JOIN means m
  ON m.respondent = s.respondent AND m.k = s.fold AND m.dow = isodow(s.period) WHERE fold BETWEEN 0 AND 4)
SELECT respondent, 'weekday-mean' AS model, coalesce(CAST(fold AS VARCHAR), 'overall') AS fold, {r('avg(abs(y - p))', 2)} AS mae,
  {r('sqrt(avg((y - p) ** 2))', 2)} AS rmse, {r('avg(200 * abs(y - p) / (abs(y) + abs(p)))', 3)} AS smape, count(y - p) AS n_rows
FROM pairs GROUP BY GROUPING SETS ((respondent, fold), (respondent))"""


def model_summary(spark: SparkSession, d: str) -> DataFrame:
    return tidy(scoring.summary(_scores(spark, d), ["respondent"]))


MODEL_SUMMARY = f"""WITH {SCORES_SQL} SELECT * EXCLUDE (fold), CAST(row_number() OVER (PARTITION BY respondent ORDER BY rmse, model) AS INTEGER) AS rank
FROM scores WHERE fold = 'overall'"""


def aggregate_summary(spark: SparkSession, d: str) -> DataFrame:
    return tidy(reports.aggregate_summary(_scores(spark, d)))


AGGREGATE_SUMMARY = f"""WITH {SCORES_SQL} SELECT model, {r('avg(mae)', 2)} AS mae, {r('avg(rmse)', 2)} AS rmse, {r('avg(smape)', 3)} AS smape
FROM scores WHERE fold = 'overall' GROUP BY model"""


def fold_pivot(spark: SparkSession, d: str) -> DataFrame:
    return tidy(reports.fold_rmse(_scores(spark, d), ["respondent"], [scoring.OFFICIAL, scoring.PERSISTENCE_24H], a.FOLDS))


FOLD_PIVOT = f"""WITH {SCORES_SQL} SELECT respondent, model, {', '.join(f"max(CASE WHEN fold = '{f}' THEN rmse END) AS rmse_{f}" for f in a.FOLDS)}
FROM scores WHERE model IN ('{scoring.OFFICIAL}', '{scoring.PERSISTENCE_24H}') GROUP BY 1, 2"""

VERSUS_SQL = f"""{NATION_SCORES_SQL},
versus AS (
  SELECT m.respondent, m.model, m.mae, m.rmse, m.smape, m.n_rows, b.rmse AS benchmark_rmse,
    {r('100 * (m.rmse - b.rmse) / b.rmse', 2)} AS vs_benchmark_pct, CASE WHEN m.rmse < b.rmse THEN 'BEAT' ELSE 'below' END AS verdict
  FROM scores m JOIN scores b ON b.respondent = m.respondent AND b.fold = 'overall' AND b.model = '{scoring.PERSISTENCE_24H}'
  WHERE m.fold = 'overall' AND m.model <> '{scoring.PERSISTENCE_24H}')"""


def _versus(spark: SparkSession, d: str) -> DataFrame:
    """Nations against the one-day persistence, so that models win in some and lose in others."""
    return reports.versus_benchmark(_scores(spark, d, "n_name"), ["respondent"], scoring.PERSISTENCE_24H)


def vs_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_versus(spark, d))


VS_BENCHMARK = f"WITH {VERSUS_SQL} SELECT * FROM versus"


def win_rate(spark: SparkSession, d: str) -> DataFrame:
    return tidy(reports.win_rate(_versus(spark, d)), 4)


WIN_RATE = f"""WITH {VERSUS_SQL}
SELECT model, count(CASE WHEN rmse < benchmark_rmse THEN 1 END) AS wins, count(*) AS n, {r('avg(rmse)', 4)} AS mean_rmse, {r('median(rmse)', 4)} AS median_rmse,
  {r('avg(benchmark_rmse)', 4)} AS mean_benchmark, {r('median(benchmark_rmse)', 4)} AS median_benchmark,
  {r('100 * (avg(rmse) - avg(benchmark_rmse)) / avg(benchmark_rmse)', 4)} AS mean_vs_pct, {r('median(vs_benchmark_pct)', 4)} AS median_vs_pct,
  {r('avg(mae)', 4)} AS mean_mae, {r('avg(smape)', 4)} AS mean_smape FROM versus GROUP BY model"""


def explosions(spark: SparkSession, d: str) -> DataFrame:
    """Ratio 0.9 instead of 50, so that some regions are listed."""
    return tidy(reports.explosions(_versus(spark, d), "respondent", ratio=0.9))


EXPLOSIONS = f"""WITH {VERSUS_SQL},
hit AS (SELECT model, respondent || '(' || CAST(CAST(round(rmse / benchmark_rmse) AS BIGINT) AS VARCHAR) || 'x)' AS label FROM versus WHERE rmse >= 0.9e0 * benchmark_rmse)
SELECT model, count(*) AS n_exploded, string_agg(label, ', ' ORDER BY label) AS exploded FROM hit GROUP BY 1"""


def score_pivot(spark: SparkSession, d: str) -> DataFrame:
    models = {scoring.SEASONAL_168H: "seasonal", scoring.OFFICIAL: "official"}
    return tidy(reports.score_pivot(_versus(spark, d), "respondent", models, ratio=0.9))


SCORE_PIVOT = f"""WITH {VERSUS_SQL} SELECT respondent, max(benchmark_rmse) AS benchmark_rmse, {', '.join(
    f"max(CASE WHEN model = '{m}' THEN rmse END) AS {p}_rmse, max(CASE WHEN model = '{m}' THEN vs_benchmark_pct END) AS {p}_pct, "
    f"max(CASE WHEN model = '{m}' THEN CAST(rmse > 0.9e0 * benchmark_rmse AS INTEGER) END) AS {p}_exploded"
    for m, p in ((scoring.SEASONAL_168H, 'seasonal'), (scoring.OFFICIAL, 'official')))}
FROM versus GROUP BY 1"""


def head_to_head(spark: SparkSession, d: str) -> DataFrame:
    return tidy(reports.head_to_head(_versus(spark, d), "respondent", "NATION_7"))


HEAD_TO_HEAD = f"WITH {VERSUS_SQL} SELECT * FROM versus WHERE respondent = 'NATION_7'"


def priority_summary(spark: SparkSession, d: str) -> DataFrame:
    reg = a.registry(spark, d).select(F.col("code").alias("respondent"), "priority", "enabled")
    return tidy(monitoring.priority_summary(_scores(spark, d, "n_name"), reg, "respondent"))


PRIORITY_SUMMARY = f"""WITH {NATION_SCORES_SQL}, {a.REGISTRY_SQL},
best AS (SELECT respondent, model, rmse FROM scores WHERE fold = 'overall' AND rmse IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY respondent ORDER BY rmse, model) = 1)
SELECT code AS respondent, priority, model AS best_model, rmse AS best_rmse, CAST(row_number() OVER (ORDER BY priority, code) AS INTEGER) AS position
FROM registry LEFT JOIN best ON code = respondent WHERE enabled"""


def champion_choice(spark: SparkSession, d: str) -> DataFrame:
    overall = stored(_scores(spark, d, "n_name").where("fold = 'overall'"))
    champion = overall.where(F.col("model") == scoring.PERSISTENCE_24H)
    challenger = overall.where(F.col("model") == scoring.SEASONAL_168H)
    return tidy(monitoring.champion_choice(champion, challenger, ["respondent"]))


CHAMPION_CHOICE = f"""WITH {NATION_SCORES_SQL}
SELECT c.respondent, c.rmse AS champion_rmse, h.rmse AS challenger_rmse, {r('(c.rmse - h.rmse) / c.rmse')} AS improvement,
  CAST(coalesce((c.rmse - h.rmse) / c.rmse >= 0.02e0, c.rmse IS NULL AND h.rmse IS NOT NULL) AS INTEGER) AS replace
FROM scores c JOIN scores h ON h.respondent = c.respondent AND h.fold = 'overall' AND h.model = '{scoring.SEASONAL_168H}'
WHERE c.fold = 'overall' AND c.model = '{scoring.PERSISTENCE_24H}'"""


def drift_rmse(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(a.daily_scored(spark, d))
    train = scoring.score(rows.where("fold <= 2"), ["respondent"], "demand_mw", "lag_168h").select(
        "respondent", F.col("rmse").alias("train_rmse"))
    out = monitoring.drift(rows.withColumn("prediction", F.col("lag_168h")), a.DAILY, train, steps=7)
    return tidy(out.select("respondent", "period", "train_rmse", "rolling_rmse", "drift", "alert"), 4)


DRIFT_RMSE = f"""WITH {a.DAILY_SQL}, {a.scored_sql('daily')},
train AS (SELECT respondent, {r('sqrt(avg((demand_mw - lag_168h) ** 2))', 2)} AS t FROM scored WHERE fold <= 2 GROUP BY 1),
rolled AS (
  SELECT respondent, period, sqrt(avg((demand_mw - lag_168h) ** 2) OVER (PARTITION BY respondent ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) AS rolling_rmse
  FROM scored)
SELECT x.respondent, period, {r('t', 4)} AS train_rmse, {r('rolling_rmse', 4)} AS rolling_rmse, {r('(rolling_rmse - t) / t', 4)} AS drift,
  CAST(coalesce((rolling_rmse - t) / t > 0.15e0, false) AS INTEGER) AS alert
FROM rolled x JOIN train ON train.respondent = x.respondent"""


def training_window(spark: SparkSession, d: str) -> DataFrame:
    return tidy(monitoring.training_window(a.daily_region(spark, d), "period", "2000-06-30 00:00:00"))


TRAINING_WINDOW = f"""WITH {a.DAILY_SQL} SELECT respondent, period, {a.cols('demand_mw eia_forecast_mw')} FROM daily
WHERE period > TIMESTAMP '2000-06-30' - INTERVAL 730 DAY AND period <= TIMESTAMP '2000-06-30'"""


def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return tidy(splits.holdout_split(a.daily_region(spark, d).select("respondent", "period"), a.DAILY))


HOLDOUT_SPLIT = f"""WITH {a.DAILY_SQL},
placed AS (SELECT respondent, period, row_number() OVER (PARTITION BY respondent ORDER BY period) AS pos, count(*) OVER (PARTITION BY respondent) AS n FROM daily)
SELECT respondent, period, CASE WHEN pos <= floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS split FROM placed"""


def ts_split(spark: SparkSession, d: str) -> DataFrame:
    return tidy(splits.time_series_split(a.daily_region(spark, d).select("respondent", "period"), a.DAILY))


TS_SPLIT = f"""WITH {a.DAILY_SQL},
placed AS (SELECT respondent, period, row_number() OVER (PARTITION BY respondent ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY respondent) AS n FROM daily),
folds AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS split_no),
roles AS (
  SELECT respondent, period, split_no, CASE WHEN i >= n - (6 - split_no) * (n // 6) AND i < n - (5 - split_no) * (n // 6) THEN 'test'
    WHEN i < n - (6 - split_no) * (n // 6) - 24 THEN 'train' END AS role FROM placed, folds)
SELECT * FROM roles WHERE role IS NOT NULL"""


def tail_split(spark: SparkSession, d: str) -> DataFrame:
    grid = a.hourly_grid(spark, d).select("respondent", "period")
    return tidy(splits.tail_split(grid, a.HOURLY_SHORT))


TAIL_SPLIT = f"""WITH {a.HOURLY_GRID_SQL},
placed AS (SELECT respondent, period, row_number() OVER (PARTITION BY respondent ORDER BY period) AS pos, count(*) OVER (PARTITION BY respondent) AS n FROM hourly_grid)
SELECT respondent, period, CAST(pos > n - greatest(1, floor(n * 0.1e0)) AS INTEGER) AS is_validation FROM placed"""


def min_length(spark: SparkSession, d: str) -> DataFrame:
    """At least 680 hours with data: two of the five types fall short."""
    return splits.min_length(a.hourly_wide(spark, d), ["respondent"], 680)


MIN_LENGTH = f"WITH {a.HOURLY_WIDE_SQL} SELECT respondent, count(*) AS n_rows FROM hourly_wide GROUP BY 1 HAVING count(*) >= 680"


QUERIES = {
    "fold_labels": (fold_labels, FOLD_LABELS),
    "baseline_predictions": (baseline_predictions, BASELINE_PREDICTIONS),
    "walk_forward_scores": (walk_forward_scores, WALK_FORWARD),
    "evaluate_own_model": (evaluate_own_model, EVALUATE_OWN),
    "model_summary": (model_summary, MODEL_SUMMARY),
    "aggregate_summary": (aggregate_summary, AGGREGATE_SUMMARY),
    "fold_pivot": (fold_pivot, FOLD_PIVOT),
    "vs_benchmark": (vs_benchmark, VS_BENCHMARK),
    "win_rate": (win_rate, WIN_RATE),
    "explosions": (explosions, EXPLOSIONS),
    "score_pivot": (score_pivot, SCORE_PIVOT),
    "head_to_head": (head_to_head, HEAD_TO_HEAD),
    "priority_summary": (priority_summary, PRIORITY_SUMMARY),
    "champion_choice": (champion_choice, CHAMPION_CHOICE),
    "drift_rmse": (drift_rmse, DRIFT_RMSE),
    "training_window": (training_window, TRAINING_WINDOW),
    "holdout_split": (holdout_split, HOLDOUT_SPLIT),
    "ts_split": (ts_split, TS_SPLIT),
    "tail_split": (tail_split, TAIL_SPLIT),
    "min_length": (min_length, MIN_LENGTH),
}
