"""Trained models on the daily panel; single cuts are checked by SQL, the others against slow versions and closed forms in the tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import scoring
from panelspark.plans import reports, ridge, training, trees
from panelspark.queries import adapters as a
from panelspark.queries.adapters import r, tidy
from panelspark.session import checkpoint_root, stored

FEATURES = ["lag_24h", "lag_48h", "lag_168h", "day_of_week", "month"]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    rows = a.daily_scored(spark, d).withColumns({
        "day_of_week": F.weekday("period").cast("double"), "month": F.month("period").cast("double")})
    return stored(rows.where("demand_mw IS NOT NULL"))


def _scored(rows: DataFrame, predicted: DataFrame, name: str) -> DataFrame:
    return scoring.walk_forward(predicted.withColumn("model", F.lit(name)), ["respondent"], rows=rows)


def ridge_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    model = stored(ridge.fit(rows, ["respondent"], FEATURES))
    predicted = ridge.walk_forward_predictions(rows, model, ["respondent"], FEATURES)
    return tidy(_scored(rows, predicted, "Ridge"))


def ridge_importance(spark: SparkSession, d: str) -> DataFrame:
    model = ridge.fit(_rows(spark, d), ["respondent"], FEATURES)
    vectors = ridge.importance(model, ["respondent"], FEATURES).where("k = 4").withColumn("model", F.lit("Ridge"))
    return tidy(reports.top_importance(vectors))


def ridge_closed_form(spark: SparkSession, d: str) -> DataFrame:
    """The model of one feature for every region and training set, where SQL can solve the normal equations."""
    model = ridge.fit(_rows(spark, d), ["respondent"], FEATURES[2:3])
    first = {c: F.get(f"{c}s", F.lit(0)).alias(c) for c in ("median", "scale", "coefficient")}
    return tidy(model.select("respondent", "k", "n_train", first["median"], first["scale"], "intercept", first["coefficient"]), 3)


RIDGE_CLOSED_FORM = f"""WITH {a.DAILY_SQL}, {a.scored_sql('daily')},
sets AS (
  SELECT respondent, k, demand_mw AS y, lag_168h AS x FROM scored JOIN (SELECT unnest(range(0, 6)) AS k) ON fold < k AND fold < 5
  WHERE demand_mw IS NOT NULL),
medians AS (SELECT respondent, k, coalesce(quantile_cont(x, 0.5), 0) AS med FROM sets GROUP BY 1, 2),
filled AS (SELECT respondent, k, y, med, coalesce(x, med) AS v FROM sets JOIN medians USING (respondent, k)),
spreads AS (
  SELECT respondent, k, coalesce(nullif(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 0), 1) AS scale FROM filled GROUP BY 1, 2),
scaled AS (
  SELECT respondent, k, y, med, scale, greatest(-5, least(5, (v - med) / scale)) AS z FROM filled JOIN spreads USING (respondent, k)),
means AS (SELECT respondent, k, med, scale, count(*) AS n, avg(z) AS mz, avg(y) AS my FROM scaled GROUP BY ALL),
solved AS (
  SELECT respondent, k, med, scale, n, mz, my, sum((z - mz) * (y - my)) / (sum((z - mz) * (z - mz)) + 1) AS beta
  FROM scaled JOIN means USING (respondent, k, med, scale) GROUP BY ALL)
SELECT respondent, CAST(k AS INTEGER) AS k, n AS n_train, {r('med', 3)} AS median, {r('scale', 3)} AS scale, {r('my - mz * beta', 3)} AS intercept,
  {r('beta', 3)} AS coefficient FROM solved"""


def _tree_scores(spark: SparkSession, d: str, key: str) -> DataFrame:
    """A model of every region and fold with the registry's parameters."""
    rows, growth = _rows(spark, d), trees.VARIANTS[key]
    fitted = stored(trees.fit(rows, ["respondent"], FEATURES, growth))
    return tidy(_scored(rows, trees.walk_forward_predictions(rows, fitted, ["respondent"], FEATURES), growth.name))


def gbt_scores(spark: SparkSession, d: str) -> DataFrame:
    return _tree_scores(spark, d, "xgboost")


def hist_gb_scores(spark: SparkSession, d: str) -> DataFrame:
    return _tree_scores(spark, d, "hist_gb")


def forest_scores(spark: SparkSession, d: str) -> DataFrame:
    return _tree_scores(spark, d, "random_forest")


#: One cut on two calendar features, where every value is a quantile cut, so SQL can try them all.
STUMP = trees.variant("xgboost", rounds=1, depth=1, rate=1.0, l2=0.0, rows=1.0, columns=1.0)
CALENDAR = ["day_of_week", "month"]


def _stumps(rows: DataFrame) -> DataFrame:
    return stored(trees.fit(rows, ["respondent"], CALENDAR, STUMP))


def tree_stumps(spark: SparkSession, d: str) -> DataFrame:
    """The best single cut of each region and training set."""
    names = F.array(*[F.lit(c) for c in CALENDAR])
    return tidy(_stumps(_rows(spark, d)).select(
        "respondent", "k", "n_train", "base", F.get(names, F.get("node_feature", F.lit(0))).alias("feature"), F.get("threshold", F.lit(0)).alias("threshold"),
        F.get("value", F.lit(1)).alias("low_value"), F.get("value", F.lit(2)).alias("high_value")), 3)


_STUMPS = f"""{a.DAILY_SQL}, {a.scored_sql('daily')},
sets AS (
  SELECT respondent, k, demand_mw AS y, isodow(period) - 1 AS day_of_week, month(period) AS month
  FROM scored JOIN (SELECT unnest(range(0, 6)) AS k) ON fold < k AND fold < 5 WHERE demand_mw IS NOT NULL),
bases AS (SELECT respondent, k, avg(y) AS base, count(*) AS n_train FROM sets GROUP BY 1, 2),
long AS (
  SELECT respondent, k, 0 AS f, day_of_week AS v, y FROM sets UNION ALL SELECT respondent, k, 1, month, y FROM sets),
cells AS (SELECT respondent, k, f, v, count(*) AS n, sum(y - base) AS s FROM long JOIN bases USING (respondent, k) GROUP BY 1, 2, 3, 4),
cuts AS (
  SELECT respondent, k, f, v, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER t AS n, sum(s) OVER t AS s FROM cells
  WINDOW w AS (PARTITION BY respondent, k, f ORDER BY v), t AS (PARTITION BY respondent, k, f)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY respondent, k ORDER BY round(sl * sl / nl + (s - sl) * (s - sl) / (n - nl), 3) DESC, f, v) AS place FROM cuts WHERE nl < n),
stumps AS (
  SELECT respondent, k, n_train, base, f, CAST(v AS DOUBLE) AS threshold, sl / nl AS low_value, (s - sl) / (best.n - nl) AS high_value
  FROM best JOIN bases USING (respondent, k) WHERE place = 1)"""

TREE_STUMPS = f"""WITH {_STUMPS}
SELECT respondent, CAST(k AS INTEGER) AS k, n_train, {r('base', 3)} AS base, CASE f WHEN 0 THEN 'day_of_week' ELSE 'month' END AS feature, threshold,
  {r('low_value', 3)} AS low_value, {r('high_value', 3)} AS high_value FROM stumps"""


def tree_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Models published twice, the newest version read back and joined to the validation rows."""
    rows, path = _rows(spark, d), f"{checkpoint_root(spark)}/models-{uuid.uuid4().hex}"
    trees.publish(_stumps(rows), path, STUMP.name, 1)
    trees.publish(_stumps(rows.withColumn("demand_mw", F.col("demand_mw") + 1000)), path, STUMP.name, 2)
    newest = trees.champion(spark.read.parquet(path), ["respondent"])
    predicted = trees.walk_forward_predictions(rows, newest, ["respondent"], CALENDAR)
    return tidy(predicted.select("respondent", "period", "fold", "prediction"), 3)


TREE_PREDICTIONS = f"""WITH {_STUMPS}
SELECT s.respondent, s.period, s.fold, {r("1000 + base + CASE WHEN (CASE f WHEN 0 THEN isodow(s.period) - 1 ELSE month(s.period) END) <= threshold THEN low_value ELSE high_value END", 3)} AS prediction
FROM scored s JOIN stumps ON stumps.respondent = s.respondent AND stumps.k = s.fold WHERE s.demand_mw IS NOT NULL AND s.fold BETWEEN 0 AND 4"""


def training_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Ridge and two kinds of trees from the same rows to one table of results."""
    done = training.train(_rows(spark, d), ["respondent"], FEATURES, ["ridge", "hist_gb"])
    return tidy(done.leaderboard)


QUERIES = {
    "ridge_scores": (ridge_scores, None),
    "ridge_importance": (ridge_importance, None),
    "ridge_closed_form": (ridge_closed_form, RIDGE_CLOSED_FORM),
    "gbt_scores": (gbt_scores, None),
    "hist_gb_scores": (hist_gb_scores, None),
    "forest_scores": (forest_scores, None),
    "training_leaderboard": (training_leaderboard, None),
    "tree_stumps": (tree_stumps, TREE_STUMPS),
    "tree_predictions": (tree_predictions, TREE_PREDICTIONS),
}
