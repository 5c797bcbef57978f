"""From the feature matrix to the leaderboard: every model of the registry for all regions and folds, scored beside the naive forecasts.

A model is a table of fitted models (``trees`` or ``ridge``), so one call trains all regions. Every family leaves the same columns: scores, the scores of the benchmarks
beside them, and the importance vector of the final refit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import scoring
from panelspark.plans import ridge, trees
from panelspark.plans.ridge import FINAL
from panelspark.session import materialize, stored

RIDGE = "Ridge"


@dataclass(frozen=True)
class Trained:
    """Results of ``train``; ``models`` holds the fitted models by the name of the model."""

    scores: DataFrame
    leaderboard: DataFrame
    models: dict[str, DataFrame]


def _fitted(df: DataFrame, keys: list[str], features: list[str], growth: trees.Growth | None, target: str, fold: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Models, predictions of the validation rows, and importances."""
    if growth is None:
        models = stored(ridge.fit(df, keys, features, target, fold))
        return models, ridge.walk_forward_predictions(df, models, keys, features, fold), ridge.importance(models, keys, features)
    models = stored(trees.fit(df, keys, features, growth, target, fold))
    return models, trees.walk_forward_predictions(df, models, keys, features, fold), trees.importance(models, keys, features)


def train(df: DataFrame, keys: list[str], features: list[str], names: list[str], target: str = "demand_mw", fold: str = "fold", benchmark: str = scoring.OFFICIAL,
          reference: str = scoring.PERSISTENCE_24H, save_to: str | None = None, version: int = 1, growths: dict[str, trees.Growth] | None = None) -> Trained:
    """Train, score and rank the models in ``names`` ("ridge" or a key of ``trees.VARIANTS``).

    ``leaderboard`` has a row for each (keys, model): overall metrics, the RMSE of both benchmarks in the same folds, the gap to the first in percent, and names and shares of the
    features of the final refit (k = 5). With ``save_to`` the final models are added to that table of models as ``version``. ``growths`` overrides parameters by name.
    """
    df = stored(df)
    naive = [n for n in (benchmark, reference) if set(scoring.BASELINES[n]) <= set(df.columns)]
    scores = scoring.compare(df, keys, {n: scoring.baseline(df, n) for n in naive}, target, fold) if naive else None
    models, shares = {}, None
    for name in names:
        growth = None if name == "ridge" else (growths or {}).get(name) or trees.variant(name)
        label = growth.name if growth else RIDGE
        models[label], predicted, weights = _fitted(df, keys, features, growth, target, fold)
        scored = scoring.walk_forward(predicted.withColumn("model", F.lit(label)), keys, target, fold, rows=df)
        scores = scored if scores is None else scores.unionByName(scored)
        last = weights.where(F.col("k") == FINAL).select(*keys, F.lit(label).alias("model"), "feature_names", "feature_importance")
        shares = last if shares is None else shares.unionByName(last)
        if save_to:
            final = models[label].where(F.col("k") == FINAL)
            trees.publish(final, f"{save_to}/{'ridge' if growth is None else 'trees'}", label, version)
    scores = materialize(scores)
    overall = scores.where(F.col("fold") == scoring.OVERALL).drop("fold")
    board = overall.where(F.col("model").isin(list(models)))
    for name, column in ((benchmark, "benchmark_rmse"), (reference, "reference_rmse")):
        rows = overall.where(F.col("model") == name).select(*keys, F.col("rmse").alias(column))
        board = board.join(rows, keys, "left")
    pct = F.try_divide((F.col("rmse") - F.col("benchmark_rmse")) * 100, F.col("benchmark_rmse"))
    board = board.withColumn("vs_benchmark_pct", F.round(pct, 2))
    return Trained(scores, board.join(shares, [*keys, "model"], "left") if shares is not None else board, models)
