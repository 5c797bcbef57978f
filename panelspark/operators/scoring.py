"""Naive forecasts, error metrics and walk-forward scores for all series, models and folds in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.nulls import finite
from panelspark.session import small, stored

VALIDATION_FOLDS = (0, 1, 2, 3, 4)
OVERALL = "overall"

#: Names of the naive forecasts.
PERSISTENCE_1H, PERSISTENCE_24H = "Persistence-1h", "Persistence-24h"
SEASONAL_168H, OFFICIAL = "SeasonalNaive-168h", "EIA-Forecast"

BASELINES: dict[str, tuple[str, ...]] = {
    PERSISTENCE_1H: ("lag_1h",), PERSISTENCE_24H: ("lag_24h",), SEASONAL_168H: ("lag_168h",),
    OFFICIAL: ("eia_forecast_mw", "lag_168h"),
}


def baseline(df: DataFrame, name: str) -> Column:
    """Prediction column of a naive forecast; the first present value of its columns."""
    if name not in BASELINES:
        raise KeyError(f"unknown baseline {name}")
    missing = [c for c in BASELINES[name] if c not in df.columns]
    if missing:
        raise KeyError(f"{name} needs the columns {missing}")
    return F.coalesce(*BASELINES[name])


def _sums(y: Column, p: Column) -> list[Column]:
    ok = finite(y, p)
    error = F.abs(y - p)
    size = F.abs(y) + F.abs(p)
    present = y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p)
    usable = ok & (size > 0)
    return [
        F.count(F.when(present, 1)).alias("_rows"),
        F.count(F.when(ok, 1)).alias("_n"),
        F.sum(F.when(ok, error)).alias("_abs"),
        F.sum(F.when(ok, error * error)).alias("_sq"),
        F.count(F.when(usable, 1)).alias("_ns"),
        F.sum(F.when(usable, error * 200 / size)).alias("_s"),
    ]


_SUMS = ("_rows", "_n", "_abs", "_sq", "_ns", "_s")


def _metrics() -> list[Column]:
    """Metrics from the sums; NULL where no pair can be scored."""
    return [
        F.round(F.try_divide("_abs", "_n"), 2).alias("mae"),
        F.round(F.sqrt(F.try_divide("_sq", "_n")), 2).alias("rmse"),
        F.round(F.try_divide("_s", "_ns"), 3).alias("smape"),
        F.col("_rows").alias("n_rows"),
    ]


def score(df: DataFrame, keys: list[str], target: str, prediction: str) -> DataFrame:
    """mae, rmse, smape and n_rows per group. Metrics use finite pairs, n_rows counts present pairs."""
    sums = df.groupBy(*keys).agg(*_sums(F.col(target), F.col(prediction)))
    return sums.select(*keys, *_metrics())


def stack_predictions(df: DataFrame, keep: list[str], models: dict[str, Column]) -> DataFrame:
    """Long form: one row per (row, model) with its prediction."""
    pairs = [F.struct(F.lit(n).alias("model"), c.cast("double").alias("prediction")) for n, c in models.items()]
    return df.select(*keep, F.inline(F.array(*pairs)))


def walk_forward(long: DataFrame, keys: list[str], target: str = "demand_mw", fold: str = "fold",
                 model: str = "model", prediction: str = "prediction", rows: DataFrame | None = None) -> DataFrame:
    """One row per (keys, model, validation fold) and a pooled ``overall`` row.

    A fold counts only if the series has earlier rows to train on: rows of ``rows``, the input of the model, if it is given
    (a model may return no prediction where it could not be trained), else of ``long``. Fold 5 is never used. Rows are summed
    per fold first; everything after that works on at most seven rows per series and model.
    """
    group = [*keys, model]
    sums = long.groupBy(*group, fold).agg(*_sums(F.col(target), F.col(prediction)))
    if rows is None:
        started = sums.withColumn("_first", F.min(fold).over(Window.partitionBy(*group)))
    else:
        started = sums.join(small(rows.groupBy(*keys).agg(F.min(fold).alias("_first"))), keys)
    used = started.where(F.col(fold).isin(*VALIDATION_FOLDS) & (F.col("_first") < F.col(fold)))
    labels = F.explode(F.array(F.col(fold).cast("string"), F.lit(OVERALL)))
    pooled = used.withColumn("_label", labels).groupBy(*group, F.col("_label").alias("fold")).agg(
        *[F.sum(c).alias(c) for c in _SUMS]
    )
    return pooled.select(*group, "fold", *_metrics())


def compare(df: DataFrame, keys: list[str], models: dict[str, Column], target: str = "demand_mw",
            fold: str = "fold") -> DataFrame:
    """Walk-forward scores of several prediction columns in one pass over the data."""
    return walk_forward(stack_predictions(df, [*keys, target, fold], models), keys, target, fold)


def evaluate_model(df: DataFrame, keys: list[str], fit_predict: Callable[[DataFrame, DataFrame], DataFrame],
                   name: str, target: str = "demand_mw", fold: str = "fold") -> DataFrame:
    """Walk-forward scores of any model given as ``(train, validation) -> validation with prediction``."""
    df = stored(df)
    parts = []
    for k in VALIDATION_FOLDS:
        past = df.where(F.col(fold).between(-1, k - 1))
        scored = fit_predict(past, df.where(F.col(fold) == k))
        parts.append(scored.select(*keys, target, fold, "prediction"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return walk_forward(out.withColumn("model", F.lit(name)), keys, target, fold, rows=df)


def summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Overall rows ranked by RMSE, missing ones last; the name breaks ties."""
    w = Window.partitionBy(*keys).orderBy(F.col("rmse").asc_nulls_last(), "model")
    return scores.where(F.col("fold") == OVERALL).drop("fold").withColumn("rank", F.row_number().over(w))
