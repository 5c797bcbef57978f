"""Model registry of Spark ML pipelines and their walk-forward training.

Boosted trees of different libraries are all mapped to Spark's gradient-boosted trees with their parameters;
Spark's trees have no handling of missing values, so medians are filled in first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import Imputer, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.nulls import finite, nan_to_null
from panelspark.functions.scaling import CLIP
from panelspark.operators.scoring import VALIDATION_FOLDS
from panelspark.session import stored

SEED = 42

# Parameters of the boosted-tree variants.
BOOSTED = {
    "hist_gb": {"name": "HistGB", "maxIter": 300, "stepSize": 0.05, "maxDepth": 6},
    "xgboost": {"name": "XGBoost", "maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8,
                "featureSubsetStrategy": "0.8"},
    "lightgbm": {"name": "LightGBM", "maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8,
                 "featureSubsetStrategy": "0.8"},
    "lightgbm_gpu": {"name": "LightGBM-GPU", "maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8,
                     "featureSubsetStrategy": "0.8"},
    "catboost": {"name": "CatBoost", "maxIter": 500, "stepSize": 0.05, "maxDepth": 6},
}


class ClipVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Limit every entry of a vector to [-5, 5]."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        values = vector_to_array(F.col(self.getInputCol()))
        limited = F.transform(values, lambda x: F.greatest(F.least(x, F.lit(CLIP)), F.lit(-CLIP)))
        return df.withColumn(self.getOutputCol(), array_to_vector(limited))


def _filled(features: list[str]) -> tuple[list, list[str]]:
    filled = [f"{c}__filled" for c in features]
    imputer = Imputer(inputCols=features, outputCols=filled, strategy="median")
    return [imputer, VectorAssembler(inputCols=filled, outputCol="raw_features")], filled


def standard_preprocessing(features: list[str]) -> Pipeline:
    """Median fill, then mean 0 and deviation 1: the input of neural models."""
    stages, _ = _filled(features)
    return Pipeline(stages=[*stages, StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)])


def ridge(train: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> Pipeline:
    """Pooled ridge. Spark scales the penalty by n and the deviation of the target, which is undone here."""
    n, sd = train.agg(F.count(target), F.stddev_pop(target)).first()
    stages, _ = _filled(features)
    scaler = RobustScaler(inputCol="raw_features", outputCol="scaled", withCentering=True, withScaling=True)
    fit = LinearRegression(featuresCol="features", labelCol=target, elasticNetParam=0.0, standardization=False,
                           solver="normal", regParam=alpha * (sd or 0.0) / max(n, 1))
    return Pipeline(stages=[*stages, scaler, ClipVector(inputCol="scaled", outputCol="features"), fit])


def boosted(train: DataFrame, features: list[str], target: str, **params) -> Pipeline:
    params.pop("name", None)
    stages, _ = _filled(features)
    fit = GBTRegressor(featuresCol="raw_features", labelCol=target, seed=SEED, **params)
    return Pipeline(stages=[*stages, fit])


def random_forest(train: DataFrame, features: list[str], target: str, numTrees: int = 200, maxDepth: int = 20,
                  minInstancesPerNode: int = 5, **params) -> Pipeline:
    stages, _ = _filled(features)
    fit = RandomForestRegressor(featuresCol="raw_features", labelCol=target, seed=SEED, numTrees=numTrees,
                                maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode, **params)
    return Pipeline(stages=[*stages, fit])


Builder = Callable[..., Pipeline]
MODELS: dict[str, Builder] = {"ridge": ridge, "random_forest": random_forest}
for _key, _params in BOOSTED.items():
    MODELS[_key] = lambda train, features, target, _p=_params, **kw: boosted(train, features, target, **{**_p, **kw})


def builder(key: str) -> Builder:
    if key not in MODELS:
        raise KeyError(f"unknown model {key}; known: {sorted(MODELS)}")
    return MODELS[key]


def clean_input(df: DataFrame, features: list[str], target: str) -> DataFrame:
    values = {c: nan_to_null(F.col(c).cast("double")) for c in (*features, target)}
    return df.withColumns(values)


def fit(key: str, train: DataFrame, features: list[str], target: str = "demand_mw", **params) -> tuple[PipelineModel, list[str]]:
    """Fit on rows with a target. Features without any value in the training rows are left out."""
    train = clean_input(train, features, target).where(finite(F.col(target)))
    present = train.agg(*[F.count(c).alias(c) for c in features]).first()
    used = [c for c in features if present[c]]
    return builder(key)(train, used, target, **params).fit(train), used


def predict(model: PipelineModel, df: DataFrame, features: list[str], target: str = "demand_mw") -> DataFrame:
    """``df`` with a ``prediction`` column."""
    out = model.transform(clean_input(df, features, target))
    return out.select(*df.columns, F.col("prediction").cast("double").alias("prediction"))


def walk_forward_predictions(df: DataFrame, key: str, features: list[str], target: str = "demand_mw",
                             fold: str = "fold", save_to: str | None = None, **params) -> DataFrame:
    """A fresh model per fold on all earlier folds; with ``save_to`` also a final refit on folds -1 to 4.

    Training is pooled over all regions and distributed by Spark. To train one model per region pass the
    rows of that region (``read_features(..., codes)``), or use ``plans.ridge``.
    """
    df = stored(df)
    parts = []
    for k in VALIDATION_FOLDS:
        train, valid = df.where(F.col(fold).between(-1, k - 1)), df.where(F.col(fold) == k)
        if train.limit(1).count() == 0 or valid.limit(1).count() == 0:
            continue
        model, _ = fit(key, train, features, target, **params)
        parts.append(predict(model, valid, features, target))
    if not parts:
        raise ValueError("no fold has both training and validation rows")
    if save_to:
        final, _ = fit(key, df.where(F.col(fold).between(-1, max(VALIDATION_FOLDS))), features, target, **params)
        save(final, save_to)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def save(model: PipelineModel | None, path: str) -> None:
    if model is None:
        raise RuntimeError("the model is not fitted")
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Normalised importance of the fitted features (p numbers, as the fitted model holds them)."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        raw = [float(x) for x in last.featureImportances.toArray()]
    else:
        scale = next(s for s in model.stages if hasattr(s, "range")).range.toArray()
        raw = [abs(float(b) * float(s)) for b, s in zip(last.coefficients.toArray(), scale)]
    total = sum(raw)
    return [(c, v / total if total > 0 else v) for c, v in zip(features, raw)]
