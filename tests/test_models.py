from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import scoring
from panelspark.plans import models, ridge

FEATURES = ["lag_24h", "lag_168h", "hour_sin", "gap"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    rows = []
    for code, scale in (("A", 1.0), ("B", 3.0)):
        y = scale * (10_000 + 500 * np.sin(2 * np.pi * np.arange(2_000) / 24) + rng.normal(0, 30, 2_000))
        for h in range(168, 2_000):
            fold = -1 + 7 * (h - 168) // (2_000 - 168)
            gap = None if rng.random() < 0.2 else float(rng.normal())
            rows.append((code, datetime(2022, 1, 1) + timedelta(hours=h), float(y[h]), float(y[h - 24]), float(y[h - 168]), float(np.sin(2 * np.pi * h / 24)), gap, int(fold)))
    df = spark.createDataFrame(rows, "respondent string, period timestamp_ntz, demand_mw double, lag_24h double, lag_168h double, hour_sin double, gap double, fold int")
    from panelspark.session import stored
    return stored(df)


def test_ridge_equals_closed_form(panel):
    model = ridge.fit(panel, ["respondent"], FEATURES)
    pdf = panel.toPandas()
    for r in model.where("k IN (0, 3, 5)").collect():
        t = pdf[(pdf.respondent == r.respondent) & (pdf.fold < r.k)]
        assert r.n_train == len(t)
        x = t[FEATURES].to_numpy(float)
        np.testing.assert_allclose(r.medians, np.nanmedian(x, axis=0), rtol=1e-12)
        x = np.where(np.isnan(x), r.medians, x)
        np.testing.assert_allclose(r.scales, np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0), rtol=1e-9)
        z = np.clip((x - r.medians) / r.scales, -5, 5)
        zc, y = z - z.mean(0), t.demand_mw.to_numpy()
        beta = np.linalg.solve(zc.T @ zc + np.eye(len(FEATURES)), zc.T @ (y - y.mean()))
        np.testing.assert_allclose(r.coefficients, beta, rtol=1e-6)
        assert r.intercept == pytest.approx(y.mean() - z.mean(0) @ beta)
        assert r.medians[0] == pytest.approx(t.lag_24h.median(), rel=1e-3)
    predicted = ridge.walk_forward_predictions(panel, model, ["respondent"], FEATURES)
    assert predicted.where("prediction IS NULL").count() == 0
    assert predicted.count() == panel.where("fold BETWEEN 0 AND 4").count()
    imp = ridge.importance(model, ["respondent"], FEATURES).first()
    assert sum(imp.feature_importance) == pytest.approx(1)


def test_ridge_with_scaling_joined_and_gaps_in_most_rows(spark, panel):
    """More than half of a column missing puts the median at the quartiles; the joined table gives the same models."""
    rare = panel.withColumn("rare", F.when(F.hour("period") % 3 == 0, F.col("gap")))
    names = [*FEATURES, "rare"]
    sent, joined = ({(r.respondent, r.k): r for r in ridge.fit(rare, ["respondent"], names, max_lookup=limit).collect()} for limit in (ridge.MAX_LOOKUP, 0))
    assert sent.keys() == joined.keys() and len(sent) == 12
    for key, r in sent.items():
        np.testing.assert_allclose(r.coefficients, joined[key].coefficients, rtol=1e-9)
        assert r.n_train == joined[key].n_train
    pdf = rare.toPandas()
    t = pdf[(pdf.respondent == "B") & (pdf.fold < 4)].rare
    filled = t.fillna(t.median())
    assert sent["B", 4].medians[-1] == pytest.approx(t.median(), rel=1e-12)
    assert sent["B", 4].scales[-1] == (filled.quantile(0.75) - filled.quantile(0.25) or 1.0)


def test_ridge_copies_no_rows(panel):
    model = ridge.fit(panel, ["respondent"], FEATURES)
    plan = model._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "MapInPandas" in plan


def test_ridge_ignores_a_feature_without_values(panel):
    model = ridge.fit(panel.withColumn("empty", F.lit(None).cast("double")), ["respondent"], [*FEATURES, "empty"])
    assert all(abs(r.coefficients[-1]) < 1e-9 for r in model.collect())


def test_pooled_ridge_matches_closed_form(panel):
    one = panel.where("respondent = 'A'")
    model, used = models.fit("ridge", one, ["lag_24h", "lag_168h", "hour_sin"])
    pdf = one.toPandas()
    x, y = pdf[used].to_numpy(float), pdf.demand_mw.to_numpy()
    scaler = next(s for s in model.stages if hasattr(s, "range"))
    z = np.clip((x - scaler.median.toArray()) / scaler.range.toArray(), -5, 5)
    zc = z - z.mean(0)
    beta = np.linalg.solve(zc.T @ zc + np.eye(3), zc.T @ (y - y.mean()))
    np.testing.assert_allclose(model.stages[-1].coefficients.toArray(), beta, rtol=1e-5)
    assert sum(v for _, v in models.importance(model, used)) == pytest.approx(1)


def test_trees_beat_persistence_and_survive_saving(panel, tmp_path):
    one = panel.where("respondent = 'A'")
    noisy = one.withColumn("lag_24h", F.col("lag_24h") + F.when(F.hour("period") % 2 == 0, 400.0).otherwise(-400.0))
    path = str(tmp_path / "model")
    model, used = models.fit("hist_gb", noisy.where("fold < 3"), FEATURES, maxIter=8, maxDepth=4, stepSize=0.3)
    valid = noisy.where("fold = 3")
    out = models.predict(model, valid, used)
    both = scoring.stack_predictions(out, ["demand_mw"], {"tree": F.col("prediction"), "p24": F.col("lag_24h")})
    got = {r.model: r.rmse for r in scoring.score(both, ["model"], "demand_mw", "prediction").collect()}
    assert got["tree"] < got["p24"]
    models.save(model, path)
    again = models.predict(models.load(path), valid, used)
    assert sorted(r.prediction for r in again.collect()) == sorted(r.prediction for r in out.collect())


def test_ridge_pipeline_survives_saving(panel, tmp_path):
    path = str(tmp_path / "ridge")
    model, used = models.fit("ridge", panel, FEATURES)
    models.save(model, path)
    a, b = models.predict(model, panel, used), models.predict(models.load(path), panel, used)
    assert a.agg(F.sum("prediction")).first()[0] == pytest.approx(b.agg(F.sum("prediction")).first()[0])


def test_registry_and_errors():
    assert {"ridge", "hist_gb", "xgboost", "lightgbm", "catboost", "random_forest"} <= set(models.MODELS)
    with pytest.raises(KeyError):
        models.builder("nothing")
    with pytest.raises(RuntimeError):
        models.save(None, "x")


def test_standard_preprocessing(panel):
    out = models.standard_preprocessing(["lag_24h", "gap"]).fit(panel).transform(panel)
    from pyspark.ml.stat import Summarizer
    s = out.select(Summarizer.mean(F.col("features")).alias("m"), Summarizer.std(F.col("features")).alias("s")).first()
    np.testing.assert_allclose(s.m.toArray(), 0, atol=1e-8)
    np.testing.assert_allclose(s.s.toArray(), 1, rtol=1e-6)
