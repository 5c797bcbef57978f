"""Trees against a slow version that looks at every row, and the two ways of training against each other."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.plans import training, trees
from panelspark.session import stored

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for code, scale in (("A", 1.0), ("B", -3.0)):
        for i in range(420):
            a, b = float(rng.integers(0, 9)), float(rng.normal())
            c = None if rng.random() < 0.3 else float(rng.integers(0, 4))
            y = scale * (a + 4 * (b > 0.3) + (6 if c is None else c)) + 0.1 * float(rng.normal())
            out.append((code, i, a, b, float("nan") if c is None and i % 2 else c, y, -1 + i // 60))
    return stored(spark.createDataFrame(out, "region string, i int, a double, b double, c double, y double, fold int"))


def slow_boost(x, y, growth):
    """Plain level-wise boosting over the rows; no sampling, no held-back rows."""
    cuts = [np.unique(np.sort(v := x[:, j][~np.isnan(x[:, j])])[np.maximum(np.ceil(np.arange(1, growth.bins) / growth.bins * len(v)).astype(int) - 1, 0)]) for j in range(x.shape[1])]
    margin = np.full(len(y), y.mean())
    for _ in range(growth.rounds):
        r, value = y - margin, np.zeros(len(y))

        def split(index, depth):
            score = lambda i: r[i].sum() ** 2 / (len(i) + growth.l2)
            best = (1e-12, None)
            if depth < growth.depth:
                for j in range(x.shape[1]):
                    v = x[index, j]
                    for cut in [*cuts[j], np.inf]:
                        for missing in ((False, True) if np.isnan(v).any() else (False,)):
                            left = np.where(np.isnan(v), missing, v <= cut)
                            a, b = index[left], index[~left]
                            if len(a) >= growth.least and len(b) >= growth.least and (g := score(a) + score(b) - score(index)) > best[0] + 1e-9:
                                best = (g, (a, b))
            if best[1] is None:
                value[index] = growth.rate * r[index].sum() / (len(index) + growth.l2)
            else:
                for part in best[1]:
                    split(part, depth + 1)

        split(np.arange(len(y)), 0)
        margin = margin + value
    return margin


def test_equals_slow_boosting(rows):
    growth = trees.variant("xgboost", rounds=4, depth=3, rows=1.0, columns=1.0, bins=16, rate=0.4)
    models = trees.fit(rows, ["region"], FEATURES, growth, target="y")
    pdf = rows.toPandas()
    for code in "AB":
        for k in (0, 5):
            part = pdf[(pdf.region == code) & (pdf.fold < k)].sort_values("i")
            want = slow_boost(part[FEATURES].to_numpy(float), part.y.to_numpy(), growth)
            model = models.where((F.col("region") == code) & (F.col("k") == k)).drop("k")
            sample = rows.where((F.col("region") == code) & (F.col("fold") < k))
            got = trees.predict(sample, model, ["region"], FEATURES).toPandas().sort_values("i")
            np.testing.assert_allclose(got.prediction.to_numpy(), want, rtol=1e-9)


@pytest.mark.parametrize("key", ["hist_gb", "xgboost", "lightgbm", "catboost", "random_forest"])
def test_large_models_equal_small_ones(rows, key):
    growth = trees.variant(key, rounds=5, bins=8, patience=2 if key == "hist_gb" else None, depth=4)
    small = trees.fit(rows.where("region = 'A'"), ["region"], FEATURES, growth, target="y")
    # of six models the two with the most rows are trained level by level
    large = trees.fit(rows.where("region = 'A'"), ["region"], FEATURES, growth, target="y", task_rows=250)
    a = {r.k: r for r in small.collect()}
    b = {r.k: r for r in large.collect()}
    assert set(a) == set(b) == set(range(6))
    for k in a:
        assert a[k].node_feature == b[k].node_feature and a[k].child == b[k].child and a[k].n_train == b[k].n_train
        np.testing.assert_allclose(a[k].value, b[k].value, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(a[k].importance, b[k].importance, rtol=1e-6, atol=1e-9)


def test_same_trees_on_any_partitioning(rows):
    growth = trees.variant("random_forest", rounds=6)
    one, many = (trees.fit(rows.repartition(n, "i"), ["region"], FEATURES, growth, target="y") for n in (1, 7))
    order = ["region", "k"]
    assert [tuple(r) for r in one.orderBy(*order).collect()] == [tuple(r) for r in many.orderBy(*order).collect()]


def test_broadcast_and_grouped_prediction_agree(rows):
    models = stored(trees.fit(rows, ["region"], FEATURES, trees.variant("lightgbm", rounds=10), target="y"))
    named = rows.withColumn("base", F.lit("b")).withColumn("a b", F.lit(1))
    few = trees.walk_forward_predictions(named, models, ["region"], FEATURES)
    many = trees.predict(named.where("fold BETWEEN 0 AND 4").withColumn("k", F.col("fold")), models, ["region", "k"], FEATURES, broadcast_bytes=0)
    a = {(r.region, r.i): r.prediction for r in few.collect()}
    b = {(r.region, r.i): r.prediction for r in many.collect()}
    assert few.columns == [*named.columns, "prediction"] and len(a) == named.where("fold BETWEEN 0 AND 4").count()
    assert set(a) == set(b) and all(a[i] == pytest.approx(b[i], rel=1e-12) for i in a)


def test_boosting_stops_early_and_learns(rows):
    growth = trees.variant("hist_gb", rate=0.3, least=5)
    models = stored(trees.fit(rows, ["region"], FEATURES, growth, target="y"))
    grown = [r.n_trees for r in models.collect()]
    assert min(grown) >= 1 and any(n < 300 for n in grown)
    got = trees.walk_forward_predictions(rows, models, ["region"], FEATURES)
    error, spread = got.agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)), F.var_pop("y")).first()
    assert error < 0.05 * spread
    shares = trees.importance(models, ["region"], FEATURES).first()
    assert sum(shares.feature_importance) == pytest.approx(1) and len(shares.feature_importance) == 3


def test_missing_and_constant_features(spark):
    data = [("A", i, None, 1.0, float(i % 2), float(i % 2) * 10, -1 + i // 20) for i in range(120)] + [("B", 0, None, None, None, 3.0, -1), ("C", 0, 1.0, 1.0, 1.0, None, -1)]
    frame = spark.createDataFrame(data, "region string, i int, a double, b double, c double, y double, fold int")
    models = stored(trees.fit(frame, ["region"], FEATURES, trees.variant("xgboost", rounds=30, rate=0.3), target="y"))
    assert {(r.region, r.k) for r in models.collect()} == {("A", k) for k in range(6)} | {("B", k) for k in range(6)}
    got = trees.walk_forward_predictions(frame, models, ["region"], FEATURES)
    assert all(abs(r.prediction - r.y) < 0.5 for r in got.collect())
    empty = trees.fit(frame.where("region = 'C'"), ["region"], FEATURES, trees.VARIANTS["xgboost"], target="y")
    assert empty.count() == 0


def test_published_models(rows, tmp_path):
    path = str(tmp_path / "models")
    growth = trees.variant("xgboost", rounds=2)
    first = trees.fit(rows, ["region"], FEATURES, growth, target="y")
    trees.publish(first, path, "XGBoost", 1)
    trees.publish(trees.fit(rows.where("region = 'A'"), ["region"], FEATURES, replace(growth, rounds=3), target="y"), path, "XGBoost", 2)
    best = trees.champion(rows.sparkSession.read.parquet(path), ["region"]).where("k = 5")
    assert {(r.region, r.version, r.n_trees) for r in best.collect()} == {("A", 2, 3), ("B", 1, 2)}
    assert trees.predict(rows, best, ["region"], FEATURES).count() == rows.count()
    with pytest.raises(KeyError):
        trees.variant("nothing")


def test_training_plan(rows, tmp_path):
    named = rows.withColumnRenamed("y", "demand_mw").withColumns({"lag_24h": F.col("a") * 2, "eia_forecast_mw": F.col("demand_mw") + 0.01, "lag_168h": F.col("a")})
    path = str(tmp_path / "zoo")
    growths = {"lightgbm": trees.variant("lightgbm", rounds=15, rate=0.3, least=5)}
    done = training.train(named, ["region"], FEATURES, ["ridge", "lightgbm"], save_to=path, growths=growths)
    board = {(r.region, r.model): r for r in done.leaderboard.collect()}
    assert set(board) == {(c, m) for c in "AB" for m in ("Ridge", "LightGBM")}
    scores = {(r.region, r.model, r.fold): r.rmse for r in done.scores.collect()}
    for (code, model), r in board.items():
        assert r.rmse == scores[code, model, "overall"] and r.benchmark_rmse == scores[code, "EIA-Forecast", "overall"] == 0.01
        assert r.reference_rmse == scores[code, "Persistence-24h", "overall"] and r.vs_benchmark_pct == pytest.approx((r.rmse - 0.01) / 0.01 * 100)
        assert r.feature_names == FEATURES and sum(r.feature_importance) == pytest.approx(1)
    assert board["A", "LightGBM"].rmse < board["A", "Ridge"].rmse
    kept = rows.sparkSession.read.parquet(f"{path}/trees")
    assert {(r.region, r.k, r.model, r.version) for r in kept.collect()} == {("A", 5, "LightGBM", 1), ("B", 5, "LightGBM", 1)}
