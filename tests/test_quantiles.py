import numpy as np
import pytest

from panelspark.functions import scaling
from panelspark.operators.quantiles import exact_medians, exact_quantiles

PROBS = {"q0": 0.0, "q05": 0.05, "q50": 0.5, "q95": 0.95, "q100": 1.0}


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_equals_numpy_with_narrow_brackets(spark, accuracy):
    """Low accuracy makes the groups large compared with the sketch, so brackets are really used."""
    rng = np.random.default_rng(7)
    groups = {"wide": rng.lognormal(0, 3, 6_000), "ties": rng.integers(0, 4, 5_000).astype(float),
              "one": np.array([3.0]), "two": np.array([1.0, 2.0]), "outlier": np.append(rng.normal(0, 1, 3_000), 1e300)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("wide", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", PROBS, count="n", accuracy=accuracy).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12)


def test_without_keys(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first().m == 5.0


def test_medians_and_scaling(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 4.0), ("a", 9.0, 6.0), ("b", None, 1.0)], "k string, x double, y double")
    got = {(r.k, r.feature): r.median for r in exact_medians(df, ["k"], ["x", "y"]).collect()}
    assert got == {("a", "x"): 2.0, ("a", "y"): 5.0, ("b", "y"): 1.0}
    filled = sorted(tuple(r) for r in scaling.impute_median(df, ["k"], ["y"]).where("k = 'a'").collect())
    assert [r[2] for r in filled] == [5.0, 4.0, 6.0]
    scaled = {r.x for r in scaling.robust_scale(df, ["k"], ["x"], limit=1.0).where("k = 'a'").collect()}
    assert scaled == {-0.25, 0.0, 1.0}


def test_standardise_round_trip(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("c", 7.0)], "k string, y double")
    out = scaling.standardise(df, ["k"], ["y"], keep_stats=True)
    assert {(r.k, r.y) for r in out.collect()} == {("a", -1.0), ("a", 1.0), ("c", 0.0)}
    back = scaling.unstandardise(out.withColumnRenamed("y", "prediction"), "prediction", "y")
    assert sorted(r.prediction for r in back.collect()) == [1.0, 3.0, 7.0]
