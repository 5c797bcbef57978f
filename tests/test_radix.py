import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import scaling
from panelspark.operators.quantiles import exact_medians
from panelspark.operators.radix import order_code, order_statistics, radix_quantiles

PROBS = {"q0": 0.0, "q05": 0.05, "q50": 0.5, "q95": 0.95, "q100": 1.0}


def test_equals_numpy(spark):
    rng = np.random.default_rng(7)
    groups = {"wide": rng.lognormal(0, 3, 6_000), "ties": rng.integers(0, 4, 5_000).astype(float),
              "one": np.array([3.0]), "two": np.array([1.0, 2.0]), "outlier": np.append(rng.normal(0, 1, 3_000), 1e300),
              "close": 1 + rng.integers(0, 5_000, 4_000) * 2.0 ** -52, "tiny": rng.integers(-3_000, 3_000, 4_000) * 5e-324}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("wide", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in radix_quantiles(df, ["k"], "v", PROBS, count="n").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=0)


def test_codes_are_the_bits_of_doubles_in_order(spark):
    rng = np.random.default_rng(3)
    powers = 2.0 ** np.arange(-1074, 1024)
    finite = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), np.abs(rng.integers(0, 2 ** 63, 5_000).view(float))])
    values = np.unique(np.concatenate([-finite[np.isfinite(finite)], finite[np.isfinite(finite)], [0.0, np.inf, -np.inf]]))
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", order_code(F.col("v")).alias("c"))
    for v, c in df.collect():
        bits = int(np.float64(abs(v)).view(np.int64))
        assert c == (-bits if v < 0 else bits)
    odd = spark.createDataFrame([(float("nan"),), (-0.0,), (None,)], "v double").select(order_code(F.col("v"))).collect()
    assert [r[0] for r in odd] == [(2047 << 52) + 1, 0, None]


def test_one_value_repeated_a_million_times(spark):
    df = spark.range(1_000_000, numPartitions=8).select(F.lit(-0.0).alias("v")).union(spark.createDataFrame([(-7.5,), (2.0,)], "v double"))
    got = radix_quantiles(df, [], "v", PROBS, count="n").first()
    assert tuple(got) == (-7.5, 0.0, 0.0, 0.0, 2.0, 1_000_002)


def test_nested_sets_in_one_pass(spark):
    rng = np.random.default_rng(5)
    part, v = rng.integers(0, 4, 3_000), rng.normal(0, 1, 3_000).round(2)
    gone = rng.random(3_000) < 0.1
    df = spark.createDataFrame([("a", int(p), None if g else float(x)) for p, x, g in zip(part, v, gone)], "key string, part int, v double")
    sets = [F.col("part") < k for k in range(5)]
    rows = order_statistics(df, ["key"], "v", lambda n, m: [F.lit(0), n - 1, m, n], sets).collect()
    got = {(r._k, r._i): (r._n, r._m, r._x) for r in rows}
    want = {}
    for k in range(1, 5):
        have, m = np.sort(v[(part < k) & ~gone]), int(((part < k) & gone).sum())
        want |= {(k, i): (len(have), m, have[rank]) for i, rank in enumerate((0, len(have) - 1, m))}
    assert got == want


def test_without_keys(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert radix_quantiles(df, [], "v", {"m": 0.5}).first().m == 5.0


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
