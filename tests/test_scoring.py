import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelspark.operators import joins, scoring
from panelspark.panel import Panel
from panelspark.plans import audits, monitoring, reports


def _score(spark, pairs):
    df = spark.createDataFrame([("a", y, p) for y, p in pairs], "k string, y double, p double")
    return scoring.score(df, ["k"], "y", "p").first()


def test_metrics(spark):
    r = _score(spark, [(1.0, 2.0), (2.0, 4.0), (3.0, 7.0)])
    assert r.mae == round(7 / 3, 2) and r.n_rows == 3
    assert _score(spark, [(0.0, 3.0), (0.0, 4.0)]).rmse == round(math.sqrt(12.5), 2)
    both_zero = _score(spark, [(0.0, 0.0), (1.0, 3.0)])
    assert both_zero.smape == 100.0
    assert _score(spark, [(3.0, 1.0)]).smape == _score(spark, [(1.0, 3.0)]).smape
    odd = _score(spark, [(1.0, 2.0), (float("nan"), 1.0), (None, 1.0), (1.0, float("inf"))])
    assert (odd.mae, odd.n_rows) == (1.0, 2)
    assert _score(spark, [(None, 1.0)]).mae is None


def _rows(spark):
    rows = [("a", f, 10.0 * (f + 2), 10.0 * (f + 2) + d) for f in range(-1, 6) for d in (1.0, -3.0)]
    rows += [("late", f, 5.0, 5.0) for f in (2, 3)]
    return spark.createDataFrame(rows, "respondent string, fold int, demand_mw double, prediction double")


def test_walk_forward(spark):
    out = scoring.walk_forward(_rows(spark).withColumn("model", F.lit("m")), ["respondent"]).collect()
    got = {(r.respondent, r.fold): r for r in out}
    assert {f for k, f in got if k == "a"} == {"0", "1", "2", "3", "4", "overall"}
    assert got[("a", "overall")].n_rows == 10 and got[("a", "overall")].rmse == round(math.sqrt(5), 2)
    assert {f for k, f in got if k == "late"} == {"3", "overall"}  # its first fold has no past


def test_baselines(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 2.0, 9.0)], "lag_24h double, lag_168h double, eia_forecast_mw double")
    got = [tuple(r) for r in df.select(scoring.baseline(df, scoring.PERSISTENCE_24H), scoring.baseline(df, scoring.SEASONAL_168H), scoring.baseline(df, scoring.OFFICIAL)).collect()]
    assert got == [(1.0, 2.0, 2.0), (1.0, 2.0, 9.0)]
    with pytest.raises(KeyError):
        scoring.baseline(df, scoring.PERSISTENCE_1H)
    with pytest.raises(KeyError):
        scoring.baseline(df, "nothing")


def test_own_model(spark):
    out = scoring.evaluate_model(_rows(spark).drop("prediction"), ["respondent"],
                                 lambda train, valid: valid.crossJoin(train.agg(F.max("demand_mw").alias("prediction"))), "max")
    assert {r.fold for r in out.where("respondent = 'a'").collect()} == {"0", "1", "2", "3", "4", "overall"}


def _scores(spark):
    rows = [("A", "ref", "overall", 1.0, 10.0, 1.0, 5), ("A", "m", "overall", 1.0, 5.0, 2.0, 5), ("B", "ref", "overall", 3.0, 10.0, 1.0, 5),
            ("B", "m", "overall", 3.0, 600.0, 4.0, 5), ("A", "m", "0", 1.0, 7.0, 1.0, 5)]
    return spark.createDataFrame(rows, "respondent string, model string, fold string, mae double, rmse double, smape double, n_rows int")


def test_reports(spark):
    s = _scores(spark)
    v = reports.versus_benchmark(s, ["respondent"], "ref")
    assert {(r.respondent, r.vs_benchmark_pct, r.verdict) for r in v.collect()} == {("A", -50.0, "BEAT"), ("B", 5900.0, "below")}
    w = reports.win_rate(v).first()
    assert (w.wins, w.n, w.mean_rmse, w.median_vs_pct) == (1, 2, 302.5, 2925.0)
    assert tuple(reports.explosions(v, "respondent").first()) == ("m", 1, "B(60x)")
    assert {(r.respondent, r.m_rmse, r.m_exploded) for r in reports.score_pivot(v, "respondent", {"m": "m"}).collect()} == {("A", 5.0, 0), ("B", 600.0, 1)}
    assert [r.model for r in reports.aggregate_summary(s).collect()] == ["ref", "m"]
    assert [(r.respondent, r.model) for r in scoring.summary(s, ["respondent"]).where("rank = 1").orderBy("respondent").collect()] == [("A", "m"), ("B", "ref")]


def test_top_importance(spark):
    rows = [("m", ["x", "y"], [0.8, 0.2]), ("m", ["x", "y"], [0.6, 0.4]), ("m", ["x", "y"], [1.0]), ("z", ["x"], [0.0])]
    df = spark.createDataFrame(rows, "model string, feature_names array<string>, feature_importance array<double>")
    got = {(r.model, r.feature): r for r in reports.top_importance(df).collect()}
    assert got[("m", "x")].rank == 1 and got[("m", "x")].mean_importance == pytest.approx(0.7) and got[("m", "x")].std_importance == pytest.approx(0.1)
    assert got[("m", "x")].consistency == "***" and got[("m", "y")].consistency == "**" and got[("z", "x")].cv == 99.0


def test_audit_and_completeness(spark):
    t = datetime(2022, 1, 1)
    rows = [("ok", t + timedelta(hours=h), 100.0, 100.0) for h in range(800)] + [("bad", t + timedelta(hours=h), v, 0.0) for h, v in enumerate([-1.0, 0.0, 600_000.0, None])]
    df = spark.createDataFrame(rows, "respondent string, period timestamp_ntz, demand_mw double, eia_forecast_mw double")
    got = {r.respondent: (r.issues, r.verdict) for r in audits.quality_audit(df, "respondent").collect()}
    assert got["ok"] == ("", "OK") and got["bad"] == ("OVERFLOW|NEGATIVE|ZERO|EIA_ZERO|OUTLIER|HIGH_NaN", "ISSUE")
    codes = spark.createDataFrame([("ok",), ("bad",), ("none",)], "respondent string")
    c = {r.respondent: r.reason for r in audits.completeness(df, "respondent", "period", "2022-01-01 00:00:00", "2022-02-03 00:00:00", ("demand_mw",), codes).collect()}
    assert c == {"ok": "Valid", "bad": "End date too early", "none": "Empty dataframe"}


def test_monitoring(spark, hourly):
    df = hourly({"a": [10.0] * 20}, name="demand_mw").withColumn("prediction", F.when(F.hour("period") < 10, F.lit(11.0)).otherwise(F.lit(13.0)))
    train = spark.createDataFrame([("a", 1.0)], "respondent string, train_rmse double")
    out = monitoring.drift(df, Panel(block=64), train, steps=5).orderBy("period").collect()
    assert [r.alert for r in out[:10]] == [0] * 10 and out[10].alert == 1 and out[19].rolling_rmse == 3.0
    champ = spark.createDataFrame([("a", 100.0), ("b", 100.0)], "k string, rmse double")
    chall = spark.createDataFrame([("a", 98.0), ("b", 98.5), ("c", 1.0)], "k string, rmse double")
    assert {r.k: r.replace for r in monitoring.champion_choice(champ, chall, ["k"]).collect()} == {"a": 1, "b": 0, "c": 1}


def test_rebuild_and_horizon(hourly, spark):
    p = Panel(block=64)
    df = hourly({"a": range(30)}, name="lag_24h").withColumn("lag_24h", F.when(F.hour("period") != 3, F.col("lag_24h")))
    out = joins.target_rebuild(df, p, F.lit(-1.0)).orderBy("period").collect()
    assert out[0].y_rebuilt == 24.0 and out[3].y_rebuilt == -1.0 and out[10].y_rebuilt == 10.0
    t = datetime(2022, 1, 1)
    fc = spark.createDataFrame([("a", t, t - timedelta(hours=24), 5.0), ("a", t, t - timedelta(hours=24), 7.0), ("a", t, t - timedelta(hours=12), 99.0)],
                               "respondent string, ds timestamp_ntz, cutoff timestamp_ntz, yhat double")
    got = joins.horizon_pick(df, fc, p).orderBy("period").collect()
    assert got[0].prediction == 6.0 and got[1].prediction == 1.0
