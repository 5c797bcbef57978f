"""The assembled matrix against pandas, series by series."""

import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.panel import Panel
from panelspark.plans import features
from panelspark.sources import tables

P = Panel(block=400)
START = datetime(2021, 6, 1)
HOURS = 1000


def _region(spark, series: dict, hours=HOURS):
    rows = []
    for (code, kind), values in series.items():
        rows += [(code, START + timedelta(hours=h), kind, None if v is None or np.isnan(v) else float(v), 0, 0) for h, v in enumerate(values[:hours])]
    return spark.createDataFrame(rows, "respondent string, period timestamp_ntz, type string, value_mwh double, is_imputed int, is_anomaly int")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    out = {}
    for code, base in (("A", 10_000), ("B", 5_000)):
        out[(code, "D")] = base + rng.normal(0, base / 20, HOURS)
        out[(code, "DF")] = out[(code, "D")] * 1.01
        out[(code, "NG")] = base * 0.9 + rng.normal(0, 100, HOURS)
        out[(code, "TI")] = rng.normal(0, 50, HOURS)
    out[("A", "D")][300] = -5
    out[("A", "D")][301] = 2_000_000
    out[("A", "D")][500] = 90_000
    out[("NODEMAND", "DF")] = np.ones(HOURS)
    return out


@pytest.fixture(scope="module")
def matrix(spark, data):
    rng = np.random.default_rng(6)
    hours = [START + timedelta(hours=h) for h in range(HOURS)]
    fuel = [("A", t, f, float(abs(b + rng.normal(0, 50)))) for f, b in (("WND", 2000), ("SUN", 1000), ("COL", 3000), ("NG", 4000), ("NUC", 500)) for t in hours]
    flow = [(t, "A", "B", float(rng.normal(0, 100))) for t in hours]
    weather = [(code, t, float(15 + 10 * np.sin(h / 24)), 10.0, 12.0, 100.0, 5.0, 0.0) for code in ("A", "B") for h, t in enumerate(hours)]
    t = features.Tables(
        _region(spark, data), spark.createDataFrame(fuel, "respondent string, period timestamp_ntz, fueltype string, value_mwh double"),
        spark.createDataFrame(flow, "period timestamp_ntz, fromba string, toba string, value_mwh double"),
        spark.createDataFrame(weather, "respondent string, period timestamp_ntz, temp_2m double, dewpoint_2m double, windspeed_10m double, solar_irradiance double, cloudcover double, precipitation double"),
        spark.createDataFrame([("A", "east", True), ("B", "east", True)], "respondent string, region string, enabled boolean"),
        spark.createDataFrame([("A", "B")], "respondent string, peer string"),
        spark.createDataFrame([("A", 40.0)], "respondent string, lat double"))
    df = features.cast_schema(features.feature_matrix(t, P))
    return df, df.toPandas(), pd.DataFrame(fuel, columns=["r", "t", "f", "v"]), pd.DataFrame(flow, columns=["t", "a", "b", "v"]), pd.DataFrame(weather)


def _close(got, want):
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=2e-5, atol=1e-4)


def test_rows_and_columns(matrix):
    df, pdf, *_ = matrix
    assert set(pdf.respondent) == {"A", "B"} and "NODEMAND" not in set(pdf.respondent)
    assert (pdf.respondent == "B").sum() == HOURS - 168 and (pdf.respondent == "A").sum() == HOURS - 168 - 3
    kinds = dict(df.dtypes)
    assert kinds["lag_24h"] == "float" and kinds["fold"] == "tinyint" and kinds["days_to_nearest_holiday"] == "smallint"
    assert len(df.columns) == 115 + 1  # the time is a column here
    assert (pdf.fold == 1).all() and not [c for c in df.columns if c.startswith("_")]


def test_demand_columns(matrix, data):
    _, pdf, *_ = matrix
    d = pd.Series(data[("A", "D")].copy())
    raw = d.copy()
    d[(d <= 0) | (d > 500_000)] = np.nan
    d[d > max(5 * np.percentile(d.dropna(), 95), 1000)] = np.nan
    assert np.isnan(d[500])
    got = pdf[pdf.respondent == "A"].sort_values("period").reset_index(drop=True)
    keep = (d.index >= 168) & d.notna()
    want = pd.DataFrame({
        "lag_24h": d.shift(24), "lag_336h": d.shift(336), "rolling_mean_24h": d.shift(24).rolling(24, min_periods=12).mean(),
        "rolling_std_168h": d.shift(24).rolling(168, min_periods=84).std(), "demand_momentum": d.shift(24) - 2 * d.shift(48) + d.shift(72),
    })[keep].reset_index(drop=True)
    for c in want.columns:
        _close(got[c], want[c])
    ng = pd.Series(data[("A", "NG")])
    _close(got.ng_rolling_mean_24h, ng.shift(24).rolling(24, min_periods=12).mean()[keep].reset_index(drop=True))
    _close(got.demand_minus_ng_lag24, (d.shift(24) - ng.shift(24))[keep].reset_index(drop=True))
    b = pdf[pdf.respondent == "B"].sort_values("period")
    _close(b.regional_demand_index, raw.shift(24)[168:])  # demand of the other region before cleaning


def test_supply_flow_and_weather_columns(matrix):
    _, pdf, fuel, flow, weather = matrix
    got = pdf[pdf.respondent == "A"].sort_values("period").set_index("period")
    wide = fuel.pivot(index="t", columns="f", values="v").shift(24)
    wide = wide.loc[got.index]
    four = wide[["WND", "SUN", "COL", "NG"]].sum(axis=1)
    _close(got.wind_pct, wide.WND / four)
    _close(got.nuclear_pct, wide.NUC / wide.sum(axis=1))
    assert np.allclose(got.wind_pct + got.solar_pct + got.coal_pct + got.ng_pct, 1, atol=1e-4)
    net = flow.set_index("t").v
    _close(got.interchange_net_lag24, net.shift(24).loc[got.index])
    _close(got.interchange_vol_24h, net.shift(24).rolling(24, min_periods=12).std().loc[got.index])
    lagged = net.shift(24)
    assert (got.is_import_stress == (lagged > lagged.quantile(0.9)).astype(int).loc[got.index]).all()
    temp = weather[weather[0] == "A"].set_index(1)[2]
    _close(got.temp_rolling_mean_48h, temp.rolling(48, min_periods=24).mean().loc[got.index])
    _close(got.temp_lag_168h, temp.shift(144).loc[got.index])
    w = np.exp(-np.arange(48) / 12)
    _close(got.temp_weighted_48h, temp.rolling(48).apply(lambda x: np.sum(x * (w / w.sum())), raw=True).loc[got.index])
    b = pdf[pdf.respondent == "B"]
    assert (b.wind_pct == 0).all() and (b.total_gen_mw_lag24 == 0).all() and (b.day_length_hours == 12).all()
    assert b.neighbor_demand_avg.isna().all() and got.neighbor_demand_avg.notna().all()
    july4 = got[(got.index >= pd.Timestamp(2021, 7, 4)) & (got.index < pd.Timestamp(2021, 7, 5))]
    assert len(july4) == 24 and (july4.is_us_holiday == 1).all()


def test_only_region_table(spark):
    m = features.feature_matrix(features.Tables(_region(spark, {("A", "D"): np.full(300, 5_000.0)}, 300)), P)
    pdf = m.toPandas()
    assert len(pdf) == 132 and pdf.temp_2m.isna().all() and pdf.grid_stress_index.isna().all() and (pdf.wind_pct == 0).all()
    assert len(m.columns) == 116
    report = features.column_report(m)
    assert report["n_features"] == len(features.feature_columns(m)) == 116 - 7


def test_spike_enters_one_day_later(spark):
    v = np.ones(400)
    v[200] = 99.0
    pdf = features.feature_matrix(features.Tables(_region(spark, {("A", "D"): v}, 400)), P).toPandas().sort_values("period").reset_index(drop=True)
    assert pdf.rolling_mean_24h[200 - 168] == 1.0 and pdf.rolling_mean_24h[223 - 168] == 1.0 and pdf.rolling_mean_24h[224 - 168] > 1.0


def test_written_and_read_back(spark, matrix, tmp_path):
    df, pdf, *_ = matrix
    path = str(tmp_path / "features")
    tables.write_features(df, path)
    one = tables.read_features(spark, path, ["B"])
    assert one.count() == (pdf.respondent == "B").sum()
    assert "PartitionFilters: [isnotnull" in one._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [respondent" in one._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_on_the_region_alone(spark, matrix):
    """The wide frame must not be dealt by a handful of region keys, also where Spark would not broadcast by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = matrix[0].select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Window" in plan and not re.findall(r"hashpartitioning\(respondent#\d+, \d+\)", plan)
