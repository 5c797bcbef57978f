import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import calendar, forecast_error, fuel, holidays, weather
from panelspark.functions.nulls import clip, finite, flag, row_sum, share
from panelspark.operators import flows, spatial
from panelspark.operators.blocks import over_blocks
from panelspark.panel import DAY, Panel


def _one(spark, cols: dict, **exprs):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} double" for c in cols))
    return df.select(*[e.alias(n) for n, e in exprs.items()]).first()


def test_missing_stays_missing(spark):
    x = F.col("x")
    row = _one(spark, {"x": None}, clip=clip(x, 0, 5), hdd=weather.thermal(x)["hdd"], flag=flag(x > 1),
               share=share(x, F.lit(3.0)), sum=row_sum(x, x), ok=finite(x))
    assert (row.clip, row.hdd, row.flag, row.share, row.sum, row.ok) == (None, None, 0, 0.0, 0.0, False)


def test_weather_formulas(spark):
    t, d, v = F.col("t"), F.col("d"), F.col("v")
    row = _one(spark, {"t": 30.0, "d": 20.0, "v": 25.0}, rh=weather.humidity(t, d), hi=weather.apparent(t, F.lit(60.0)),
               thi=weather.heat_humidity_index(t, F.lit(50.0)), wc=weather.wind_chill(t, v), **weather.thermal(t))
    assert row.rh == 100.0
    right = _one(spark, {"t": 30.0, "d": 20.0}, rh=weather.humidity(t, d, corrected=True)).rh
    assert right == pytest.approx(100 * math.exp(17.271 * 20 / 257.7 - 17.271 * 30 / 267.7))
    assert row.thi == pytest.approx((86 - 0.55 * 0.5 * 28 - 32) * 5 / 9)
    assert row.wc == 30.0 and row.hdd == 0.0 and row.cdd == pytest.approx(11.7) and row.cdd_sq == pytest.approx(11.7 ** 2)
    cold = _one(spark, {"t": -5.0, "v": 20.0}, wc=weather.wind_chill(t, v), ap=weather.apparent(t, F.lit(50.0)))
    assert cold.wc == pytest.approx(13.12 + 0.6215 * -5 - 11.37 * 20 ** 0.16 + 0.3965 * -5 * 20 ** 0.16)
    assert cold.ap == -5.0


def test_weighted_window(hourly):
    w = np.array(weather.thermal_weights())
    assert w.sum() == pytest.approx(1) and w[-1] == pytest.approx(0.0016214, abs=1e-7) and w[0] == pytest.approx(0.0814473, abs=1e-7)
    rng = np.random.default_rng(2)
    values = [float(x) for x in rng.normal(10, 5, 200)]
    values[120] = None
    out = over_blocks(hourly({"a": values}, name="temp_2m"), Panel(block=50), weather.temp_weighted()).orderBy("period").collect()
    for i, r in enumerate(out):
        window = values[max(0, i - 47): i + 1]
        if sum(v is not None for v in window) < 24 or None in window:
            assert r.temp_weighted_48h is None
        else:
            assert r.temp_weighted_48h == pytest.approx(float(np.dot(window, w[-len(window):])))


def test_sun_geometry(spark):
    df = spark.createDataFrame([(40.0, datetime(2022, 6, 21)), (None, datetime(2022, 6, 21)), (89.0, datetime(2022, 6, 21))], "lat double, t timestamp_ntz")
    got = df.select(*[c.alias(n) for n, c in weather.sun_geometry(F.col("lat"), F.col("t")).items()]).collect()
    dec = 23.45 * math.sin(math.radians(360 * (284 + 172) / 365))
    assert got[0].day_length_hours == pytest.approx(2 * math.degrees(math.acos(-math.tan(math.radians(40)) * math.tan(math.radians(dec)))) / 15)
    assert got[0].solar_elevation_noon == pytest.approx(90 - (40 - dec))
    assert tuple(got[1]) == (12.0, 45.0) and got[2].day_length_hours == 24.0


def test_calendar(spark):
    df = spark.createDataFrame([(datetime(2021, 7, 4, 13),), (datetime(2020, 12, 31, 1),), (datetime(2020, 12, 31),), (datetime(2024, 2, 28),)], "t timestamp_ntz")
    t = F.col("t")
    rows = df.select(*[c.alias(n) for n, c in {**calendar.basic(t), **calendar.month_position(t), **calendar.fourier(t), "p": calendar.in_period(t),
                                               "d": calendar.on_dates(t, ("2020-12-31",))}.items()]).collect()
    assert (rows[0].hour_of_day, rows[0].day_of_week, rows[0].is_weekend, rows[0].quarter) == (13, 6, 1, 3)
    assert rows[0].sin_hour_1 == pytest.approx(math.sin(2 * math.pi * 13 / 24)) and abs(rows[0].cos_week_3) <= 1
    assert [r.p for r in rows] == [0, 0, 1, 0] and [r.d for r in rows] == [0, 1, 1, 0]
    assert rows[3].days_to_month_end == 1 and rows[1].week_of_year == 53


def test_holidays(spark):
    years = spark.createDataFrame([(2021,), (2022,)], "year int")
    got = {r.holiday_date: r.holiday_name for r in holidays.holiday_dates(years).collect()}
    assert got[date(2021, 7, 4)] == "Independence Day" and got[date(2021, 7, 5)] == "Independence Day (observed)"
    assert got[date(2021, 11, 25)] == "Thanksgiving Day" and got[date(2021, 5, 31)] == "Memorial Day"
    assert got[date(2021, 12, 31)] == "New Year's Day (observed)" and got[date(2022, 6, 20)].startswith("Juneteenth")
    assert got[date(2022, 9, 5)] == "Labor Day" and got[date(2022, 1, 17)] == "Martin Luther King Jr. Day"
    assert date(2023, 1, 2) not in got
    old = spark.createDataFrame([(2020,)], "year int")
    assert not any("Juneteenth" in r.holiday_name for r in holidays.holiday_dates(old).collect())


def test_holiday_distances_equal_brute_force(spark):
    years = spark.createDataFrame([(2021,), (2022,)], "year int")
    periods = holidays.holiday_periods(holidays.holiday_dates(years)).collect()
    periods.sort(key=lambda p: p.holiday_date)
    got = {r.date: r for r in holidays.holiday_calendar(years).collect()}
    day = date(2021, 1, 1)
    while day <= date(2022, 12, 31):
        near, into, inside = 365, 0, 0
        for p in periods:
            if p.start_date <= day <= p.end_date:
                inside, into = 1, (day - p.start_date).days
            elif day < p.start_date:
                near = min(near, (p.start_date - day).days)
            else:
                near = min(near, (day - p.end_date).days)
        r = got[day]
        assert (r.days_to_nearest_holiday, r.is_in_holiday_period, r.days_into_holiday_period) == (near, inside, into), day
        day += timedelta(days=1)


def test_holidays_use_only_the_years_of_each_series(spark):
    df = spark.createDataFrame([("a", datetime(2022, 12, 30)), ("b", datetime(2022, 12, 30)), ("b", datetime(2023, 1, 5))], "respondent string, period timestamp_ntz")
    out = {(r.respondent, r.period): r.days_to_nearest_holiday for r in holidays.add_holidays(df, "period", ("respondent",)).collect()}
    assert out[("a", datetime(2022, 12, 30))] == 2  # the period of the observed Christmas Day ends on the 28th
    assert out[("b", datetime(2022, 12, 30))] == 1  # the period of New Year's Day 2023 starts on the 31st


def test_fuel_shares(spark):
    rows = [("full", 10.0, 20.0, 30.0, 40.0, -5.0, 100.0), ("none", None, None, None, None, None, 100.0), ("zero", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("big", 1e3, 0.0, 0.0, 0.0, 0.0, 1.0)]
    fuels = ("WND", "SUN", "COL", "NG", "NUC")
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"fuel_{f} double" for f in fuels) + ", lag_24h double")
    got = {r.k: r for r in df.withColumns(fuel.mix(fuels)).collect()}
    full = got["full"]
    assert full.wind_pct + full.solar_pct + full.coal_pct + full.ng_pct == pytest.approx(1)
    assert full.nuclear_pct == pytest.approx(-0.05) and full.renewable_pct == pytest.approx(0.3) and full.gen_demand_ratio_lag24 == pytest.approx(1.0)
    for k in ("none", "zero"):
        assert (got[k].wind_pct, got[k].renewable_pct, got[k].total_gen_mw_lag24, got[k].gen_demand_ratio_lag24) == (0.0, 0.0, None, None)
    assert got["big"].gen_demand_ratio_lag24 == 5.0
    nothing = df.withColumns(fuel.mix(fuels, has_fuel=F.lit(False))).first()
    assert nothing.total_gen_mw_lag24 == 0.0 and nothing.gen_demand_ratio_lag24 == 0.0


def test_net_flow(spark):
    t = datetime(2022, 1, 1)
    df = spark.createDataFrame([(t, "A", "B", 5.0), (t, "B", "A", 2.0), (t, "C", "A", None)], "period timestamp_ntz, fromba string, toba string, value double")
    got = {r.respondent: (r.exports, r.imports, r.net_interchange) for r in flows.net_interchange(df).collect()}
    assert got == {"A": (5.0, 2.0, 3.0), "B": (2.0, 5.0, -3.0), "C": (0.0, 0.0, 0.0)}


def test_regional_and_neighbours(spark, hourly):
    p = Panel(block=64)
    df = hourly({"A": [1.0] * 30, "B": [2.0] * 30, "C": [None] * 30, "T": [9.0] * 30, "U": [9.0] * 30, "S": [4.0] * 30}, name="demand_mw")
    members = spark.createDataFrame([("A", "east", True), ("B", "east", True), ("C", "east", True), ("D", "east", False), ("T", "texas", True), ("U", "texas", True), ("S", "solo", True)],
                                    "respondent string, region string, enabled boolean")
    out = spatial.regional_demand(df, members, p)
    got = {(r.respondent, r.period.day): (r.regional_demand_index, r.regional_demand_per_ba) for r in out.collect()}
    assert got[("A", 1)] == (0.0, 0.0) and got[("A", 2)] == (2.0, 1.0) and got[("C", 2)] == (3.0, 1.5)
    assert got[("T", 2)] == (None, None) and got[("S", 2)] == (None, None)
    edges = spark.createDataFrame([("A", "B"), ("A", "T"), ("C", "A")], "respondent string, peer string")
    near = {(r.respondent, r.period.hour): r for r in spatial.neighbour_demand(df, edges, p).where("day(period) = 2").collect()}
    assert (near[("A", 0)].neighbor_demand_avg, near[("A", 0)].neighbor_demand_max, near[("A", 0)].neighbor_demand_min) == (5.5, 9.0, 2.0)


def test_stress(spark, hourly):
    p = Panel(block=64)
    df = hourly({"a": list(range(11)) + [None]}, name="interchange_net_lag24")
    out = {r.interchange_net_lag24: (r.is_import_stress, r.is_export_stress) for r in spatial.stress_flags(df, p).collect()}
    assert out[10.0] == (1, 0) and out[0.0] == (0, 1) and out[5.0] == (0, 0) and out[None] == (0, 0) and out[9.0] == (0, 0)
    rows = spark.createDataFrame([("a", 2.0, None), ("a", 4.0, None), ("b", 2.0, 5.0), ("b", None, 10.0), ("c", None, None)],
                                 "respondent string, regional_demand_index double, neighbor_demand_avg double")
    got = sorted(((r.respondent, r.grid_stress_index) for r in spatial.grid_stress(rows, p).collect()), key=str)
    assert got == [("a", 0.5), ("a", 1.0), ("b", 0.75), ("b", None), ("c", None)]


def test_error_history_alignment(hourly, spark):
    p = Panel(block=400)
    d = hourly({"a": [float(i) for i in range(200)]}, name="demand_mw").withColumn("eia_forecast_mw", F.col("demand_mw") + 3)
    coded = forecast_error.add_error_history(d, p).orderBy("period").collect()
    aligned = forecast_error.add_error_history(d, p, align=True).orderBy("period").collect()
    assert coded[100].eia_error_48h == 27.0 and coded[100].eia_error_72h == 27.0 and coded[47].eia_error_48h is None
    assert aligned[100].eia_error_48h == 3.0 and aligned[100].eia_bias_24h == 3.0
    assert coded[100].eia_forecast_change_24h == 24.0 and coded[100].eia_forecast_accel == 0.0


def test_bias_by_hour_counts_days(spark):
    start = datetime(2022, 1, 1)
    rows = [("a", start + timedelta(hours=h), float(h // 24), h % 24) for h in range(24 * 40)]
    df = spark.createDataFrame(rows, "respondent string, period timestamp_ntz, eia_error_48h double, hour_of_day int")
    out = forecast_error.bias_by_hour(df, Panel(block=16), rows=10, need=5)
    got = {(r.period.hour, (r.period - start).days): r.eia_bias_by_hour for r in out.collect()}
    assert got[(7, 3)] is None and got[(7, 4)] == 2.0 and got[(7, 39)] == pytest.approx(np.mean(range(30, 40)))


def test_shift_by_days(spark):
    df = spark.createDataFrame([(datetime(2022, 1, 31),)], "period timestamp_ntz")
    assert df.select(Panel(step=DAY).shift(24).alias("x")).first().x == datetime(2022, 2, 24)
