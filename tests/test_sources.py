import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelspark.operators import cleaning, joins
from panelspark.panel import Panel
from panelspark.plans import audits
from panelspark.sources import json_pages, raw_csv, registry, tables


def region_csv(folder, code="MISO", hours=200, blank=(), extra=()):
    lines = ["period,respondent,respondent-name,type,type-name,value,value-units"]
    for kind in ("D", "DF"):
        for h in range(hours):
            t = datetime(2022, 1, 1) + timedelta(hours=h)
            v = "" if kind == "D" and h in blank else str(80_000 + h)
            lines.append(f"{t:%Y-%m-%dT%H},{code},Name of {code},{kind},Demand,{v},megawatthours")
    path = folder / f"{code}_20220101_20220110_region-data.csv"
    path.write_text("\n".join([*lines, *extra]) + "\n")
    return path


def test_endpoint_and_code(spark):
    names = ["PJM_x_region-data.csv", "A_region-sub-ba-data.csv", "b_FUEL-TYPE-DATA.csv", "c_interchange-data.csv"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = [tuple(r) for r in df.select(raw_csv.endpoint_of(F.col("f")), raw_csv.code_of(F.col("f"))).collect()]
    assert got == [("region-data", "PJM"), ("region-sub-ba-data", "A"), ("fuel-type-data", "b"), ("interchange-data", "c")]
    with pytest.raises(Exception, match="Cannot detect endpoint"):
        spark.createDataFrame([("weather.csv",)], "f string").select(raw_csv.endpoint_of(F.col("f"))).collect()


def test_read_parse_and_clean_csv(spark, tmp_path):
    extra = ["2022-13-01T00,MISO,x,D,Demand,1,megawatthours", "2022-01-01T00,MISO,x,D,Demand,7,megawatthours", "2022-01-01T05,MISO,x,ZZ,Demand,abc,megawatthours"]
    region_csv(tmp_path, blank=(10, 11, 12), extra=extra)
    region_csv(tmp_path, "PJM")
    (tmp_path / "X_a_b_fuel-type-data.csv").write_text("period,respondent,respondent-name,fueltype,type-name,value,value-units\n2022-01-01T00,X,x,COL,Coal,5,mwh\n")
    good, bad = raw_csv.parse_raw(raw_csv.read_raw(spark, str(tmp_path), "region-data"))
    assert good.count() == 802 and bad.count() == 1
    assert good.where("type = 'ZZ'").first().value is None
    panel = Panel(keys=("respondent", "type"))
    out = cleaning.clean_series(good.where("type <> 'ZZ'"), panel, order=raw_csv.READ_ORDER)
    d = out.where("respondent = 'MISO' AND type = 'D'").orderBy("period").collect()
    assert len(d) == 200 and d[0].value_mwh == 80_000.0 and sum(r.is_imputed for r in d) == 3 and d[11].value_mwh == 80_011.0
    meta = cleaning.series_meta(good.withColumnsRenamed(raw_csv.RENAMES), panel, ["respondent_name", "type_name"])
    assert meta.where("respondent = 'PJM' AND type = 'DF'").first().respondent_name == "Name of PJM"
    fuel = raw_csv.table_columns(raw_csv.parse_raw(raw_csv.read_raw(spark, str(tmp_path), "fuel-type-data"))[0], "fuel-type-data")
    assert fuel.columns == ["period", "respondent", "respondent_name", "fueltype", "type_name", "value_mwh"]
    wide = joins.wide(good, Panel(), "type", joins.REGION_TYPES)
    assert wide.columns[2:] == ["D", "DF", "NG", "TI"] and wide.where("respondent = 'PJM'").count() == 200
    scan = joins.series_scan(good, "PJM", "D", "2022-01-01 05:00:00", "2022-01-01 07:00:00").collect()
    assert [r.period.hour for r in scan] == [5, 6, 7]


def test_header_must_fit(spark, tmp_path):
    (tmp_path / "A_region-data.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception):
        raw_csv.read_raw(spark, str(tmp_path), "region-data").collect()


def test_save_and_load_raw(spark, tmp_path):
    df = spark.createDataFrame([("A", datetime(2022, 1, 1), 1.0), ("B", datetime(2022, 1, 3), 2.0)], "respondent string, period timestamp_ntz, value double")
    path = raw_csv.save_raw(df, str(tmp_path))
    assert path.endswith("20220101_20220103")
    back = raw_csv.load_raw(spark, path, "period timestamp_ntz, value double, respondent string")
    assert {(r.respondent, r.value) for r in back.collect()} == {("A", 1.0), ("B", 2.0)}
    with pytest.raises(ValueError):
        raw_csv.save_raw(df.limit(0), str(tmp_path))


def test_json_pages(spark, tmp_path):
    page = {"response": {"data": [
        {"period": "2022-01-01T00", "respondent": "MISO", "type": "D", "type-name": "Demand", "value": 1.5},
        {"period": "bad", "respondent": "MISO", "type": "D", "type-name": "Demand", "value": 2},
        {"period": "2022-01-01T01", "respondent": "MISO", "type": "D", "type-name": "Demand", "value": "n/a"},
        {"period": "2022-01-01T02", "respondent": "MISO", "type": "D", "type-name": "Demand", "value": None}], "total": 4}}
    (tmp_path / "a.json").write_text(json.dumps(page))
    (tmp_path / "b.json").write_text(json.dumps({"error": "no key"}))
    (tmp_path / "c.json").write_text(json.dumps({"message": "later"}))
    rows, errors = json_pages.parse_pages(json_pages.read_documents(spark, str(tmp_path)))
    assert [(r.period.hour, r.value_mwh) for r in rows.orderBy("period").collect()] == [(0, 1.5), (1, None), (2, None)]
    assert {(r.source_file, r.error_msg) for r in errors.collect()} == {("b.json", "no key"), ("c.json", "later")}


def test_weather_response(spark):
    doc = {"hourly": {"time": ["2022-01-01T00:00", "2022-01-01T01:00"], "temperature_2m": [1.0, None], "cloudcover": [5, 6]}}
    df = spark.createDataFrame([("A", json.dumps(doc)), ("B", json.dumps({"hourly": {"time": []}})), ("C", "{}")], "respondent string, doc string")
    got = json_pages.parse_weather(df, ["respondent"])[0].orderBy("period").collect()
    assert [(r.respondent, r.temp_2m, r.cloudcover, r.precipitation) for r in got] == [("A", 1.0, 5.0, None), ("A", None, 6.0, None)]


def test_progress(spark):
    doc = {"region-data": {"A": {"status": "done", "rows": 5, "file": "x"}, "B": {"status": "failed", "error": "e"}}, "fuel-type-data": {"C": {"status": "done", "rows": 7}}}
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    got = {r.endpoint: tuple(r)[1:] for r in json_pages.progress_rollup(json_pages.progress_rows(df)).collect()}
    assert got == {"region-data": (1, 1, 5, "B"), "fuel-type-data": (1, 0, 7, "")}


def test_registry(spark, tmp_path):
    entries = [{"code": "PJM", "region": "eastern", "priority": 1}, {"code": "AEC", "region": "Eastern", "priority": 2}, {"code": "OFF", "region": "eastern", "enabled": False}, {"code": "CISO", "region": "western", "priority": 1}]
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"balancing_authorities": entries}))
    reg = registry.load_registry(spark, str(path))
    assert [r.code for r in registry.select_regions(reg).collect()] == ["CISO", "PJM", "AEC"]
    assert [r.code for r in registry.select_regions(reg, region="EASTERN", max_priority=1).collect()] == ["PJM"]
    assert [r.code for r in registry.select_regions(reg, enabled_only=False).collect()][-1] == "OFF"
    wanted = spark.createDataFrame([("pjm",), ("new",)], "code string")
    assert {(r.code, r.is_known) for r in registry.resolve(wanted, reg).collect()} == {("PJM", 1), ("NEW", 0)}
    coordinates = spark.createDataFrame([("pjm",), ("OFF",)], "code string")
    assert {r.code for r in registry.without_coordinates(reg.select("code"), coordinates).collect()} == {"AEC", "CISO"}
    found = {r.code: r.lat for r in registry.coordinates_of(wanted, registry.coordinate_table(spark)).collect()}
    assert found == {"pjm": 40.2, "new": None} and registry.coordinate_table(spark).count() == len(registry.COORDINATES)
    plan = {r.endpoint: r for r in registry.fetch_plan(registry.select_regions(reg)).collect()}
    assert plan["region-data"].est_rows == 3 * 254_760 and plan["region-data"].est_pages == pytest.approx(152.856)
    assert registry.group_table(spark).where("region = 'texas'").count() == 2
    assert registry.neighbour_table(spark).where("respondent = 'PJM'").count() == 4


def test_yaml_registry(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "config.yaml"
    path.write_text("balancing_authorities:\n  - code: PJM\n    region: eastern\n")
    assert registry.load_registry(spark, str(path)).first().priority == 99


def test_weather_cache(spark, tmp_path):
    t = datetime(2022, 1, 1)
    spark.createDataFrame([(t, 1.0)], "period timestamp, temp_2m double").toPandas().to_parquet(tmp_path / "PJM_weather.parquet")
    spark.createDataFrame([(t, 2.0, 3.0)], "period timestamp, temp_2m double, cloudcover double").toPandas().to_parquet(tmp_path / "MISO_weather.parquet")
    df = tables.read_weather_cache(spark, str(tmp_path))
    assert df.columns == ["period", "respondent", "temp_2m", "dewpoint_2m", "windspeed_10m", "solar_irradiance", "cloudcover", "precipitation"]
    assert {(r.respondent, r.temp_2m, r.cloudcover, r.precipitation) for r in df.collect()} == {("PJM", 1.0, None, None), ("MISO", 2.0, 3.0, None)}
    late = df.where("respondent = 'PJM'").select("respondent", "period", F.lit(9.0).alias("precipitation"), F.lit(8.0).alias("snow"))
    got = {r.respondent: (r.precipitation, r.snow) for r in tables.add_late_columns(df, late, ["respondent", "period"], ["precipitation", "snow"]).collect()}
    assert got == {"PJM": (9.0, 8.0), "MISO": (None, None)}


def test_logs(spark, tmp_path):
    (tmp_path / "Ridge.log").write_text("  Baselines:  EIA DF RMSE=  2,600\n    Ridge     RMSE=  1,300  [1s]\n  vs EIA DF: -50%  BEAT\n  EIA DF RMSE=    400\n    Ridge  RMSE=500\n vs EIA DF: +25%  below\n")
    (tmp_path / "Empty.log").write_text("nothing")
    got = {r.model: r for r in tables.log_leaderboard(tables.read_logs(spark, str(tmp_path)), complete=2).collect()}
    r = got["Ridge"]
    assert (r.beats, r.total, r.benchmark_mean, r.model_mean, r.diff_pct, r.status) == (1, 2, 1500.0, 900.0, -40.0, "DONE")
    assert (got["Empty"].total, got["Empty"].model_mean, got["Empty"].status) == (0, 0.0, "not started")


def test_results_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.0)], "k string, rmse double")
    tables.write_results(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().rmse == "1.0"
    assert {(r.table_name, r.n_rows) for r in audits.table_counts({"x": df, "y": df.union(df)}).collect()} == {("x", 1), ("y", 2)}
    assert joins.difference(df.select("k").union(spark.createDataFrame([("B",)], "k string")), df, ["k"]).first().k == "B"


def test_fuel_wide_base_fuels(spark):
    rows = [("A", datetime(2022, 1, 1), "COL", 5.0), ("A", datetime(2022, 1, 1, 1), "NUC", 2.0), ("B", datetime(2022, 1, 1), "WND", None)]
    df = spark.createDataFrame(rows, "respondent string, period timestamp_ntz, fueltype string, value double")
    got = {(r.respondent, r.period.hour): (r.WND, r.COL, r.NUC) for r in joins.fuel_wide(df, Panel(), ("WND", "COL", "NUC"), base=("WND", "COL")).collect()}
    assert got == {("A", 0): (0.0, 5.0, None), ("A", 1): (0.0, None, 2.0), ("B", 0): (0.0, 0.0, None)}
