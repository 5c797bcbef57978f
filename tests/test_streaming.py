from datetime import datetime, timedelta

from pyspark.sql import functions as F

from panelspark.streaming import ingest
from test_sources import region_csv


def _run(spark, raw, place):
    q = ingest.ingest(spark, str(raw), "region-data", str(place / "table"), str(place / "state"), str(place / "log"))
    q.awaitTermination()
    assert q.exception() is None


def test_ingest_resumes_and_merges(spark, tmp_path):
    raw, place = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    region_csv(raw, "MISO", hours=50)
    _run(spark, raw, place)
    table = lambda: spark.read.parquet(str(place / "table"))
    assert table().count() == 100
    _run(spark, raw, place)  # nothing new
    assert table().count() == 100 and spark.read.parquet(str(place / "log")).count() == 1
    region_csv(raw, "PJM", hours=30)
    (raw / "MISO_20220101_20220101_fix_region-data.csv").write_text(
        "period,respondent,respondent-name,type,type-name,value,value-units\n2022-01-01T03,MISO,New name,D,Demand,5,mwh\nbad,MISO,New name,D,Demand,5,mwh\n")
    _run(spark, raw, place)
    assert table().count() == 160
    fixed = table().where("respondent = 'MISO' AND type = 'D' AND period = TIMESTAMP_NTZ'2022-01-01 03:00:00'").collect()
    assert [(r.value_mwh, r.respondent_name) for r in fixed] == [(5.0, "New name")]
    log = spark.read.parquet(str(place / "log"))
    assert log.count() == 3 and log.agg(F.sum("rows_raw"), F.sum("rows_ingested")).first()[:] == (161, 161)  # unreadable periods are dropped before counting
    assert {r.status for r in log.collect()} == {"success"}


def _scored(spark, folder):
    t = datetime(2022, 1, 1)
    rows = [("a", t + timedelta(hours=h), 10.0, 12.0 if h < 48 else 15.0) for h in range(96)] * 2
    spark.createDataFrame(rows, "respondent string, period timestamp, demand_mw double, prediction double").write.parquet(folder)
    return spark.readStream.schema("respondent string, period timestamp, demand_mw double, prediction double").parquet(folder)


def test_running_rmse_and_alerts(spark, tmp_path):
    stream = ingest.deduplicate(_scored(spark, str(tmp_path / "in")), ["respondent", "period"], "period")
    windows = stream.groupBy("respondent", F.window("period", "1 day")).agg(
        F.sqrt(F.avg(F.pow(F.col("demand_mw") - F.col("prediction"), 2))).alias("rmse"), F.count("*").alias("n_rows"))
    train = spark.createDataFrame([("a", 2.0)], "respondent string, train_rmse double")
    got = []

    def keep(batch, _no):
        got.extend((r.window.start.day, r.rmse, r.n_rows) for r in ingest.drift_alerts(batch, train, ["respondent"]).collect())

    q = windows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(got) == [(3, 5.0, 24), (4, 5.0, 24)]


def test_sliding_rmse(spark, tmp_path):
    windows = ingest.running_rmse(_scored(spark, str(tmp_path / "in")), ["respondent"], "period", "demand_mw", "prediction", "2 days", "1 day", "1 hour")
    q = windows.writeStream.format("memory").queryName("rmse_windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.window.start.day: r.rmse for r in spark.table("rmse_windows").collect()}
    assert got[1] == 2.0 and got[3] == 5.0 and round(got[2] ** 2, 6) == (4 + 25) / 2
