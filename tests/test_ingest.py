"""Raw files to the clean table: duplicates, gaps over file borders, flags, log, replays."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelspark.operators import upsert
from panelspark.plans import ingest

HEAD = "period,respondent,respondent-name,type,type-name,value,value-units\n"


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEAD + "".join(f"{p},{r},{r} name,D,Demand,{v},mwh\n" for p, r, v in rows))


def hour(i):
    return (datetime(2022, 1, 1) + timedelta(hours=i)).strftime("%Y-%m-%dT%H")


def table(spark, path):
    return {(r.respondent, r.period): r for r in spark.read.parquet(path).collect()}


def test_batches_equal_one_load(spark, tmp_path):
    values = {i: 1000 + i % 7 for i in range(400) if i not in (50, 51, 199, 200, 201)}
    values[300] = 999_999
    rows = [(hour(i), "A", v) for i, v in values.items()]
    whole, parts = tmp_path / "whole", tmp_path / "parts"
    write(whole, "A_1_2_region-data.csv", rows)
    ingest.load_folder(spark, str(whole), "region-data", str(tmp_path / "t1"), str(tmp_path / "log"))
    for n, (a, b) in enumerate(((0, 200), (200, 295), (295, 400))):
        write(parts / str(n) if parts.mkdir(exist_ok=True) is None else None, "A_1_2_region-data.csv", [r for i, r in zip(values, rows) if a <= i < b])
        ingest.load_folder(spark, str(parts / str(n)), "region-data", str(tmp_path / "t2"))
    one, other = table(spark, str(tmp_path / "t1")), table(spark, str(tmp_path / "t2"))
    pick = lambda t: {k: (r.value_mwh, r.is_imputed, r.is_anomaly) for k, r in t.items()}
    assert len(one) == 400 and pick(one) == pick(other)
    assert sum(r.is_imputed for r in one.values()) == 5 and [k[1].hour for k, r in one.items() if r.is_anomaly] == [300 % 24]
    log = spark.read.parquet(str(tmp_path / "log")).first()
    assert (log.rows_raw, log.rows_ingested, log.rows_imputed, log.rows_anomaly) == (395, 400, 5, 1)
    ingest.load_folder(spark, str(whole), "region-data", str(tmp_path / "t1"))
    assert pick(table(spark, str(tmp_path / "t1"))) == pick(one)


def test_first_in_a_file_and_the_later_file_count(spark, tmp_path):
    write(tmp_path / "a", "A_1_2_region-data.csv", [(hour(0), "A", 1), (hour(0), "A", 999), ("bad", "A", 5), (hour(1), "A", "n/a"), (hour(2), "A", 3)])
    ingest.load_folder(spark, str(tmp_path / "a"), "region-data", str(tmp_path / "t"))
    got = table(spark, str(tmp_path / "t"))
    assert [got["A", datetime(2022, 1, 1, i)].value_mwh for i in range(3)] == [1, 2, 3]
    write(tmp_path / "b", "A_2_3_region-data.csv", [(hour(0), "A", 7), (hour(3), "B", 4)])
    ingest.load_folder(spark, str(tmp_path / "b"), "region-data", str(tmp_path / "t"), skip_loaded=True)
    got = table(spark, str(tmp_path / "t"))
    assert got["A", datetime(2022, 1, 1, 0)].value_mwh == 1 and got["B", datetime(2022, 1, 1, 3)].value_mwh == 4
    ingest.load_folder(spark, str(tmp_path / "b"), "region-data", str(tmp_path / "t"))
    assert table(spark, str(tmp_path / "t"))["A", datetime(2022, 1, 1, 0)].value_mwh == 7


def test_failed_load_is_logged_whole(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "A_1_2_region-data.csv").write_text("period,other\n2022-01-01T00,1\n")
    with pytest.raises(Exception):
        ingest.load_folder(spark, str(tmp_path / "x"), "region-data", str(tmp_path / "t"), str(tmp_path / "log"))
    row = spark.read.parquet(str(tmp_path / "log")).first()
    assert row.status == "error" and row.error_msg


def test_null_partition_survives_an_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    def rows(*x):
        return spark.createDataFrame(list(x), "k int, part string, value double")
    upsert.upsert_table(spark, path, rows((1, None, 1.0), (2, "x", 2.0)), ["k", "part"], ["part"], ["value"])
    upsert.upsert_table(spark, path, rows((3, None, 3.0)), ["k", "part"], ["part"], ["value"])
    assert sorted(r.k for r in spark.read.parquet(path).select(F.col("k")).collect()) == [1, 2, 3]
