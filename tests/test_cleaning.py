from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import cleaning, splits, upsert
from panelspark.panel import Panel

P = Panel(block=16)
N = None


def _fill(hourly, values, max_gap):
    df = cleaning.fill_gaps(hourly({"a": values}), P, max_gap=max_gap).orderBy("period").collect()
    return [r.value_filled for r in df], [r.is_imputed for r in df]


@pytest.mark.parametrize("values,limit,want", [
    ([10, N, 30], 6, [10, 20, 30]),
    ([0, N, N, N, 4], 3, [0, 1, 2, 3, 4]),
    ([0, N, N, N, N, 5], 3, [0, N, N, N, N, 5]),
    ([1, N, N, 4, 5, N, N, N, N, N, 11], 3, [1, 2, 3, 4, 5, N, N, N, N, N, 11]),
    ([1, N, 3, N, N, N], 3, [1, 2, 3, 3, 3, 3]),
    ([1, N, N, N, N], 3, [1, N, N, N, N]),
    ([N, 1], 3, [N, 1]),
    ([N, N, N], 3, [N, N, N]),
    ([5, 6, 7], 3, [5, 6, 7]),
])
def test_gap_fill(hourly, values, limit, want):
    got, imputed = _fill(hourly, values, limit)
    assert got == [None if w is None else float(w) for w in want]
    assert imputed == [int(v is None and w is not None) for v, w in zip(values, want)]


def test_gap_fill_over_block_borders_equals_brute_force(hourly):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.45 else float(i * i % 101) for i in range(400)]
    want, i = list(values), 0
    while i < len(values):
        if values[i] is not None:
            i += 1
            continue
        j = i
        while j < len(values) and values[j] is None:
            j += 1
        if i > 0 and j - i <= 4:
            for k in range(i, j):
                want[k] = values[i - 1] if j == len(values) else values[i - 1] + (values[j] - values[i - 1]) * (k - i + 1) / (j - i + 1)
        i = j
    got, _ = _fill(hourly, values, 4)
    assert [g is None for g in got] == [w is None for w in want]
    np.testing.assert_allclose([g for g in got if g is not None], [w for w in want if w is not None])


def test_grid_fills_missing_hours_over_many_blocks(spark, hourly):
    df = hourly({"a": range(100), "b": range(3)}).where("value % 7 <> 3")
    grid = cleaning.regular_grid(df, P)
    counts = {r.respondent: (r.n, r.v) for r in grid.groupBy("respondent").agg(F.count("*").alias("n"), F.count("value").alias("v")).collect()}
    assert counts == {"a": (100, 86), "b": (3, 3)}
    assert grid.select("respondent", "period").distinct().count() == 103


def test_spike_is_flagged_and_flat_series_is_not(hourly):
    rng = np.random.default_rng(0)
    noisy = list(80_000 + rng.normal(0, 100, 300))
    noisy[150] = 999_999
    out = cleaning.clean_series(hourly({"a": noisy, "flat": [5.0] * 300}), Panel(block=100))
    hit = out.where("is_anomaly = 1").collect()
    assert [(r.respondent, r.period) for r in hit] == [("a", datetime(2022, 1, 1) + timedelta(hours=150))]


def test_clean_series_keeps_first_duplicate_and_counts_imputed(spark):
    t = datetime(2022, 1, 1)
    rows = [("a", t + timedelta(hours=h), float(h), h) for h in range(60) if h not in (10, 11, 12)]
    rows += [("a", t, 99.0, 1000), ("a", t + timedelta(hours=20), float("nan"), -1)]
    df = spark.createDataFrame(rows, "respondent string, period timestamp_ntz, value double, n int")
    out = cleaning.clean_series(df, Panel(block=100), order=["n"]).orderBy("period").collect()
    assert len(out) == 60 and out[0].value_mwh == 0.0
    assert [r.value_mwh for r in out] == [float(h) for h in range(60)]
    assert sum(r.is_imputed for r in out) == 4  # three missing hours and the NaN that came first


def test_bounds_and_cap(hourly):
    df = hourly({"a": [-1, 0, 5, 500_000, 500_001, N] + [100] * 120 + [5_000], "few": [100, 90_000]})
    bounded = cleaning.absolute_bounds(df, "value")
    assert bounded.where("value IS NOT NULL").count() == 125
    capped = cleaning.statistical_cap(bounded, P, "value")
    got = {r.value for r in capped.where("respondent = 'a'").collect()}
    assert got == {None, 5.0, 100.0}  # 5,000 and 500,000 exceed max(5 * 100, 1000)
    assert {r.value for r in capped.where("respondent = 'few'").collect()} == {100.0, 90_000.0}


def test_warmup_is_positional(hourly):
    out = splits.drop_warmup(hourly({"a": [5_000] * 300}), Panel(block=256), "value")
    assert out.count() == 132
    short = splits.drop_warmup(hourly({"a": [1] * 168}), Panel(block=256), "value")
    assert short.count() == 0


def test_tail_split_has_at_least_one_row(hourly):
    out = splits.tail_split(hourly({"a": range(5), "b": range(100)}), P)
    got = {r.respondent: r.n for r in out.groupBy("respondent").agg(F.sum("is_validation").alias("n")).collect()}
    assert got == {"a": 1, "b": 10}


@pytest.mark.parametrize("year,fold", [(2018, -1), (2019, -1), (2020, 0), (2024, 4), (2025, 5), (2026, 5)])
def test_fold(spark, year, fold):
    df = spark.createDataFrame([(datetime(year, 6, 1),)], "t timestamp_ntz")
    assert df.select(splits.fold_label(F.col("t")).alias("f")).first().f == fold


def test_merge_and_table_upsert(spark, tmp_path):
    path = str(tmp_path / "table")
    def rows(*x):
        return spark.createDataFrame(list(x), "k string, m int, value double, name string")
    upsert.upsert_table(spark, path, rows(("a", 1, 1.0, "first"), ("b", 2, 2.0, "b")), ["k", "m"], ["m"], ["value"], ["name"])
    upsert.upsert_table(spark, path, rows(("a", 1, 9.0, "second"), ("c", 1, 3.0, "c")), ["k", "m"], ["m"], ["value"], ["name"])
    upsert.upsert_table(spark, path, rows(("a", 1, 9.0, "second")), ["k", "m"], ["m"], ["value"], ["name"])
    got = sorted((r.k, r.value, r.name) for r in spark.read.parquet(path).collect())
    assert got == [("a", 9.0, "first"), ("b", 2.0, "b"), ("c", 3.0, "c")]
    upsert.replace_keys(path, rows(("z", 2, 0.0, "z")), ["m"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["a", "c", "z"]


def test_log_and_stats(spark, tmp_path, hourly):
    path = str(tmp_path / "log")
    upsert.append_log(spark, path, endpoint="region-data", respondent="A", status="success", rows_ingested=5)
    upsert.append_log(spark, path, endpoint="region-data", respondent="B", status="error", error_msg="bad")
    from panelspark.plans.reports import ingest_rollup
    row = ingest_rollup(spark.read.parquet(path)).first()
    assert (row.n_success, row.n_failed, row.rows_ingested, row.failed) == (1, 1, 5, "B")
    cleaned = cleaning.clean_series(hourly({"a": [1, N, 3]}), Panel())
    assert cleaning.clean_stats(cleaned, ["respondent"]).first().n_imputed == 1
