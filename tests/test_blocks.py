"""Windows split into blocks give the same result as windows over whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators.blocks import lag, lead, over_blocks, reach, rolling, row_position, with_halo
from panelspark.panel import Panel

P = Panel(block=64)


def _series(n=700, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(100, 10, n)
    v[rng.random(n) < 0.1] = np.nan
    return [None if np.isnan(x) else float(x) for x in v]


@pytest.mark.parametrize("width,need,offset,center", [(24, 12, 24, False), (48, 24, 0, False), (60, 24, 0, True), (1, 1, 0, False), (7, 3, 57, False)])
def test_rolling_equals_pandas(hourly, width, need, offset, center):
    data = {"a": _series(), "b": _series(300, 2)}
    df = over_blocks(hourly(data), P, {
        "m": rolling(F.avg, "value", width, need, offset, center), "s": rolling(F.stddev_samp, "value", width, need, offset, center),
        "x": rolling(F.max, "value", width, need, offset, center)}).toPandas()
    for code, values in data.items():
        got = df[df.respondent == code].sort_values("period")
        s = pd.Series([np.nan if v is None else v for v in values]).shift(offset)
        r = s.rolling(width, min_periods=need, center=center)
        np.testing.assert_allclose(got.m.to_numpy(float), r.mean().to_numpy(), rtol=1e-9)
        np.testing.assert_allclose(got.x.to_numpy(float), r.max().to_numpy(), rtol=1e-12)
        if width > 1:
            np.testing.assert_allclose(got.s.to_numpy(float), r.std().to_numpy(), rtol=1e-7, atol=1e-9)


def test_lag_and_lead_cross_blocks(hourly):
    df = over_blocks(hourly({"a": range(300)}), P, {"l": lag("value", 60), "f": lead("value", 50)}).orderBy("period").collect()
    assert [r.l for r in df] == [None] * 60 + [float(i) for i in range(240)]
    assert [r.f for r in df] == [float(i) for i in range(50, 300)] + [None] * 50


def test_stages_add_up(hourly):
    stage1, stage2 = {"l": lag("value", 20)}, {"m": rolling(F.avg, "l", 30)}
    assert reach(stage1, stage2) == (49, 0)
    got = over_blocks(hourly({"a": range(400)}), P, stage1, stage2).orderBy("period").toPandas()
    want = pd.Series(np.arange(400.0)).shift(20).rolling(30, min_periods=1).mean()
    np.testing.assert_allclose(got.m.to_numpy(float), want.to_numpy())


def test_frame_wider_than_block_is_refused(hourly):
    with pytest.raises(ValueError):
        over_blocks(hourly({"a": range(10)}), P, {"l": lag("value", 65)})


def test_halo_copies_only_border_rows(hourly):
    df = with_halo(hourly({"a": range(640)}), P, 8, 4)
    assert df.count() == 640 + 12 * 10 and df.where("_own").count() == 640


def test_centred_frame_of_168(hourly):
    out = over_blocks(hourly({"a": range(400)}), Panel(block=128), {
        "lo": rolling(F.min, "value", 168, center=True), "hi": rolling(F.max, "value", 168, center=True)})
    row = out.orderBy("period").collect()[200]
    assert (row.lo, row.hi) == (116.0, 283.0)


def test_row_position_equals_global_row_number(hourly):
    df = hourly({"a": range(500), "b": range(3)}).where("value % 3 <> 1")
    w = Window.partitionBy("respondent").orderBy("period")
    want = {(r.respondent, r.period): (r.n, r.t) for r in df.select("*", F.row_number().over(w).alias("n"), F.count("*").over(Window.partitionBy("respondent")).alias("t")).collect()}
    got = {(r.respondent, r.period): (r.row_no, r.total) for r in row_position(df, P, total="total").collect()}
    assert got == want


def test_no_exchange_on_the_series_key_alone(hourly):
    out = over_blocks(hourly({"a": range(10)}), P, {"l": lag("value", 3)}, {"m": rolling(F.avg, "l", 5)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(respondent") == 1 and "_block" in plan


@pytest.mark.parametrize("spike", [1e7, 1e9, 1e12])
@pytest.mark.parametrize("width", [2, 7, 8, 24, 168])
def test_spikes_elsewhere_cost_no_digit(hourly, spike, width):
    rng = np.random.default_rng(4)
    v = np.round(rng.uniform(1000, 1010, 600), 3)
    v[20], v[400:] = spike, 0.1
    panel = Panel(block=512)
    df = over_blocks(hourly({"a": list(v)}), panel, {
        "s": rolling(F.stddev_samp, "value", width, 2), "m": rolling(F.avg, "value", width), "t": rolling(F.sum, F.col("value") * 2, width),
        "n": rolling(F.count, "value", width)}).orderBy("period").toPandas()
    for i in range(width, 600):
        part = v[i - width + 1:i + 1]
        if spike not in part:
            assert df.s[i] == pytest.approx(part.std(ddof=1), rel=1e-6, abs=1e-9) and df.m[i] == pytest.approx(part.mean(), rel=1e-12)
            assert df.t[i] == pytest.approx(2 * part.sum(), rel=1e-12) and df.n[i] == width
    assert (df.s[400 + width:] == 0).all()


@pytest.mark.parametrize("width", [3, 7, 8, 30])
def test_nan_is_missing_for_every_width_and_form(hourly, width):
    data = {"a": [1.0, float("nan"), 2.0, float("inf"), None] * 20}
    df = over_blocks(hourly(data), P, {
        "n": rolling(F.count, "value", width), "c": rolling(F.avg, F.col("value"), width), "m": rolling(F.avg, "value", width)}).where("period > '2022-01-02'").collect()
    assert all(r.m == r.c and 1 <= r.m <= 2 and 0 < r.n < width for r in df)
