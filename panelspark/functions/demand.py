"""Lags, anchored rolling statistics and momentum of the target series.

A window of w rows anchored at t - 24 covers t - 24 - w + 1 ... t - 24: only values known one day ahead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.operators.blocks import Over, lag, rolling

AHEAD = 24
DAY_ROWS, WEEK_ROWS = 24, 168


def lags(demand: str = "demand_mw") -> dict[str, Over]:
    return {"lag_24h": lag(demand, 24), "lag_48h": lag(demand, 48), "lag_168h": lag(demand, 168)}


def anchored(demand: str = "demand_mw") -> dict[str, Over]:
    out = {}
    for width in (DAY_ROWS, WEEK_ROWS):
        out[f"rolling_mean_{width}h"] = rolling(F.avg, demand, width, width // 2, AHEAD)
        out[f"rolling_std_{width}h"] = rolling(F.stddev_samp, demand, width, width // 2, AHEAD)
    return out


def long_lags(demand: str = "demand_mw") -> dict[str, Over]:
    return {"_lag_72h": lag(demand, 72), "lag_336h": lag(demand, 336)}


def momentum(lag_24: str = "lag_24h", lag_48: str = "lag_48h", lag_72: str = "_lag_72h") -> dict[str, Column]:
    a, b, c = F.col(lag_24), F.col(lag_48), F.col(lag_72)
    return {"demand_diff_24h": a - b, "demand_momentum": a - b * 2 + c}


def generation(ng: str = "ng", ti: str = "ti") -> dict[str, Over]:
    """Net generation and interchange at t - 24 with their anchored daily means."""
    return {
        "ng_mw_lag24": lag(ng, 24),
        "_ng_lag48": lag(ng, 48),
        "ng_rolling_mean_24h": rolling(F.avg, ng, DAY_ROWS, 12, AHEAD),
        "ti_mw_lag24": lag(ti, 24),
        "ti_rolling_mean_24h": rolling(F.avg, ti, DAY_ROWS, 12, AHEAD),
    }


def generation_changes(lag_24: str = "lag_24h") -> dict[str, Column]:
    return {
        "ng_change_24h": F.col("ng_mw_lag24") - F.col("_ng_lag48"),
        "demand_minus_ng_lag24": F.col(lag_24) - F.col("ng_mw_lag24"),
    }


def interchange(net: str = "net_interchange") -> dict[str, Over]:
    """Net interchange (exports - imports) at t - 24 and its anchored daily deviation."""
    return {
        "interchange_net_lag24": lag(net, 24),
        "interchange_vol_24h": rolling(F.stddev_samp, net, DAY_ROWS, 12, AHEAD),
    }
