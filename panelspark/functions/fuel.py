"""Supply-mix shares from fuel columns already shifted to t - 24."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.nulls import clip, row_sum, share
from panelspark.operators.blocks import Over, lag

# Fuel codes.
BASE_FUELS = ("WND", "SUN", "COL", "NG")
ALL_FUELS = ("WND", "SUN", "COL", "NG", "NUC", "WAT", "GEO", "OIL", "OTH", "BAT", "PS")
RENEWABLE_FUELS = ("WND", "SUN", "WAT", "GEO")
SHARES = {"WND": "wind_pct", "SUN": "solar_pct", "COL": "coal_pct", "NG": "ng_pct"}


def shifted(fuels: tuple[str, ...] = ALL_FUELS, prefix: str = "fuel_") -> dict[str, Over]:
    return {f"{prefix}{f}": lag(f, 24) for f in fuels}


def mix(fuels: tuple[str, ...] = ALL_FUELS, prefix: str = "fuel_", lag_24: str = "lag_24h",
        has_fuel: Column | None = None) -> dict[str, Column]:
    """Shares of the four base fuels, of nuclear, hydro and renewables, and the total.

    The four-fuel total is not limited at 0, the total over all fuels is. A missing value in either
    place gives a share of 0. ``has_fuel`` false (no supply data at all) gives 0 everywhere.
    """
    def fuel(code: str) -> Column:
        return F.col(f"{prefix}{code}") if code in fuels else F.lit(0.0)

    base = row_sum(*[fuel(f) for f in BASE_FUELS])
    total = F.nullif(row_sum(*[fuel(f) for f in fuels], floor=0.0), F.lit(0.0))
    renewable = row_sum(*[fuel(f) for f in RENEWABLE_FUELS if f in fuels], floor=0.0)
    out = {name: share(fuel(code), base) for code, name in SHARES.items()}
    out["nuclear_pct"] = share(fuel("NUC"), total)
    out["hydro_pct"] = share(fuel("WAT"), total)
    out["renewable_pct"] = share(renewable, total)
    out["total_gen_mw_lag24"] = total
    ratio = F.try_divide(total, F.nullif(F.col(lag_24), F.lit(0.0)))
    out["gen_demand_ratio_lag24"] = clip(ratio, 0.0, 5.0)
    if has_fuel is not None:
        out = {n: F.when(has_fuel, c).otherwise(F.lit(0.0)) for n, c in out.items()}
    return out
