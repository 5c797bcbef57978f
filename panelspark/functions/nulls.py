"""NULL-safe building blocks. A missing value is always NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to [low, high]; NULL stays NULL (``greatest``/``least`` would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def flag(condition: Column) -> Column:
    """0/1 byte of a comparison; a comparison with NULL counts as false."""
    return F.coalesce(condition, F.lit(False)).cast("byte")


def share(part: Column, total: Column) -> Column:
    """part / total, 0 where either is missing or the total is 0."""
    return F.coalesce(F.try_divide(part, F.nullif(total, F.lit(0.0))), F.lit(0.0))


def row_sum(*cols: Column, floor: float | None = None) -> Column:
    """Sum across columns that counts missing values as 0."""
    total = F.lit(0.0)
    for c in cols:
        v = F.coalesce(c, F.lit(0.0))
        total = total + (F.greatest(v, F.lit(floor)) if floor is not None else v)
    return total


def finite(*cols: Column) -> Column:
    """True where all values are present and neither NaN nor infinite."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return ok
