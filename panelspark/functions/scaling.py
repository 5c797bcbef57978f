"""Imputation and scaling with exact statistics per series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.nulls import clip
from panelspark.operators.quantiles import exact_quantiles, unpivot
from panelspark.session import materialize, small, stored

CLIP = 5.0


def column_quantiles(df: DataFrame, keys: list[str], cols: list[str], probs: dict[str, float]) -> DataFrame:
    """One row per group with a column ``{name}_{column}`` for every quantile."""
    long = unpivot(stored(df).select(*keys, *cols), keys, cols)
    long._is_stored = True  # a projection of a written table
    q = exact_quantiles(long, [*keys, "feature"], "value", probs)
    made = [F.max(F.when(F.col("feature") == c, F.col(n))).alias(f"{n}_{c}") for c in cols for n in probs]
    return q.groupBy(*keys).agg(*made)


def impute_median(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Missing values replaced by the exact median of their series."""
    df = stored(df)
    q = column_quantiles(df, keys, cols, {"_q50": 0.5})
    out = df.join(small(materialize(q)), keys, "left")
    return out.withColumns({c: F.coalesce(c, f"_q50_{c}") for c in cols}).select(*df.columns)


def robust_scale(df: DataFrame, keys: list[str], cols: list[str], limit: float | None = CLIP) -> DataFrame:
    """(x - median) / interquartile range, limited to +-``limit``; a range of 0 counts as 1."""
    df = stored(df)
    q = column_quantiles(df, keys, cols, {"_q25": 0.25, "_q50": 0.5, "_q75": 0.75})
    out = df.join(small(materialize(q)), keys, "left")

    def scaled(c: str):
        spread = F.coalesce(F.nullif(F.col(f"_q75_{c}") - F.col(f"_q25_{c}"), F.lit(0.0)), F.lit(1.0))
        z = (F.col(c) - F.col(f"_q50_{c}")) / spread
        return z if limit is None else clip(z, -limit, limit)

    return out.withColumns({c: scaled(c) for c in cols}).select(*df.columns)


def standardise(df: DataFrame, keys: list[str], cols: list[str], keep_stats: bool = False) -> DataFrame:
    """(x - mean) / population deviation; a deviation of 0 counts as 1."""
    df = stored(df)
    stats = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in cols],
        *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"std_{c}") for c in cols],
    )
    out = df.join(small(materialize(stats)), keys, "left").withColumns({
        c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in cols})
    return out if keep_stats else out.select(*df.columns)


def unstandardise(df: DataFrame, prediction: str, column: str) -> DataFrame:
    """Back to the units of ``column``; needs the statistics kept by ``standardise``."""
    return df.withColumn(prediction, F.col(prediction) * F.col(f"std_{column}") + F.col(f"mean_{column}"))
