"""Folds, warm-up, tail and hold-out splits. Positions are exact and never need a whole series in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.blocks import row_position
from panelspark.panel import Panel

WARMUP_ROWS = 168
BASE_YEAR = 2020
FIRST_FOLD, LAST_FOLD = -1, 5


def fold_label(ts: Column, base_year: int = BASE_YEAR) -> Column:
    """Year distance from ``base_year`` limited to [-1, 5]; -1 trains only, 5 is the untouched hold-out."""
    return F.greatest(F.lit(FIRST_FOLD), F.least(F.lit(LAST_FOLD), F.year(ts) - base_year))


def drop_warmup(df: DataFrame, panel: Panel, target: str, rows: int = WARMUP_ROWS) -> DataFrame:
    """Drop the first rows of every series by position, then rows without a target."""
    placed = row_position(df, panel, "_pos")
    return placed.where((F.col("_pos") > rows) & F.col(target).isNotNull()).drop("_pos")


def tail_split(df: DataFrame, panel: Panel, share: float = 0.1) -> DataFrame:
    """Mark the last ``share`` of every series (at least one row) as validation."""
    placed = row_position(df, panel, "_pos", "_total")
    n_val = F.greatest(F.lit(1), F.floor(F.col("_total") * F.lit(share))).cast("long")
    mark = (F.col("_pos") > F.col("_total") - n_val).cast("int")
    return placed.withColumn("is_validation", mark).drop("_pos", "_total")


def holdout_split(df: DataFrame, panel: Panel, train: float = 0.8) -> DataFrame:
    """Chronological split: the first ``train`` of every series trains, the rest tests."""
    placed = row_position(df, panel, "_pos", "_total")
    cut = F.floor(F.col("_total") * F.lit(train)).cast("long")
    return placed.withColumn("split", F.when(F.col("_pos") <= cut, "train").otherwise("test")).drop(
        "_pos", "_total"
    )


def time_series_split(df: DataFrame, panel: Panel, folds: int = 5, gap: int = 24) -> DataFrame:
    """Expanding folds: one row per (fold, row) with the role ``train`` or ``test``.

    The series is cut into ``folds + 1`` parts of equal length (the remainder goes to the first);
    fold i tests on part i + 1 and trains on everything more than ``gap`` rows before it.
    """
    placed = row_position(df, panel, "_pos", "_total")
    size = F.floor(F.col("_total") / F.lit(folds + 1)).cast("long")
    placed = placed.withColumn("_size", size).withColumn(
        "split_no", F.explode(F.array(*[F.lit(i) for i in range(1, folds + 1)]))
    )
    start = F.col("_total") - (F.lit(folds + 1) - F.col("split_no")) * F.col("_size")
    role = (
        F.when((F.col("_pos") > start) & (F.col("_pos") <= start + F.col("_size")), "test")
        .when(F.col("_pos") <= start - gap, "train")
    )
    return placed.withColumn("role", role).where("role IS NOT NULL").drop("_pos", "_total", "_size")


def min_length(df: DataFrame, keys: list[str], rows: int = 8_760) -> DataFrame:
    """Series with at least ``rows`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= rows)
