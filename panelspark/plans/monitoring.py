"""Drift, champion choice and priority-ordered summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.nulls import clip
from panelspark.operators.blocks import over_blocks, rolling
from panelspark.operators.scoring import OVERALL
from panelspark.panel import Panel
from panelspark.session import small

DRIFT_DAYS = 7
DRIFT_LIMIT = 0.15
MIN_IMPROVEMENT = 0.02
RETRAIN_DAYS = 730


def drift(df: DataFrame, panel: Panel, train_rmse: DataFrame, target: str = "demand_mw", prediction: str = "prediction",
          steps: int = DRIFT_DAYS * 24, limit: float = DRIFT_LIMIT) -> DataFrame:
    """Rolling RMSE over the last ``steps`` grid rows against the training RMSE; alert above ``limit``.

    ``train_rmse``: (keys, train_rmse), one row per series.
    """
    sq = F.pow(F.col(target) - F.col(prediction), F.lit(2.0))
    rolled = over_blocks(df.withColumn("_sq", sq), panel, {"_ms": rolling(F.avg, "_sq", steps)})
    rolled = rolled.withColumn("rolling_rmse", F.sqrt(clip(F.col("_ms"), 0.0))).drop("_sq", "_ms")
    ratio = F.try_divide(F.col("rolling_rmse") - F.col("train_rmse"), F.col("train_rmse"))
    joined = rolled.join(small(train_rmse), list(panel.keys), "left").withColumn("drift", ratio)
    return joined.withColumn("alert", F.coalesce(F.col("drift") > limit, F.lit(False)).cast("int"))


def training_window(df: DataFrame, ts: str, now: str, days: int = RETRAIN_DAYS) -> DataFrame:
    """Rows of the last ``days`` days before ``now``."""
    end = F.lit(now).cast("timestamp_ntz")
    return df.where((F.col(ts) > end - F.make_dt_interval(F.lit(days))) & (F.col(ts) <= end))


def champion_choice(champion: DataFrame, challenger: DataFrame, keys: list[str],
                    min_improvement: float = MIN_IMPROVEMENT) -> DataFrame:
    """The challenger replaces the champion only if its RMSE is lower by at least the given share."""
    both = champion.select(*keys, F.col("rmse").alias("champion_rmse")).join(
        challenger.select(*keys, F.col("rmse").alias("challenger_rmse")), keys, "full")
    gain = F.try_divide(F.col("champion_rmse") - F.col("challenger_rmse"), F.col("champion_rmse"))
    first = F.col("champion_rmse").isNull() & F.col("challenger_rmse").isNotNull()
    replace = first | F.coalesce(gain >= min_improvement, F.lit(False))
    return both.withColumn("improvement", gain).withColumn("replace", replace.cast("int"))


def priority_summary(scores: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Best model per region in the order of priority; ``registry``: (key, priority, enabled)."""
    overall = scores.where((F.col("fold") == OVERALL) & F.col("rmse").isNotNull())
    best = overall.groupBy(key).agg(F.min_by(F.struct("model", "rmse"), F.struct("rmse", "model")).alias("_b"))
    joined = registry.where("enabled").join(best, key, "left").select(
        key, "priority", F.col("_b.model").alias("best_model"), F.col("_b.rmse").alias("best_rmse"))
    # A place is that within the priority plus the regions of higher priority; the second is counted on one row per priority.
    above = F.sum("_n").over(Window.orderBy("priority").rowsBetween(Window.unboundedPreceding, -1))
    before = joined.groupBy("priority").agg(F.count("*").alias("_n")).select(
        F.col("priority").alias("_p"), F.coalesce(above, F.lit(0)).alias("_above"))
    inside = F.row_number().over(Window.partitionBy("priority").orderBy(key))
    placed = joined.withColumn("_inside", inside).join(small(before), F.col("priority").eqNullSafe(F.col("_p")))
    return placed.withColumn("position", (F.col("_inside") + F.col("_above")).cast("int")).drop("_inside", "_p", "_above")
