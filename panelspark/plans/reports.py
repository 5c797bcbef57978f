"""Leaderboards from score rows. Inputs hold one row per (region, model, fold), so they are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.scoring import OVERALL

EXPLOSION_RATIO = 50.0


def aggregate_summary(scores: DataFrame) -> DataFrame:
    """Mean of the overall metrics over all regions per model."""
    overall = scores.where(F.col("fold") == OVERALL)
    return overall.groupBy("model").agg(
        F.round(F.avg("mae"), 2).alias("mae"), F.round(F.avg("rmse"), 2).alias("rmse"),
        F.round(F.avg("smape"), 3).alias("smape"),
    ).orderBy(F.col("rmse").asc_nulls_last(), "model")


def fold_rmse(scores: DataFrame, keys: list[str], models: list[str], folds: tuple[str, ...]) -> DataFrame:
    """RMSE per fold side by side for the chosen models."""
    chosen = scores.where(F.col("model").isin(*models))
    cols = [F.max(F.when(F.col("fold") == f, F.col("rmse"))).alias(f"rmse_{f}") for f in folds]
    return chosen.groupBy(*keys, "model").agg(*cols)


def versus_benchmark(scores: DataFrame, keys: list[str], benchmark: str) -> DataFrame:
    """Overall rows of the other models against the benchmark row of the same region."""
    overall = scores.where(F.col("fold") == OVERALL)
    ref = F.max(F.when(F.col("model") == benchmark, F.col("rmse"))).over(Window.partitionBy(*keys))
    rows = overall.withColumn("benchmark_rmse", ref).drop("fold").where(F.col("model") != benchmark)
    pct = F.try_divide((F.col("rmse") - F.col("benchmark_rmse")) * 100, F.col("benchmark_rmse"))
    return rows.withColumns({
        "vs_benchmark_pct": F.round(pct, 2),
        "verdict": F.when(F.col("rmse") < F.col("benchmark_rmse"), "BEAT").otherwise("below"),
    })


def win_rate(versus: DataFrame) -> DataFrame:
    """Wins, means, medians and percentages per model over all regions."""
    mean, ref = F.avg("rmse"), F.avg("benchmark_rmse")
    return versus.groupBy("model").agg(
        F.count(F.when(F.col("rmse") < F.col("benchmark_rmse"), 1)).alias("wins"),
        F.count(F.lit(1)).alias("n"),
        mean.alias("mean_rmse"), F.median("rmse").alias("median_rmse"),
        ref.alias("mean_benchmark"), F.median("benchmark_rmse").alias("median_benchmark"),
        F.try_divide((mean - ref) * 100, ref).alias("mean_vs_pct"),
        F.median("vs_benchmark_pct").alias("median_vs_pct"),
        F.avg("mae").alias("mean_mae"), F.avg("smape").alias("mean_smape"),
    )


def explosions(versus: DataFrame, key: str, ratio: float = EXPLOSION_RATIO) -> DataFrame:
    """Per model the regions whose RMSE is at least ``ratio`` times the benchmark, as ``REGION(12x)``."""
    times = F.try_divide(F.col("rmse"), F.col("benchmark_rmse"))
    label = F.concat(F.col(key), F.lit("("), F.round(times, 0).cast("long").cast("string"), F.lit("x)"))
    hit = versus.where(F.col("rmse") >= F.col("benchmark_rmse") * ratio)
    listed = F.array_join(F.array_sort(F.collect_list(label)), ", ")  # at most one entry per region
    return hit.groupBy("model").agg(F.count(F.lit(1)).alias("n_exploded"), listed.alias("exploded"))


def score_pivot(versus: DataFrame, key: str, models: dict[str, str], ratio: float = EXPLOSION_RATIO) -> DataFrame:
    """Region by model: rmse, percent and a marker; ``models`` maps a model to its column prefix."""
    cols = [F.max("benchmark_rmse").alias("benchmark_rmse")]
    for model, prefix in models.items():
        mine = F.col("model") == model
        cols += [
            F.max(F.when(mine, F.col("rmse"))).alias(f"{prefix}_rmse"),
            F.max(F.when(mine, F.col("vs_benchmark_pct"))).alias(f"{prefix}_pct"),
            F.max(F.when(mine, (F.col("rmse") > F.col("benchmark_rmse") * ratio).cast("int"))).alias(f"{prefix}_exploded"),
        ]
    return versus.groupBy(key).agg(*cols)


def head_to_head(versus: DataFrame, key: str, code: str) -> DataFrame:
    """One region, best model first."""
    return versus.where(F.col(key) == code).orderBy(F.col("rmse").asc_nulls_last(), "model")


def top_importance(rows: DataFrame, top: int = 10) -> DataFrame:
    """Strongest features per model: mean and population deviation of importances over all regions.

    ``rows``: (model, feature_names array, feature_importance array). Rows whose arrays differ in length
    are skipped. The label tells how much a feature varies over regions.
    """
    ok = rows.where(F.size("feature_names") == F.size("feature_importance"))
    pairs = ok.select("model", F.inline(F.arrays_zip("feature_names", "feature_importance")))
    stats = pairs.groupBy("model", F.col("feature_names").alias("feature")).agg(
        F.avg("feature_importance").alias("mean_importance"),
        F.stddev_pop("feature_importance").alias("std_importance"),
    )
    cv = F.when(F.col("mean_importance") > 0, F.col("std_importance") / F.col("mean_importance")).otherwise(99.0)
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("mean_importance"), "feature"))
    ranked = stats.withColumns({"cv": cv, "rank": rank}).where(F.col("rank") <= top)
    label = F.when(F.col("cv") < 0.3, "***").when(F.col("cv") < 0.6, "**").otherwise("*")
    return ranked.withColumn("consistency", label)


def ingest_rollup(log: DataFrame) -> DataFrame:
    """Succeeded and failed regions, rows and names of failed regions per endpoint, by the latest run of each region.

    Of runs at the same time a successful one counts, then the one with more rows.
    """
    order = F.struct("run_at", F.col("status") == "success", "rows_ingested")
    log = log.groupBy("endpoint", "respondent").agg(F.max_by(F.struct("status", "rows_ingested"), order).alias("_l")).select("endpoint", "respondent", "_l.*")
    bad = F.col("status") != "success"
    return log.groupBy("endpoint").agg(
        F.count(F.when(~bad, 1)).alias("n_success"), F.count(F.when(bad, 1)).alias("n_failed"),
        F.coalesce(F.sum(F.when(~bad, F.col("rows_ingested"))), F.lit(0)).alias("rows_ingested"),
        F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("respondent")))), ",").alias("failed"),
    )
