"""De-duplication, regular grid, gap fill, anomaly flags and value bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.nulls import flag, nan_to_null
from panelspark.operators.blocks import Over, over_blocks, rolling
from panelspark.operators.quantiles import exact_quantiles, unpivot
from panelspark.panel import Panel
from panelspark.session import materialize, small, stored

MAX_GAP = 6
ANOMALY_WINDOW = 168
ANOMALY_MIN_PERIODS = 24
ANOMALY_STD = 4.0
MAX_DEMAND = 500_000.0
CAP_MIN_ROWS = 100
CAP_FACTOR = 5.0
CAP_FLOOR = 1_000.0


def keep_first(df: DataFrame, panel: Panel, order: list[str]) -> DataFrame:
    """One row per (keys, time): the first in ``order`` (file, row number).

    Spark limits each map task to its own first row per group before the exchange, so a heavily
    repeated key does not travel.
    """
    w = Window.partitionBy(*panel.keys, panel.ts).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def grid_points(df: DataFrame, panel: Panel) -> DataFrame:
    """Every step between the first and the last time of each series.

    Series are first cut into blocks and the blocks are spread over the cluster, so a long series is
    not generated by one task.
    """
    # A number is given so that tiny partitions, which grow a thousandfold below, are not merged.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.lit(panel.block)
    extent = df.groupBy(*panel.keys).agg(
        F.min(panel.slot()).alias("_lo"), F.max(panel.slot()).alias("_hi")
    )
    first = F.floor(F.col("_lo") / size).cast("long")
    last = F.floor(F.col("_hi") / size).cast("long")
    blocks = extent.select("*", F.explode(F.sequence(first, last)).alias("_b"))
    spread = blocks.repartition(tasks, *panel.keys, "_b")
    steps = F.sequence(
        F.greatest(F.col("_lo"), F.col("_b") * size),
        F.least(F.col("_hi"), F.col("_b") * size + size - 1),
    )
    return spread.select(*panel.keys, F.explode(steps).alias("_slot")).select(
        *panel.keys, panel.slot_start(F.col("_slot")).alias(panel.ts)
    )


def regular_grid(df: DataFrame, panel: Panel) -> DataFrame:
    """Strict grid per series; steps without a row get NULL values. Reads its input twice."""
    df = stored(df)
    return grid_points(df, panel).join(df, [*panel.keys, panel.ts], "left").select(*df.columns)


def _gap_stages(panel: Panel, value: str, max_gap: int, out: str):
    """Two stages: nearest known values within reach, then the filled value.

    A run is filled only as a whole, so values further away than ``max_gap`` rows never matter and
    bounded frames are enough. At the end of a series the frame ahead is cut short, which tells a
    trailing run from a long one.
    """
    v = F.col(value)
    here = F.when(v.isNotNull(), panel.slot())

    def before(c: Column) -> Over:
        return Over(lambda w: F.last(c, True).over(w.rowsBetween(-max_gap, -1)), back=max_gap)

    def after(c: Column) -> Over:
        return Over(lambda w: F.first(c, True).over(w.rowsBetween(1, max_gap)), ahead=max_gap)

    neighbours = {
        "_pv": before(v),
        "_ps": before(here),
        "_nv": after(v),
        "_ns": after(here),
        "_rest": Over(lambda w: F.count(F.lit(1)).over(w.rowsBetween(1, max_gap)), ahead=max_gap),
    }
    done = panel.slot() - F.col("_ps")
    span = F.col("_ns") - F.col("_ps")
    between = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * done / span
    filled = (
        F.when(v.isNotNull(), v)
        .when(F.col("_ps").isNull(), F.lit(None))
        .when(F.col("_ns").isNotNull(), F.when(span - 1 <= max_gap, between))
        .when(done + F.col("_rest") <= max_gap, F.col("_pv"))
    )
    return neighbours, {out: filled.cast("double")}


_GAP_COLUMNS = ("_pv", "_ps", "_nv", "_ns", "_rest")


def fill_gaps(df: DataFrame, panel: Panel, value: str = "value", max_gap: int = MAX_GAP,
              out: str = "value_filled", imputed: str = "is_imputed") -> DataFrame:
    """Linear fill of runs of at most ``max_gap`` missing steps; longer runs stay empty as a whole.

    A short run at the end repeats the last value, a run at the start stays empty.
    """
    stages = _gap_stages(panel, value, max_gap, out)
    filled = over_blocks(df, panel, *stages).drop(*_GAP_COLUMNS)
    return filled.withColumn(imputed, flag(F.col(value).isNull() & F.col(out).isNotNull()))


def _anomaly_stages(value: str, window: int, min_periods: int, threshold: float, out: str):
    stats = {
        "_mean": rolling(F.avg, value, window, min_periods, center=True),
        "_std": rolling(F.stddev_samp, value, window, min_periods, center=True),
    }
    z = F.try_divide(F.abs(F.col(value) - F.col("_mean")), F.nullif(F.col("_std"), F.lit(0.0)))
    return stats, {out: flag(z > threshold)}


def flag_anomalies(df: DataFrame, panel: Panel, value: str, window: int = ANOMALY_WINDOW,
                   min_periods: int = ANOMALY_MIN_PERIODS, threshold: float = ANOMALY_STD,
                   out: str = "is_anomaly", keep_stats: bool = False) -> DataFrame:
    """Rows further than ``threshold`` standard deviations from the centred rolling mean."""
    flagged = over_blocks(df, panel, *_anomaly_stages(value, window, min_periods, threshold, out))
    return flagged if keep_stats else flagged.drop("_mean", "_std")


def clean_series(df: DataFrame, panel: Panel, value: str = "value", max_gap: int = MAX_GAP,
                 window: int = ANOMALY_WINDOW, min_periods: int = ANOMALY_MIN_PERIODS,
                 threshold: float = ANOMALY_STD, order: list[str] | None = None) -> DataFrame:
    """De-duplicate, grid, fill and flag; fill and flag share one exchange and one sort."""
    rows = keep_first(df, panel, order) if order else df
    rows = rows.withColumn(value, nan_to_null(F.col(value)))
    grid = regular_grid(rows.select(*panel.keys, panel.ts, value), panel)
    stages = (*_gap_stages(panel, value, max_gap, "value_filled"),
              *_anomaly_stages("value_filled", window, min_periods, threshold, "is_anomaly"))
    out = over_blocks(grid, panel, *stages)
    return out.select(
        *panel.keys, panel.ts, F.col("value_filled").alias("value_mwh"),
        flag(F.col(value).isNull() & F.col("value_filled").isNotNull()).alias("is_imputed"),
        "is_anomaly",
    )


def series_meta(df: DataFrame, panel: Panel, names: list[str]) -> DataFrame:
    """Names taken from the first row of every series."""
    first = F.min_by(F.struct(*names), F.col(panel.ts)).alias("_m")
    return df.groupBy(*panel.keys).agg(first).select(*panel.keys, *[F.col(f"_m.{n}").alias(n) for n in names])


def clean_stats(cleaned: DataFrame, by: list[str]) -> DataFrame:
    return cleaned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("is_imputed").cast("long")).alias("n_imputed"),
        F.sum(F.col("is_anomaly").cast("long")).alias("n_anomaly"),
    )


def generic_clean(df: DataFrame, value: str = "value") -> DataFrame:
    """Drop full-row duplicates, then read the value as a number (bad text becomes NULL)."""
    return df.dropDuplicates().withColumn(value, nan_to_null(F.expr(f"try_cast({value} AS double)")))


def absolute_bounds(df: DataFrame, *cols: str, high: float = MAX_DEMAND) -> DataFrame:
    """Values at or below 0 or above ``high`` become NULL."""
    return df.withColumns({c: F.when((F.col(c) > 0) & (F.col(c) <= high), F.col(c)) for c in cols})


def statistical_cap(df: DataFrame, panel: Panel, *cols: str, factor: float = CAP_FACTOR,
                    floor: float = CAP_FLOOR, min_rows: int = CAP_MIN_ROWS) -> DataFrame:
    """Values above ``max(factor * p95, floor)`` of their series become NULL if it has enough values."""
    df = stored(df)
    long = unpivot(df.select(*panel.keys, *cols), list(panel.keys), list(cols))
    long._is_stored = True  # a projection of a written table
    q = exact_quantiles(long, [*panel.keys, "feature"], "value", {"_p95": 0.95}, count="_valid")
    cap = F.when(F.col("_valid") > min_rows, F.greatest(F.col("_p95") * factor, F.lit(float(floor))))
    limits = q.groupBy(*panel.keys).agg(*[F.max(F.when(F.col("feature") == c, cap)).alias(f"_cap_{c}") for c in cols])
    out = df.join(small(materialize(limits)), list(panel.keys), "left")
    return out.withColumns({c: F.when(F.col(f"_cap_{c}").isNull() | (F.col(c) <= F.col(f"_cap_{c}")), F.col(c)) for c in cols}).select(*df.columns)
