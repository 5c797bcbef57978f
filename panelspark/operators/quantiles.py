"""Exact quantiles per group without holding a group in one task.

The built-in exact percentile keeps every distinct value of a group in one buffer. Here a sketch
first brackets each quantile; rows below the bracket are only counted, and only values inside it are
sorted. The result is the exact, linearly interpolated quantile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import materialize, small, stored

#: Relative rank error of the sketch is 1 / ACCURACY.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    count: str | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """One row per group with one column per entry of ``probs`` and, if named, the value count."""
    names = list(probs)
    data = stored(df).where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    # Edges of ever wider brackets. A group takes the first that leaves room for the error of the sketch and four positions.
    widths = [4.0 / accuracy]
    while widths[-1] < 1.0:
        widths.append(min(1.0, widths[-1] * 4))
    edges = [e for p in probs.values() for s in widths for e in (max(0.0, p - s), min(1.0, p + s))]
    sketch = data.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), F.lit(accuracy)).alias("_e"),
    )
    room = F.lit(2.0 / accuracy) + F.lit(4.0) / F.col("_n")

    def edge(i: int, side: int, outermost: str):
        """Edge of the chosen bracket of a quantile; at either end of the scale the extreme value itself."""
        p, out = list(probs.values())[i], None
        for j, width in enumerate(widths):
            beyond = p - width <= 0 if side == 0 else p + width >= 1
            value = F.col(outermost) if beyond else F.col("_e")[2 * (i * len(widths) + j) + side]
            out = F.when(room <= width, value) if out is None else out.when(room <= width, value)
        return out.otherwise(F.col(outermost))

    brackets = sketch.select(
        *keys, "_n",
        F.array(*[
            F.struct(
                F.lit(i).alias("i"),
                edge(i, 0, "_min").alias("lo"),
                edge(i, 1, "_max").alias("hi"),
            )
            for i in range(len(names))
        ]).alias("_b"),
    )
    # Without keys there is one bracket row, so that side is safe to broadcast.
    joined = data.join(small(materialize(brackets)), keys) if keys else data.join(F.broadcast(brackets), F.lit(True))
    wanted = F.filter("_b", lambda b: F.col("_v") <= b["hi"])
    tagged = joined.select(*keys, "_n", "_v", F.explode(wanted).alias("_q")).select(
        *keys, "_n", F.col("_q.i").alias("_i"),
        F.when(F.col("_v") >= F.col("_q.lo"), F.col("_v")).alias("_v"),
    )
    group = [*keys, "_n", "_i"]
    counts = tagged.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group).orderBy(F.col("_v").asc_nulls_first())
    ranked = counts.withColumn("_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("_i") + 1)
    position = prob * (F.col("_n") - 1)
    low, high = F.floor(position), F.ceil(position)
    picked = ranked.groupBy(*group).agg(
        F.min(F.when(F.col("_cum") > low, F.col("_v"))).alias("_x0"),
        F.min(F.when(F.col("_cum") > high, F.col("_v"))).alias("_x1"),
    )
    interpolated = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * (position - low)
    picked = picked.select(*group, interpolated.alias("_x"))
    cols = [F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(n) for i, n in enumerate(names)]
    if count:
        cols.append(F.max("_n").alias(count))
    return picked.groupBy(*keys).agg(*cols)


def unpivot(df: DataFrame, keys: list[str], cols: list[str], name: str = "feature",
            value: str = "value") -> DataFrame:
    """Long form of several numeric columns."""
    return df.unpivot(keys, [F.col(c).cast("double").alias(c) for c in cols], name, value)


def exact_medians(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Median of many columns at once: long rows (keys, feature, median)."""
    long = unpivot(stored(df).select(*keys, *cols), keys, cols)
    long._is_stored = True  # a projection of a written table
    return exact_quantiles(long, [*keys, "feature"], "value", {"median": 0.5})
