"""Aggregates over other regions, and the stress indicators built from them.

Peers' values are taken at t - 24. Sums over a region are one aggregate per (region, time) minus the
region's own share; no pairs of members are formed. Neighbours come from an explicit, short edge list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.nulls import flag
from panelspark.operators.quantiles import exact_quantiles
from panelspark.panel import Panel
from panelspark.session import materialize, small, stored

AHEAD = 24
#: A group whose members are not summed.
SKIPPED_REGIONS = ("texas",)


def regional_demand(df: DataFrame, members: DataFrame, panel: Panel, demand: str = "demand_mw",
                    skip: tuple[str, ...] = SKIPPED_REGIONS) -> DataFrame:
    """Sum of the other enabled members of the region, and that sum per listed member.

    ``members``: (key, region, enabled). Members without a value count as 0, so the sum is 0 and not
    missing where nobody reports; it is NULL for a region without other members.
    """
    (key,) = panel.keys
    df = stored(df)
    members = members.groupBy(key).agg(F.max(F.struct("region", "enabled")).alias("_m")).select(key, "_m.*")
    sizes = members.where("enabled").groupBy("region").agg(F.count(F.lit(1)).alias("_size"))
    known = members.where(~F.col("region").isin(*skip)) if skip else members
    known = small(known.join(sizes, "region", "left").select(
        key, "region", F.col("enabled").cast("int").alias("_self"),
        (F.coalesce("_size", F.lit(0)) - F.col("enabled").cast("int")).alias("_peers"),
    ))
    tagged = df.join(known, key, "left")
    shares = tagged.where((F.col("_self") == 1) & F.col(demand).isNotNull())
    later = panel.shift(AHEAD).alias(panel.ts)
    totals = shares.select("region", later, demand).groupBy("region", panel.ts).agg(F.sum(demand).alias("_total"))
    own = shares.select(key, later, F.col(demand).alias("_own"))
    joined = tagged.join(totals, ["region", panel.ts], "left").join(own, [key, panel.ts], "left")
    others = F.when(F.col("_peers") > 0,
                    F.coalesce("_total", F.lit(0.0)) - F.coalesce("_own", F.lit(0.0)))
    return joined.select(
        *df.columns, others.alias("regional_demand_index"),
        F.try_divide(others, F.col("_peers")).alias("regional_demand_per_ba"),
    )


def neighbour_values(df: DataFrame, edges: DataFrame, panel: Panel, value: str, aggs: dict) -> DataFrame:
    """(key, time, aggregates) over the neighbours' values one day earlier; ``edges``: (key, peer)."""
    (key,) = panel.keys
    pairs = small(edges.select(F.col(key).alias("_target"), F.col("peer").alias(key)).distinct())
    values = df.where(F.col(value).isNotNull()).select(key, panel.shift(AHEAD).alias(panel.ts), value)
    spread = values.join(pairs, key).select(F.col("_target").alias(key), panel.ts, value)
    return spread.groupBy(key, panel.ts).agg(*[agg(value).alias(name) for name, agg in aggs.items()])


def neighbour_demand(df: DataFrame, edges: DataFrame, panel: Panel, demand: str = "demand_mw") -> DataFrame:
    return neighbour_values(df, edges, panel, demand, {
        "neighbor_demand_avg": F.avg, "neighbor_demand_max": F.max, "neighbor_demand_min": F.min,
    })


def neighbour_weather(df: DataFrame, edges: DataFrame, panel: Panel, field: str = "temp_2m") -> DataFrame:
    return neighbour_values(df, edges, panel, field, {f"neighbor_{field}": F.avg})


def stress_flags(df: DataFrame, panel: Panel, net: str = "interchange_net_lag24") -> DataFrame:
    """1 above the 90 % / below the 10 % quantile of the whole series.

    The net flow counts exports as positive, so ``is_import_stress`` marks heavy exports; the name is
    kept for compatibility.
    """
    df = stored(df)
    q = exact_quantiles(df, list(panel.keys), net, {"_p90": 0.9, "_p10": 0.1})
    out = df.join(small(materialize(q)), list(panel.keys), "left")
    return out.withColumns({
        "is_import_stress": flag(F.col(net) > F.col("_p90")),
        "is_export_stress": flag(F.col(net) < F.col("_p10")),
    }).drop("_p90", "_p10")


def grid_stress(df: DataFrame, panel: Panel, regional: str = "regional_demand_index",
                neighbour: str = "neighbor_demand_avg") -> DataFrame:
    """Mean of the components a series has, each divided by its maximum.

    A component that is missing for the whole series is left out; a missing value of a present
    component makes the mean missing.
    """
    df = stored(df)
    tops = df.groupBy(*panel.keys).agg(F.max(regional).alias("_r"), F.max(neighbour).alias("_n"))
    parts = [(F.col(regional), F.col("_r")), (F.col(neighbour), F.col("_n"))]
    total, used = F.lit(0.0), F.lit(0)
    for value, top in parts:
        total = total + F.when(top.isNull(), F.lit(0.0)).otherwise(F.try_divide(value, top))
        used = used + top.isNotNull().cast("int")
    out = df.join(small(materialize(tops)), list(panel.keys), "left")
    return out.withColumn("grid_stress_index", F.try_divide(total, used)).drop("_r", "_n")
