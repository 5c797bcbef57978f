"""Net flow per region from directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def net_interchange(edges: DataFrame, source: str = "fromba", target: str = "toba", value: str = "value",
                    ts: str = "period", key: str = "respondent") -> DataFrame:
    """Exports, imports and exports - imports per region and time; a missing side counts as 0.

    Every edge is turned into one row for each end, so both sums come from one scan and one aggregate.
    """
    v = F.coalesce(F.col(value), F.lit(0.0))
    ends = F.array(
        F.struct(F.col(source).alias(key), v.alias("_out"), F.lit(0.0).alias("_in")),
        F.struct(F.col(target).alias(key), F.lit(0.0).alias("_out"), v.alias("_in")),
    )
    return edges.select(ts, F.inline(ends)).groupBy(key, ts).agg(
        F.sum("_out").alias("exports"), F.sum("_in").alias("imports")
    ).withColumn("net_interchange", F.col("exports") - F.col("imports"))
