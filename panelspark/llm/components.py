"""Connected components of an edge table as a loop of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node in ``edges`` (columns a and b, long).

    A round takes the smallest root among the neighbours and then the root of that root, so long chains shorten by
    half. Every round is written to the shared folder; nothing is collected but the number of changed nodes.
    The smallest node of a component may be the root of very many; the second join meets that as a skewed
    join of two plain tables, which Spark splits.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("root")))
    while True:
        best = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("best")))
        near = materialize(labels.join(best, "node").select("node", F.least("root", "best").alias("root")))
        up = near.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = materialize(near.join(up, "root").select("node", F.least("root", "up").alias("root")))
        changed = jumped.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        labels = jumped
        if not changed:
            return labels
