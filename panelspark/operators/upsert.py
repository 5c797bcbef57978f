"""Upsert by key, per-key replace and the ingest log, on partitioned Parquet."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import materialize

LOG_SCHEMA = (
    "run_at timestamp, endpoint string, respondent string, source_file string, rows_raw long, "
    "rows_ingested long, rows_imputed long, rows_anomaly long, status string, error_msg string"
)


def merge_rows(rows: DataFrame, key: list[str], order: str, replace: list[str], keep: list[str] = ()) -> DataFrame:
    """One row per key: ``replace`` columns from the last row in ``order``, ``keep`` from the first."""
    parts = []
    if replace:
        parts.append(F.max_by(F.struct(*replace), F.col(order)).alias("_last"))
    if keep:
        parts.append(F.min_by(F.struct(*keep), F.col(order)).alias("_first"))
    merged = rows.groupBy(*key).agg(*parts)
    return merged.select(
        *key, *[F.col(f"_last.{c}").alias(c) for c in replace], *[F.col(f"_first.{c}").alias(c) for c in keep]
    )


def _touched(base: DataFrame, batch: DataFrame, partition_by: list[str]) -> DataFrame:
    """Rows of the partitions that ``batch`` changes, also of the one whose value is NULL."""
    changed = batch.select(*[F.col(c).alias(f"_changed_{c}") for c in partition_by]).distinct()
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_changed_{c}")) for c in partition_by])
    return base.join(changed, same, "left_semi")


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, key: list[str], partition_by: list[str],
                 replace: list[str], keep: list[str] = (), order: str = "batch_no") -> None:
    """Merge ``batch`` into the table at ``path``; only partitions present in the batch are rewritten."""
    batch = batch.withColumn(order, F.lit(1))
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    rows = batch
    if exists:
        base = spark.read.parquet(path)
        base = _touched(base, batch, partition_by).withColumn(order, F.lit(0))
        rows = base.unionByName(batch.select(*base.columns))
    merged = merge_rows(rows, key, order, list(replace), list(keep))
    merged = materialize(merged) if exists else merged
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def replace_keys(path: str, rows: DataFrame, partition_by: list[str]) -> None:
    """Replace whole partitions (all rows of the keys in ``rows``), leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append_log_rows(rows: DataFrame, path: str) -> None:
    """Append one row per region and file: ``rows`` holds a subset of the log columns."""
    kinds = dict(f.strip().split(" ") for f in LOG_SCHEMA.split(","))
    cols = [
        (F.col(n) if n in rows.columns else F.current_timestamp() if n == "run_at" else F.lit(None)).cast(k).alias(n)
        for n, k in kinds.items()
    ]
    rows.select(*cols).write.mode("append").parquet(path)


def append_log(spark: SparkSession, path: str, **entry) -> None:
    """Append one row to the ingest log."""
    names = [f.strip().split(" ")[0] for f in LOG_SCHEMA.split(",")]
    row = spark.createDataFrame([tuple(entry.get(n) for n in names)], LOG_SCHEMA)
    row.withColumn("run_at", F.coalesce("run_at", F.current_timestamp())).write.mode("append").parquet(path)
