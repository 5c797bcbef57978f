"""Raw files as a stream: resumable ingest, upserts, de-duplication and running forecast errors.

A checkpointed file source remembers which files were loaded, so a restart continues where the last run
stopped. Every batch is merged by key, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelspark.functions.nulls import nan_to_null
from panelspark.plans.ingest import load
from panelspark.sources import raw_csv


def read_stream(spark: SparkSession, path: str, endpoint: str, files_per_batch: int = 1000) -> DataFrame:
    """New files of one endpoint, as text with their origin."""
    schema = ", ".join(f"`{n}` string" for n in raw_csv.ENDPOINTS[endpoint])
    reader = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
    reader = reader.option("pathGlobFilter", f"*{endpoint}*.csv").option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(path).select(
        "*", F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("_modified"),
        F.col("_metadata.file_block_start").alias("_block_start"))


def load_batch(spark: SparkSession, batch: DataFrame, endpoint: str, table: str, log: str | None = None) -> None:
    """Clean one batch, merge it into the table and write its log rows (also for a failed batch)."""
    load(spark, batch.withColumn("_row", F.monotonically_increasing_id()), endpoint, table, log)


def ingest(spark: SparkSession, path: str, endpoint: str, table: str, checkpoint: str,
           log: str | None = None) -> StreamingQuery:
    """Load all files that have not been loaded yet, then stop."""
    def load(batch: DataFrame, _batch_no: int) -> None:
        load_batch(batch.sparkSession, batch, endpoint, table, log)

    stream = read_stream(spark, path, endpoint)
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicate(stream: DataFrame, keys: list[str], ts: str, delay: str = "7 days") -> DataFrame:
    """First row per key; state is dropped once the watermark has passed."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def running_rmse(stream: DataFrame, keys: list[str], ts: str, target: str, prediction: str, width: str = "7 days",
                 slide: str = "1 day", delay: str = "2 days") -> DataFrame:
    """RMSE per key over a sliding window of a stream of scored rows."""
    error: Column = nan_to_null(F.col(target) - F.col(prediction))
    return stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width, slide)).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.count(error).alias("n_rows"))


def drift_alerts(windows: DataFrame, train_rmse: DataFrame, keys: list[str], limit: float = 0.15) -> DataFrame:
    """Windows whose RMSE exceeds the training RMSE by more than ``limit`` (stream-static join)."""
    joined = windows.join(train_rmse, keys)
    drift = F.try_divide(F.col("rmse") - F.col("train_rmse"), F.col("train_rmse"))
    return joined.withColumn("drift", drift).where(F.col("drift") > limit)
