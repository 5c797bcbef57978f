"""The events table as a file stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.upsert import merge_rows, upsert_table
from panelspark.queries import adapters as a
from panelspark.queries.adapters import r, tidy
from panelspark.session import checkpoint_root
from panelspark.streaming import ingest


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The table as a stream of files; a table of many files is a folder."""
    reader = spark.readStream.schema(a.table(spark, d, "events").schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{d}/events.parquet")
    return reader.option("pathGlobFilter", "events.parquet").parquet(d)


def _place(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Every batch of events is merged by type and hour: the last value replaces, the first user stays."""
    stream, place = _stream(spark, d), _place(spark)
    key = ["respondent", "period"]

    def load(batch: DataFrame, _no: int) -> None:
        rows = batch.select(F.col("event_type").alias("respondent"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("period"),
                            "value", F.col("user_id").alias("respondent_name"), "event_id")
        latest = merge_rows(rows, key, "event_id", ["value"], ["respondent_name"]).withColumn("day", F.date_format("period", "yyyyMMdd").cast("int"))
        upsert_table(batch.sparkSession, f"{place}/table", latest, [*key, "day"], ["day"], ["value"], ["respondent_name"])

    query = stream.writeStream.foreachBatch(load).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return tidy(spark.read.parquet(f"{place}/table").drop("day"))


STREAM_INGEST = f"""SELECT event_type AS respondent, date_trunc('hour', ts) AS period, {r('arg_max(value, event_id)')} AS value,
  arg_min(user_id, event_id) AS respondent_name FROM events GROUP BY 1, 2"""


def stream_deduplicate(spark: SparkSession, d: str) -> DataFrame:
    """One row per type and hour from the stream, de-duplicated within the watermark."""
    hours = _stream(spark, d).select(F.col("event_type").alias("respondent"), F.date_trunc("hour", "ts").alias("period"))
    once, place = ingest.deduplicate(hours, ["respondent", "period"], "period"), _place(spark)
    query = once.writeStream.format("parquet").option("path", f"{place}/table").option(
        "checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return tidy(spark.read.parquet(f"{place}/table"))


STREAM_DEDUPLICATE = "SELECT DISTINCT event_type AS respondent, date_trunc('hour', ts) AS period FROM events"


QUERIES = {
    "stream_ingest": (stream_ingest, STREAM_INGEST),
    "stream_deduplicate": (stream_deduplicate, STREAM_DEDUPLICATE),
}
