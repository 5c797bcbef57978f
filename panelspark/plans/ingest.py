"""Raw files to the clean table of an endpoint as one plan: for a folder at once, and for every batch of a stream.

Within a file the first row of a key counts, across files the later file. Region data are cleaned: put on a strict grid, filled over
short gaps and flagged, together with the stored hours around the batch, so that a file that ends or starts in the middle of a series gets
the same result as one long file. Rows are merged into the table by key, so loading a file again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators import cleaning
from panelspark.operators.upsert import append_log, append_log_rows, merge_rows, upsert_table
from panelspark.panel import HOUR, Panel
from panelspark.session import materialize, stored
from panelspark.sources import raw_csv

#: Columns whose first value stays when a row is corrected, per endpoint; region rows take the new names.
KEPT_NAMES = {
    "region-data": (), "fuel-type-data": ("respondent_name", "type_name"),
    "interchange-data": ("fromba_name", "toba_name"), "region-sub-ba-data": ("subba_name", "parent"),
}
#: Hours whose fill or flag a batch can change, on either side of it, and hours that are looked at for those.
CHANGED = cleaning.ANOMALY_WINDOW // 2 + cleaning.MAX_GAP
LOOKED_AT = CHANGED + cleaning.ANOMALY_WINDOW // 2 + 2 * cleaning.MAX_GAP
#: What reading a file gives beside its columns: the order of its rows, and of files by age.
ORIGIN = (*raw_csv.READ_ORDER, "_modified")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def unique_rows(raw: DataFrame, endpoint: str) -> DataFrame:
    """Readable rows in the columns of the clean table, one per key."""
    key = list(raw_csv.KEYS[endpoint])
    good, _ = raw_csv.parse_raw(raw)
    first = Window.partitionBy(*key, "source_file").orderBy(*raw_csv.READ_ORDER)
    once = good.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    rows = raw_csv.table_columns(once.withColumn("endpoint", F.lit(endpoint)), endpoint)
    named = once.withColumnsRenamed(raw_csv.RENAMES).withColumnRenamed("value", "value_mwh")
    order = F.struct("_modified", "source_file").alias("_order")
    others = [c for c in rows.columns if c not in key]
    return merge_rows(named.select(*rows.columns, order), key, "_order", others)


def _cleaned(spark: SparkSession, rows: DataFrame, table: str) -> DataFrame:
    """Region rows of the batch and of the stored hours around it, on a grid, filled and flagged."""
    series = ["respondent", "type"]
    panel = Panel(keys=tuple(series), step=HOUR)
    span = materialize(rows.groupBy(*series).agg(F.min("period").alias("_lo"), F.max("period").alias("_hi")))
    names = rows.groupBy(*series).agg(*[F.max_by(c, "period").alias(c) for c in ("respondent_name", "type_name")])
    observed = rows.select(*series, "period", "value_mwh", F.lit(1).alias("_new"))
    if exists(spark, table):
        old = spark.read.parquet(table).where("is_imputed = 0").join(F.broadcast(span) if span.limit(10_001).count() <= 10_000 else span, series)
        near = old.where(F.col("period").between(panel.shift(-LOOKED_AT, F.col("_lo")), panel.shift(LOOKED_AT, F.col("_hi"))))
        observed = observed.unionByName(near.select(*series, "period", "value_mwh", F.lit(0).alias("_new")))
    observed = materialize(merge_rows(observed, [*series, "period"], "_new", ["value_mwh"]))
    clean = cleaning.clean_series(observed, panel, "value_mwh")
    inside = F.col("period").between(panel.shift(-CHANGED, F.col("_lo")), panel.shift(CHANGED, F.col("_hi")))
    return clean.join(span, series).where(inside).join(names, series).select(
        "period", *series, "respondent_name", "type_name", "value_mwh", "is_imputed", "is_anomaly")


def load(spark: SparkSession, raw: DataFrame, endpoint: str, table: str, log: str | None = None) -> None:
    """Clean and merge raw rows (``raw_csv`` columns and ``ORIGIN``) and write a log row per file (one row if the load fails).

    ``rows_raw`` counts the rows with a readable period, ``rows_ingested`` those of the table within the file's own
    extent, of them ``rows_imputed`` and ``rows_anomaly``.
    """
    key, code = list(raw_csv.KEYS[endpoint]), raw_csv.CODE_COLUMN[endpoint]
    try:
        raw = stored(raw)
        rows = materialize(unique_rows(raw, endpoint))
        if endpoint == "region-data":
            rows = materialize(_cleaned(spark, rows, table))
        names = [c for c in rows.columns if c not in key]
        kept = [c for c in KEPT_NAMES[endpoint] if c in names]
        latest = rows.withColumn("month", F.date_format("period", "yyyy-MM"))
        upsert_table(spark, table, latest, [*key, "month"], ["month"], [c for c in names if c not in kept], kept)
        if log:
            good, _ = raw_csv.parse_raw(raw)
            append_log_rows(_log_rows(good, rows, endpoint, code), log)
    except Exception as e:
        if log:
            append_log(spark, log, endpoint=endpoint, status="error", error_msg=str(e))
        raise


def _log_rows(good: DataFrame, rows: DataFrame, endpoint: str, code: str) -> DataFrame:
    files = good.groupBy(F.col(code).alias("respondent"), "source_file").agg(
        F.count(F.lit(1)).alias("rows_raw"), F.min("period").alias("_lo"), F.max("period").alias("_hi"))
    marks = [F.col(c) if c in rows.columns else F.lit(None).cast("int") for c in ("is_imputed", "is_anomaly")]
    written = rows.select(F.col(code).alias("respondent") if code in rows.columns else F.lit(None).alias("respondent"), "period",
                          marks[0].alias("_i"), marks[1].alias("_a"))
    per_hour = written.groupBy("respondent", "period").agg(F.count(F.lit(1)).alias("_n"), F.sum("_i").alias("_i"), F.sum("_a").alias("_a"))
    joined = files.join(per_hour, "respondent", "left").where(F.col("period").isNull() | F.col("period").between(F.col("_lo"), F.col("_hi")))
    counted = joined.groupBy("respondent", "source_file").agg(
        F.max("rows_raw").alias("rows_raw"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_ingested"),
        F.sum("_i").alias("rows_imputed"), F.sum("_a").alias("rows_anomaly"))
    return counted.select("*", F.lit(endpoint).alias("endpoint"), F.lit("success").alias("status"))


def load_folder(spark: SparkSession, path: str, endpoint: str, table: str, log: str | None = None, skip_loaded: bool = False) -> None:
    """Load all files of an endpoint in a folder; with ``skip_loaded`` without the regions that the table already has."""
    raw = raw_csv.read_raw(spark, path, endpoint)
    if skip_loaded and exists(spark, table):
        code = raw_csv.CODE_COLUMN[endpoint]
        have = spark.read.parquet(table).select(code).distinct()
        raw = raw.join(have, code, "left_anti")
    load(spark, raw, endpoint, table, log)
