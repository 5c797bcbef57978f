"""Raw CSV files named ``{code}_{start}_{end}_{endpoint}.csv``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.nulls import nan_to_null

PERIOD_FORMAT = "yyyy-MM-dd'T'HH"

# Endpoints, most specific name first, with their columns in file order. Everything is read as text.
ENDPOINTS: dict[str, tuple[str, ...]] = {
    "region-sub-ba-data": ("period", "subba", "subba-name", "parent", "value"),
    "fuel-type-data": ("period", "respondent", "respondent-name", "fueltype", "type-name", "value", "value-units"),
    "interchange-data": ("period", "fromba", "fromba-name", "toba", "toba-name", "value", "value-units"),
    "region-data": ("period", "respondent", "respondent-name", "type", "type-name", "value", "value-units"),
}
# Column that holds the region code of an endpoint.
CODE_COLUMN = {
    "region-sub-ba-data": "parent", "fuel-type-data": "respondent", "interchange-data": "fromba",
    "region-data": "respondent",
}
# Unique key of the clean table of an endpoint.
KEYS = {
    "region-sub-ba-data": ("period", "subba"), "fuel-type-data": ("period", "respondent", "fueltype"),
    "interchange-data": ("period", "fromba", "toba"), "region-data": ("period", "respondent", "type"),
}
# Names in the files and in our tables.
RENAMES = {
    "respondent-name": "respondent_name", "type-name": "type_name", "fromba-name": "fromba_name",
    "toba-name": "toba_name", "subba-name": "subba_name",
}


def endpoint_of(file_name: Column) -> Column:
    """Endpoint contained in a file name; fails the job if there is none."""
    name = F.lower(file_name)
    out = None
    for ep in ENDPOINTS:
        hit = F.contains(name, F.lit(ep))
        out = F.when(hit, F.lit(ep)) if out is None else out.when(hit, F.lit(ep))
    return out.otherwise(F.raise_error(F.concat(F.lit("Cannot detect endpoint from filename: "), file_name)))


def code_of(file_name: Column) -> Column:
    """Region code before the first underscore."""
    return F.split_part(file_name, F.lit("_"), F.lit(1))


def read_files(spark: SparkSession, path: str, endpoint: str, columns: tuple[str, ...] | None = None, names: str = "*.csv") -> DataFrame:
    """Files of one endpoint below ``path``, as text, with their origin and an order to break ties.

    Column names are checked against the header of each file.
    """
    schema = ", ".join(f"`{n}` string" for n in columns or ENDPOINTS[endpoint])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    df = reader.option("pathGlobFilter", names).csv(path)
    return df.select(
        "*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("_block_start"),
        F.monotonically_increasing_id().alias("_row"), F.col("_metadata.file_modification_time").alias("_modified"))


def read_raw(spark: SparkSession, path: str, endpoint: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """All files of one endpoint in a folder; endpoint and region code are read from their names."""
    file = F.col("source_file")
    return read_files(spark, path, endpoint, columns, f"*{endpoint}*.csv").withColumns({"endpoint": endpoint_of(file), "file_code": code_of(file)})


#: Order in which "first" is meant for duplicate periods.
READ_ORDER = ["source_file", "_block_start", "_row"]


def parse_raw(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows). A period that cannot be read rejects the row, a bad value becomes NULL."""
    parsed = df.withColumns({
        "_period": F.try_to_timestamp("period", F.lit(PERIOD_FORMAT)).cast("timestamp_ntz"),
        "value": nan_to_null(F.expr("try_cast(value AS double)")),
    })
    good = parsed.where("_period IS NOT NULL").withColumn("period", F.col("_period")).drop("_period")
    return good, parsed.where("_period IS NULL").drop("_period")


def table_columns(df: DataFrame, endpoint: str) -> DataFrame:
    """Names of the clean table; columns a file lacks are left out."""
    wanted = [RENAMES.get(c, c) for c in ENDPOINTS[endpoint] if c != "value-units"]
    renamed = df.withColumnsRenamed(RENAMES).withColumnRenamed("value", "value_mwh")
    return renamed.select(*[c for c in (*wanted, "value_mwh", "is_imputed", "is_anomaly") if c in renamed.columns])


def save_raw(df: DataFrame, path: str, key: str = "respondent", ts: str = "period") -> str:
    """Write CSV per region below ``path/{first}_{last}``; an empty frame is an error."""
    span = df.agg(F.date_format(F.min(ts), "yyyyMMdd"), F.date_format(F.max(ts), "yyyyMMdd")).first()
    if span[0] is None:
        raise ValueError("nothing to save: the frame is empty")
    target = f"{path.rstrip('/')}/{span[0]}_{span[1]}"
    df.write.mode("overwrite").partitionBy(key).option("header", True).csv(target)
    return target


def load_raw(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read what ``save_raw`` wrote; ``schema`` includes the partition column."""
    return spark.read.schema(schema).option("header", True).csv(path)
