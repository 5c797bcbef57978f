"""Session settings, intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings every job here relies on; all are runtime SQL settings.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Parquet files written by pandas may hold nanoseconds, which are read as numbers.
    "spark.sql.legacy.parquet.nanosAsLong": "true",
}

#: Dimension tables up to this many rows may be broadcast.
BROADCAST_ROWS = 50_000


#: Temporary folders of local sessions that name no shared folder.
_LOCAL_ROOTS: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  settings: dict[str, str] | None = None) -> SparkSession:
    """A session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


#: Applications whose workers have the package.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, which may be started without it; once for each application.

    The archive is made in a folder of the driver, and Spark itself serves it to the executors.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="panelspark-")
        packed = shutil.make_archive(os.path.join(folder, "panelspark"), "zip", os.path.dirname(here), os.path.basename(here))
        spark.sparkContext.addPyFile(packed)
        _SHIPPED.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for local sessions that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="panelspark-")
    return _LOCAL_ROOTS[app]


def materialize(df: DataFrame, partition_by: tuple[str, ...] = (), codec: str | None = None) -> DataFrame:
    """Cut the lineage by writing ``df`` as Parquet in the shared folder and reading it back.

    Used where one frame feeds several jobs (model folds, refits). A written table survives the loss
    of executors and keeps column pruning and filter push-down, which a cached frame does not.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if codec:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._is_stored, table._stored_at = True, path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote here, once no plan reads them any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a written table, else its written form.

    Operators that read their input more than once call this first. Without it Spark would run the whole
    plan behind ``df`` again for every use, down to the scan of the raw data.
    """
    return df if getattr(df, "_is_stored", False) else materialize(df)


def small(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``dim`` only after counting that it stays below ``max_rows``.

    The count reads at most ``max_rows + 1`` rows. A larger table is returned without a hint, so the
    join becomes a shuffled one.
    """
    if dim.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(dim)
    return dim
