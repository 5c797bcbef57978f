"""Helpers shared by the operators: reading tables, words of a text, Arrow batches and row keys.

A word is a maximal run of bytes other than ASCII white space, which is what ``bytes.split()`` gives; all
texts are handled as UTF-8, so that no character outside ASCII is ever split.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import checkpoint_root

#: Bytes of text handled at once inside a task; a longer text is cut at white space.
SLICE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows: whole texts may be long, and Spark bounds a batch by rows only."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def run_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_root(spark)}/run-{uuid.uuid4().hex}"


def in_fold(doc_id: str, folds: int, rest: int) -> Column:
    """True where the CRC-32 of the id as text leaves ``rest``; a null id belongs to no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds)) == rest, F.lit(False))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def slices(data: bytes, size: int = SLICE) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes, cut before white space so that no word is split."""
    start = 0
    while len(data) - start > size:
        cut = _SPACE.search(data, start + size)
        if cut is None:
            break
        yield data[start:cut.start()]
        start = cut.start()
    yield data[start:] if start else data


def lowered_words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text with A-Z in lower case, in lists of bounded length."""
    for part in slices(data):
        yield part.lower().split()


def record_batch(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def with_row(df: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` beside the whole input row, kept as one struct, so that no input name can clash with ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                     *[value.alias(name) for name, value in columns.items()])


def row_columns(df: DataFrame) -> DataFrame:
    """The input columns of a frame made by ``with_row``."""
    return df.select("_row.*")
