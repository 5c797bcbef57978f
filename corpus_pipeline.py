"""From raw documents to packed training windows: five stages, each written as Parquet and read by the next.

A stage works on all that its predecessor kept. All but the last return the columns of ``documents``, with extra columns if there are any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import decontamination, language_id, line_dedup, packing, simhash
from panelspark.llm.common import bounded_batches, table
from panelspark.session import materialize, ship


def _ready(spark: SparkSession) -> None:
    ship(spark)
    bounded_batches(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    _ready(spark)
    return language_id.determined(docs)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat an earlier one."""
    _ready(spark)
    return line_dedup.deduplicate(docs).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of SimHash near duplicates: three-word shingles, two bits at most."""
    _ready(spark)
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark phrases."""
    _ready(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their ids, in windows of 1024 tokens."""
    _ready(spark)
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("line_dedup", delete_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: The stages learn, align and loop; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
