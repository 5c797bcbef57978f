"""Registered queries of the operators: name -> (Spark function, SQL text or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import conversation_trie, decontamination, language_id, language_model, line_dedup, oracles, packing, quality, secrets, sharding, simhash, substring_dedup, token_files, whitening
from panelspark.llm.common import bounded_batches, run_folder, table
from panelspark.session import ship

#: Shards of the registered query.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    bounded_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language_id.identify(_documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    return quality.cascade(_documents(spark, sf_dir)).drop("rejected_by")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = run_folder(spark)
    token_files.write(_documents(spark, sf_dir), path)
    return token_files.digest(token_files.read(spark, path))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontamination.digest(decontamination.judge(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.assign(_documents(spark, sf_dir).select("doc_id"), "doc_id", SHARDS).select("_row.doc_id", "slot", "shard", "shard_name")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that repeat an earlier one."""
    return line_dedup.deduplicate(_documents(spark, sf_dir)).select("_row.doc_id", "_row.text", "n_lines", "n_deleted")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in all documents with the forest's verdict."""
    return secrets.scan(_documents(spark, sf_dir))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based score of every document."""
    return language_model.perplexity_scores(_documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens."""
    return packing.pack(_documents(spark, sf_dir), with_ids=False)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    ship(spark)
    bounded_batches(spark)
    return conversation_trie.nodes(table(spark, sf_dir, "conversations")).drop("path")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the runs of 13 words that an earlier one holds."""
    left = substring_dedup.deduplicate(_documents(spark, sf_dir))
    return left.select("_row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four whitening components."""
    ship(spark)
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


#: The other methods cannot be put as SQL over the tables (learned models, hashes, files, fixed-point loops); tests compare
#: them with brute force, exact round trips and held-out accuracy.
SQL = {"op2_quality_rules": oracles.QUALITY, "op5_decontamination": oracles.DECONTAMINATION}
QUERIES = {f.__name__: (f, SQL.get(f.__name__)) for f in (
    op1_language_id, op2_quality_rules, op3_token_files, op4_simhash, op5_decontamination, op6_sharding, op7_line_dedup, op8_secret_scan,
    op9_language_model, op10_packing,
    op11_conversation_trie, op12_substring_dedup, op13_whitening)}
