"""Operator 3: token files with frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank in the frequencies of the whole corpus, so that common tokens take one byte. Four ranks share a control byte with
the number of bytes of each, two bits a rank; the data bytes are stored apart from the control bytes, so decoding is a table
lookup and one gather. A file is Parquet, written by Spark's committer: a lost executor or a repeated attempt
leaves no torn file, and any store that Spark reaches will do. Its rows are blocks of whole documents, in rising ``doc_id``.

    <path>/plain    the same blocks with plain ids, read for the frequencies
    <path>/blocks   shard, block, start (ids before it in the shard), doc_ids, lengths, control, data
    <path>/ranks    rank, id, n
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import record_batch, texts, values
from panelspark.llm.tokens import WORD_BPE, Vocabulary, encoder

#: Ids in a block, but for one document that is longer.
BLOCK = 1 << 15

_BYTE = np.arange(256, dtype=np.uint8)
#: Bytes of each of the four ranks of a control byte.
LENGTHS = np.stack([(_BYTE >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1)
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)
_SHIFT = np.array([0, 2, 4, 6], dtype=np.uint8)

_BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()),
                     ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                     ("control", pa.binary()), ("data", pa.binary())])
_PLAIN = pa.schema([*list(_BLOCKS)[:5], ("ids", pa.binary())])
_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
_PLAIN_DDL = "shard int, block int, start long, doc_ids array<long>, lengths array<long>, ids binary"
_BLOCKS_DDL = "shard int, block int, start long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.zeros((-(-len(ranks) // 4), 4), dtype=np.uint8)
    quads.reshape(-1)[:len(ranks)] = extra
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return np.bitwise_or.reduce(quads << _SHIFT, axis=1).astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    four = padded[(ends - lengths)[:, None] + np.arange(4)]
    return four.view("<u4").reshape(-1) & _MASK[lengths]


def _blocks(ordered: DataFrame, vocabulary: Vocabulary, block: int) -> DataFrame:
    """Blocks of plain ids from documents in order; a partition is a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(vocabulary).document, TaskContext.get().partitionId()
        docs: list = []
        held: list[bytes] = []
        number = start = size = 0

        def closed() -> pa.RecordBatch:
            ids = b"".join(held)
            if vocabulary.narrow:
                ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
            return record_batch(_PLAIN, {"shard": [shard], "block": [number], "start": [start], "doc_ids": [docs],
                                         "lengths": [[len(x) // 4 for x in held]], "ids": [ids]})

        for batch in batches:
            for doc_id, text in zip(values(batch, "doc_id"), texts(batch), strict=True):
                ids = encode(text)
                if docs and size + len(ids) // 4 > block:
                    yield closed()
                    number, start, size, docs, held = number + 1, start + size, 0, [], []
                docs.append(doc_id)
                held.append(ids)
                size += len(ids) // 4
        if docs:
            yield closed()

    return ordered.mapInArrow(run, _PLAIN_DDL)


def _frequencies(blocks: DataFrame, kind: str) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids in values(batch, "ids"):
                found = np.bincount(np.frombuffer(ids, kind))
                if len(found) > len(total):
                    found, total = total, found
                total[:len(found)] += found
        used = np.flatnonzero(total)
        yield record_batch(schema, {"id": used, "n": total[used]})

    return blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(documents: DataFrame, path: str, vocabulary: Vocabulary = WORD_BPE, block: int = BLOCK) -> None:
    """Write the token files of ``documents`` (columns ``doc_id`` and ``text``; others are ignored) below ``path``.

    A null or empty text is a document with only the end id. A null ``doc_id`` comes first; rows that share an id are
    ordered by their text. An empty table gives files without rows. The frequencies sent to the driver are bounded by the vocabulary.
    """
    spark = documents.sparkSession
    kind = "<u2" if vocabulary.narrow else "<u4"
    ordered = (documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
               .sortWithinPartitions("doc_id", "text"))
    _blocks(ordered, vocabulary, block).write.option("compression", "zstd").parquet(f"{path}/plain")
    plain = spark.read.schema(_PLAIN_DDL).parquet(f"{path}/plain")
    counts = sorted((-r.n, r.id) for r in _frequencies(plain, kind).collect())
    ranks = [(rank, i, -n) for rank, (n, i) in enumerate(counts)]
    spark.createDataFrame(ranks, "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(1 + max((i for _, i in counts), default=0), dtype="<u4")
    rank_of[[i for _, i in counts]] = np.arange(len(counts))
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [encode_ranks(shared.value[np.frombuffer(ids, kind)]) for ids in values(batch, "ids")]
            kept = [batch.column(f.name) for f in _BLOCKS if f.name in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())],
                                             names=[f.name for f in _BLOCKS])

    plain.mapInArrow(run, _BLOCKS_DDL).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit)."""
    blocks = spark.read.schema(_BLOCKS_DDL).parquet(f"{path}/blocks")
    ids = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], dtype="<u4")
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    shards = blocks.groupBy("shard").agg(F.sum(length).alias("n")).orderBy("shard").collect()
    before, total = {}, 0
    for r in shards:
        before[r.shard], total = total, total + r.n
    shared = spark.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum(row["lengths"])
                found = shared.value[decode_ranks(row["control"], row["data"], int(ends[-1]))]
                starts = ends - row["lengths"]
                yield record_batch(_DOCUMENTS, {
                    "doc_id": row["doc_ids"], "start": starts + (before[row["shard"]] + row["start"]),
                    "ids": [found[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]})

    return blocks.mapInArrow(run, "doc_id long, start long, ids binary")


def digest(documents: DataFrame) -> DataFrame:
    """What is checked of ``read``: place, number and CRC-32 of the ids of every document."""
    return documents.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                            F.crc32("ids").alias("ids_crc32"))
