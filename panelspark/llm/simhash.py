"""Operator 4: SimHash fingerprints and their groups by Golay-code fuzzy hashing.

A fingerprint bit is set if it is set in over half of the hashes of a document's word shingles. Fingerprints link at two or fewer
differing bits. The 64 bits are three segments. Two errors leave one segment clean, and the segment after it has at most two errors; so
linked fingerprints share one of at most 18 keys: a clean segment together with a Golay key (``golay``) of the next. Only distinct
fingerprints take part, copies meet them at the end.

A key shared by few fingerprints has its members compared in one task. For a key shared by many, all pairs would be too much: there
every member gives the fingerprints within one bit outside the clean segment. Two members link exactly if they have one of these in common, and at
most 65 fingerprints can have the same one, so the links of a group grow with its members and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import golay
from panelspark.llm.common import lowered_words, record_batch, row_columns, texts, with_row
from panelspark.llm.components import components
from panelspark.session import materialize

SEED = 42
#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BITS = 2
#: Members of a key up to which they are compared pair by pair. Beyond it links are found through shared neighbours; both ways are exact.
COMPARED = 32


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The fingerprint of a text; zero without words."""
    counts, n, tail = np.zeros(64, dtype=np.int64), 0, []
    for part in lowered_words(text or b""):
        part = tail + part
        if len(part) >= words:
            found = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*[part[i:] for i in range(words)], strict=False))]
            hashes = np.array(found, dtype="<u8")
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(found)
            part = part[1 - words:] if words > 1 else []
        tail = part
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """``documents`` with ``fp`` (signed 64-bit) in place of ``text``; the other columns stay."""
    kept = [c for c in documents.columns if c != "text"]
    schema = T.StructType([*(documents.schema[c] for c in kept), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in texts(batch)], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found)], names=[*kept, "fp"])

    return documents.mapInArrow(run, schema)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints and the place of the fingerprint of each key."""
    parts = [(fps >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    keys, place = [], []
    for i in range(3):
        codes = golay.keys(parts[(i + 1) % 3])
        row, column = np.nonzero(codes >= 0)
        keys.append(np.int64(i) << 34 | parts[i][row] << 12 | codes[row, column])
        place.append(row)
    return np.concatenate(keys), np.concatenate(place)


def _keyed(distinct: DataFrame) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            keys, place = fuzzy_keys(fps.view(np.uint64))
            yield record_batch(schema, {"key": keys, "fp": fps[place]})

    return distinct.mapInArrow(run, "key long, fp long")


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(groups: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column("fps").to_pylist():
                fps = np.array(members, dtype=np.int64)
                i, j = np.triu_indices(len(fps), 1)
                near = np.bitwise_count((fps[i] ^ fps[j]).view(np.uint64)) <= BITS
                a.append(np.minimum(fps[i], fps[j])[near])
                b.append(np.maximum(fps[i], fps[j])[near])
            if a:
                yield record_batch(_EDGE, {"a": np.concatenate(a), "b": np.concatenate(b)})

    return groups.select("fps").mapInArrow(run, "a long, b long")


def _through_neighbours(members: DataFrame) -> DataFrame:
    """Links of (clean segment, fingerprint) rows through fingerprints within one bit of both."""
    schema = pa.schema([("middle", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            clean = batch.column("clean").to_numpy(zero_copy_only=False)
            for i, (first, width) in enumerate(SEGMENTS):
                own = fps[clean == i]
                flips = np.array([0, *(1 << b for b in range(64) if not first <= b < first + width)], dtype=np.uint64).view(np.int64)
                middle = own[:, None] ^ flips
                yield record_batch(schema, {"middle": middle.reshape(-1), "fp": np.repeat(own, len(flips))})

    around = members.mapInArrow(run, "middle long, fp long")
    met = around.groupBy("middle").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select("a", F.explode("fps").alias("b")).where("a <> b")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of ``distinct`` (column ``fp``, no repeats) within two bits of each other."""
    keyed = materialize(_keyed(distinct))
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = materialize(keyed.join(sizes, "key"))
    few = shared.where(F.col("n") <= COMPARED).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    many = shared.where(F.col("n") > COMPARED).select(F.shiftright("key", 34).cast("int").alias("clean"), "fp").distinct()
    return _compare(few).union(_through_neighbours(many)).distinct()


def groups(fps: DataFrame) -> DataFrame:
    """``fps`` (columns ``doc_id``, ``fp`` and any others) with ``component_id``, the smallest ``doc_id`` reachable over links.

    A null ``doc_id`` takes part, but is the id of no component; a component of nulls only has a null id.
    """
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct.select("fp")))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(placed.join(lows, "root").select("fp", "component_id"))
    return fps.join(named, "fp")


def near_duplicates(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``documents`` (columns doc_id, text; others are ignored).

    A null text and a text without words have fingerprint zero and link like any other; a text of fewer than ``words`` words is one
    shingle. Repeated rows each give a row. An empty table gives no row.
    """
    fps = materialize(fingerprints(documents.select(F.col("doc_id").cast("long"), "text"), words))
    return groups(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(documents: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``documents`` that stay: of each group the one with the smallest ``doc_id`` (nulls last), all columns kept.

    Of rows that share an id and differ in text the one with the smaller hash of the text stays, of rows that share both the one whose other columns are smaller as text.
    Columns other than doc_id and text may have any name.
    """
    key = {"no_id": F.col("doc_id").isNull(), "number": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "kind": F.xxhash64("text")}
    keyed = with_row(documents, **key)
    fps = materialize(fingerprints(keyed.select(F.when(~F.col("no_id"), F.col("number")).alias("doc_id"), *key, "_row.text"), words))
    group = (F.coalesce("component_id", F.lit(0)).alias("component"), F.col("component_id").isNull().alias("nameless"))
    first = groups(fps).groupBy(*group).agg(F.min(F.struct(*key)).alias("m")).select("m.*")
    # the kept rows grow with the documents, so the join is a shuffled one at every size
    kept = keyed.join(first.hint("merge"), list(key), "left_semi")
    # rows alike in id and text are told apart by the other columns, as text, since maps have no order
    others = [F.col(f"_row.`{c}`") for c in documents.columns if c not in ("doc_id", "text")]
    alike = Window.partitionBy(*key).orderBy(F.struct(*others, F.lit(0)).cast("string"))
    return row_columns(kept.withColumn("place", F.row_number().over(alike)).where("place = 1"))
