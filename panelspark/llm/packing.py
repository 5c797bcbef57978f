"""Operator 10: documents packed into windows by Karmarkar-Karp multiway differencing.

A document gives as many full windows as it can; its rest is cut into pieces of ``piece`` tokens and what is left after those into halves, down to
``least`` tokens, since small pieces let differencing even out the large ones. Pieces are gathered into groups of almost ``group`` windows. Differencing merges partial partitions of a group: the two with the largest
imbalance are joined so that the large sums of one meet the small sums of the other. The windows come out nearly equal;
whenever one exceeds the capacity, the group is differenced again into one window more. A full group lacks ``spare``
tokens a window, about what differencing leaves uneven, so it seldom takes another try.
No data are exchanged between tasks: a task packs the documents it reads.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import record_batch, texts, values
from panelspark.llm.tokens import BYTE_BPE, Vocabulary, encoder

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids binary")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def difference(sizes: list[int], k: int) -> list[int]:
    """The window of each piece by Karmarkar-Karp differencing into ``k`` windows.

    A partial partition holds its ``k`` sums in falling order, less the smallest. Merges are kept as a tree, and windows
    are handed down from its root. Ties are broken by age, so equal input gives equal output.
    """
    first = np.zeros((len(sizes), k), dtype=np.int64)
    first[:, 0] = sizes
    heap = [(-int(s), i, first[i]) for i, s in enumerate(sizes)] if k > 1 else []
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a, large = heapq.heappop(heap)
        _, b, other = heapq.heappop(heap)
        sums = large + other[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(sums[0]), len(sizes) + len(merges) - 1, sums))
    if not merges:
        return [0] * len(sizes)
    windows: list = [None] * (len(sizes) + len(merges))
    windows[-1] = np.arange(k)
    for node in range(len(windows) - 1, len(sizes) - 1, -1):
        a, b, order = merges[node - len(sizes)]
        mine = np.empty(k, dtype=np.int64)
        mine[order] = windows[node]
        windows[node], windows[a], windows[b] = None, mine, mine[::-1]
    return [int(w[0]) for w in windows[:len(sizes)]]


def balanced(sizes: list[int], capacity: int) -> list[int]:
    """The window of each piece; as few windows as differencing fits into ``capacity``."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        chosen = difference(sizes, k)
        if np.bincount(chosen, weights=sizes, minlength=k).max(initial=0) <= capacity:
            return chosen
        k += 1


class _Packer:
    """Gathers the pieces of one task and gives out packed rows."""

    def __init__(self, capacity: int, piece: int, least: int, group: int, spare: int, with_ids: bool, first: int):
        self.capacity, self.piece, self.least, self.with_ids, self.next = capacity, piece, least, with_ids, first
        self.full_group = group * (capacity - spare)
        self.waiting: list[tuple] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def _row(self, piece: tuple, sequence: int, offset: int) -> None:
        doc_id, start, ids, total = piece
        self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset,
                          bytes(ids) if self.with_ids else None))

    def document(self, doc_id: int | None, ids: bytes) -> None:
        view, total = memoryview(ids), len(ids) // 4
        rest = total - total % self.capacity
        for start in range(0, rest, self.capacity):
            self._row((doc_id, start, view[4 * start:4 * (start + self.capacity)], total), self.next, 0)
            self.next += 1
        while rest < total:
            left = total - rest
            length = self.piece if left >= self.piece else left - left // 2 if left > self.least else left
            length = min(length, self.full_group - self.tokens)
            self.waiting.append((doc_id, rest, view[4 * rest:4 * (rest + length)], total))
            rest, self.tokens = rest + length, self.tokens + length
            if self.tokens == self.full_group:
                self.close()

    def close(self) -> None:
        if not self.waiting:
            return
        chosen = balanced([len(p[2]) // 4 for p in self.waiting], self.capacity)
        number: dict[int, int] = {}
        filled: dict[int, int] = {}
        for piece, window in zip(self.waiting, chosen, strict=True):
            sequence = number.setdefault(window, self.next + len(number))
            self._row(piece, sequence, filled.get(window, 0))
            filled[window] = filled.get(window, 0) + len(piece[2]) // 4
        self.next += len(number)
        self.waiting, self.tokens = [], 0

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return record_batch(_ARROW, {f.name: [r[i] for r in rows] for i, f in enumerate(_ARROW)})


def pack(documents: DataFrame, vocabulary: Vocabulary = BYTE_BPE, capacity: int = 1024, piece: int = 256, least: int = 64,
         group: int = 64, spare: int = 5, with_ids: bool = True) -> DataFrame:
    """Rows of pieces: document, place in it, ids, sequence and place in the sequence.

    Needs the columns ``doc_id`` and ``text``; others are ignored. A null or empty text is a document with only the end id.
    Repeated rows are packed one by one, a null ``doc_id`` is kept, an empty table gives no row. A sequence shorter than
    ``capacity`` is to be padded by the reader. Sequence ids rise within a task and are unique.
    """
    if not 0 < piece <= capacity or group < 1 or least < 1 or not 0 <= spare < capacity:
        raise ValueError("piece must be between 1 and capacity, group and least at least 1, spare below capacity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).document
        packer = _Packer(capacity, piece, least, group, spare, with_ids, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for doc_id, text in zip(values(batch, "doc_id"), texts(batch), strict=True):
                packer.document(doc_id, encode(text))
                if len(packer.rows) >= 4096:
                    yield packer.take()
        packer.close()
        yield packer.take()

    packed = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
    return packed if with_ids else packed.drop("ids")
