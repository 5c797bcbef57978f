"""Operator 9: Brown class-based bigram model.

P(w | v) = P(class(w) | class(v)) P(w | class(w)). Every word of the training text has a class by exchange on its bigram counts over the whole
training text. The most frequent words (``core``) are exchanged one after the other on their bigram table; every other word, however rare, starts in a class by
its shape and goes, in Spark, to the class of highest likelihood, if it gains enough to pay for naming that class: first the words that are broadcast
(``frequent``), judged against the core's classes, then all others, judged against the classes of both. Only a word not met in training has no
bigrams to go by; it goes where most words of its shape met once are.

Texts are split once, into chunks of documents with a dictionary each. The vocabulary of the corpus stays a table: the rare words of all chunks meet
their classes in a join and go back to their chunk.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import in_fold, lowered_words, record_batch, texts, values
from panelspark.session import discard, materialize

#: The end of a text as a token; no word holds a space.
END = b" "
#: Classes by shape: digit, or length by ending in a letter by letters outside ASCII.
SHAPES = 17
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Settings:
    """``clustered``: None, or only so many words get a class of their own choice, as core, and all others stay in the class of their shape; ``core``: words exchanged
    on the driver; ``classes``: their number; ``frequent``: words sent to the tasks; ``rounds`` of exchange of the core; ``alpha``: added to transitions."""

    clustered: int | None = None
    classes: int = 48
    frequent: int = 50_000
    rounds: int = 6
    alpha: float = 0.1
    core: int = 1000


def shape(word: bytes) -> int:
    """The shape class of a word."""
    if any(48 <= b <= 57 for b in word):
        return 16
    last = word[-1]
    return min(3, (len(word) - 1) // 4) * 4 + (last in _LETTERS or last >= 128) * 2 + (not word.isascii())


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(bigrams: np.ndarray, n_words: int, classes: int, rounds: int) -> np.ndarray:
    """The class of every unit. ``bigrams``: counts (previous, next) of units; the first ``n_words`` units move, each other one is a class by itself.

    Words start spread over the classes by frequency. A round takes each word out and puts it where the likelihood of the class bigrams is
    highest; it stops when no word moves.
    """
    units = len(bigrams)
    total = classes + units - n_words
    of = np.concatenate([np.arange(n_words) % classes, np.arange(classes, total)])
    one_hot = np.zeros((units, total))
    one_hot[np.arange(units), of] = 1
    right, left = bigrams @ one_hot, bigrams.T @ one_hot  # of a unit: counts of the classes after and before it
    table = one_hot.T @ right
    for _ in range(rounds):
        moved = False
        for w in range(n_words):
            a, self_count = of[w], bigrams[w, w]
            out, into = right[w].copy(), left[w].copy()
            out[a] -= self_count
            into[a] -= self_count
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= self_count
            rows, columns = table[:classes], table[:, :classes].T
            gain = (_xlogx(rows + out) - _xlogx(rows)).sum(axis=1) + (_xlogx(columns + into) - _xlogx(columns)).sum(axis=1)
            d = np.arange(classes)
            corner = table[d, d]
            gain += _xlogx(corner + out[d] + into[d] + self_count) + _xlogx(corner) - _xlogx(corner + out[d]) - _xlogx(corner + into[d])
            n_out, n_in = out.sum() + self_count, into.sum() + self_count
            sums_out, sums_in = rows.sum(axis=1) + into[:classes], columns.sum(axis=1) + out[:classes]
            gain -= _xlogx(sums_out + n_out) - _xlogx(sums_out) + _xlogx(sums_in + n_in) - _xlogx(sums_in)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += out
            table[:, b] += into
            table[b, b] += self_count
            if a != b:
                moved, of[w] = True, b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
        if not moved:
            break
    return of


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


_CHUNKS = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()),
                     ("words", pa.binary()), ("shapes", pa.binary()), ("counts", pa.binary())])
_CHUNKS_DDL = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<long>, ids binary, words binary, shapes binary, counts binary"


def encode(documents: DataFrame, tokens: int = 1 << 20, words: int = 200_000) -> DataFrame:
    """Documents (columns doc_id, text and held_out) as chunks: their tokens, ends included, as numbers of the chunk's ``words``, whose ``counts`` are those of training texts.

    A chunk is closed by the document that brings it to so many tokens or words. The end has number 0 and the shape ``SHAPES`` and is not in
    ``words``, which are joined by spaces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, numbers, parts, size = TaskContext.get().partitionId() << 36, _Numbers({END: 0}), [], 0
        documents: list[tuple[int | None, bool, int]] = []

        def taken() -> pa.RecordBatch:
            doc_ids, held, lengths = zip(*documents, strict=True)
            ids = np.concatenate(parts)
            counts = np.bincount(ids[~np.repeat(held, lengths)], minlength=len(numbers))
            found = list(numbers)[1:]
            shapes = bytes([SHAPES, *map(shape, found)])
            return record_batch(_CHUNKS, {"chunk": [key], "doc_ids": [doc_ids], "held": [held], "lengths": [lengths], "ids": [ids.tobytes()], "words": [b" ".join(found)], "shapes": [shapes],
                                          "counts": [counts.astype(np.int64).tobytes()]})

        for batch in batches:
            for doc_id, held, text in zip(values(batch, "doc_id"), values(batch, "held_out"), texts(batch), strict=True):
                own = [np.fromiter(map(numbers.__getitem__, part), np.int32, len(part)) for part in lowered_words(text or b"")]
                own.append(np.zeros(1, np.int32))
                length = sum(map(len, own))
                parts += own
                documents.append((doc_id, held, length))
                size += length
                if size >= tokens or len(numbers) >= words:
                    yield taken()
                    key, numbers, parts, size = key + 1, _Numbers({END: 0}), [], 0
                    documents.clear()
        if documents:
            yield taken()

    return materialize(documents.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, _CHUNKS_DDL), codec="zstd")


def _numbers(batch: pa.RecordBatch, i: int, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), kind)


def _listed(batch: pa.RecordBatch, i: int, name: str) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def _in_training(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return ~np.repeat(_listed(batch, i, "held").astype(bool), _listed(batch, i, "lengths"))


def _words(batch: pa.RecordBatch, i: int) -> list[bytes]:
    return [END, *batch.column("words")[i].as_py().split()]


def _looked_up(words: list[bytes], of: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(of.get, words, repeat(-1)), np.int64, len(words))


def _units(batch: pa.RecordBatch, i: int, found: np.ndarray, base: int) -> np.ndarray:
    """For each word of a chunk the unit found, else ``base`` and its shape."""
    return np.where(found < 0, base + _numbers(batch, i, "shapes", np.uint8).astype(np.int64), found)


def _counts(chunks: DataFrame) -> DataFrame:
    """word and c of every token of the training texts."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                counts = _numbers(batch, i, "counts", np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_words(batch, i), pa.binary()), pa.array(counts)], schema=schema).filter(pa.array(counts > 0))

    return chunks.select("words", "counts").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _pairs(chunks: DataFrame, units: int, sequences) -> np.ndarray:
    """Counts of neighbouring units in training texts; ``sequences`` gives those of a batch's chunks. The last unit is the end, which is also before the first word."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(units * units, dtype=np.int64)
        for batch in batches:
            for i, sequence in enumerate(sequences(batch)):
                before = np.concatenate([[units - 1], sequence[:-1]])
                total += np.bincount((before * units + sequence)[_in_training(batch, i)], minlength=units * units)
        used = np.flatnonzero(total)
        yield record_batch(schema, {"pair": used, "n": total[used]})

    out = np.zeros(units * units)
    for r in chunks.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.pair] = r.n
    return out.reshape(units, units)


def _bigrams(chunks: DataFrame, unit: dict[bytes, int], base: int) -> np.ndarray:
    """Counts of neighbouring units: those of the words in ``unit``, the shapes of all other words (from ``base``) and the end."""
    shared = chunks.sparkSession.sparkContext.broadcast(unit)
    sequences = lambda batch: (_units(batch, i, _looked_up(_words(batch, i), shared.value), base)[_numbers(batch, i, "ids", np.int32)] for i in range(len(batch)))
    return _pairs(chunks.select("held", "lengths", "ids", "words", "shapes"), base + SHAPES + 1, sequences)


_ENTRY = np.dtype([("code", "<u2"), ("n", "<u4")])
_FOUND = pa.schema([("word", pa.binary()), ("shape", pa.int32()), ("chunk", pa.int64()), ("number", pa.int32()), ("entries", pa.binary())])
_FOUND_DDL = "word binary, shape int, chunk long, number int, entries binary"


def _codes(batch: pa.RecordBatch, i: int, of: np.ndarray, wanted: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the wanted words of training texts, each with codes of its contexts: the class before, the class after (plus ``classes``) or the word itself after it (twice ``classes``)."""
    ids = _numbers(batch, i, "ids", np.int32)
    at = np.flatnonzero(wanted[ids] & _in_training(batch, i))  # the end closes a chunk, so every word has a token after it, and goes before the first one
    word, after, before = ids[at], ids[at + 1], ids[at - 1]
    again, same = before == word, after == word
    twice = np.full(int(same.sum()), 2 * classes)
    return np.concatenate([word[~again], word[~same], word[same]]), np.concatenate([of[before[~again]], classes + of[after[~same]], twice])


def _packed(keys: np.ndarray, counts: np.ndarray, words: np.ndarray, width: int) -> pa.Array:
    """For each of ``words`` the counts of its codes; ``keys``, ascending, are words by ``width`` and codes."""
    entries = np.empty(len(keys), _ENTRY)
    entries["code"], entries["n"] = keys % width, counts
    offsets = np.append(np.searchsorted(keys, words * width), len(keys)).astype(np.int32) * _ENTRY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries.tobytes())])


def _frequent_contexts(chunks: DataFrame, unit: dict[bytes, int], base: int, others: list[bytes]) -> DataFrame:
    """Contexts of ``others``, a bounded list, as counted by each task: ``number`` is the place in the list."""
    classes, number = base + SHAPES + 1, {w: j for j, w in enumerate(others)}
    shared = chunks.sparkSession.sparkContext.broadcast((unit, number, np.array([shape(w) for w in others], np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (unit, number, shapes), width = shared.value, 2 * classes + 1
        total = np.zeros(len(number) * width, np.int32)
        for batch in batches:
            for i in range(len(batch)):
                words = _words(batch, i)
                place = _looked_up(words, number)
                found, codes = _codes(batch, i, _units(batch, i, _looked_up(words, unit), base), place >= 0, classes)
                np.add.at(total, place[found] * width + codes, np.int32(1))
        keys = np.flatnonzero(total)
        words = np.unique(keys // width)
        listed = list(number)
        yield pa.RecordBatch.from_arrays([pa.array([listed[j] for j in words], pa.binary()), pa.array(shapes[words]), pa.array(np.zeros(len(words), np.int64)), pa.array(words.astype(np.int32)),
                                          _packed(keys, total[keys], words, width)], schema=_FOUND)

    return chunks.select("held", "lengths", "ids", "words", "shapes").mapInArrow(run, _FOUND_DDL)


def _rare_contexts(chunks: DataFrame, unit: dict[bytes, int], base: int) -> DataFrame:
    """Contexts of all words without a unit, as counted by each chunk: ``number`` is that of the word in its chunk. Words of held-out texts alone have none."""
    shared, classes = chunks.sparkSession.sparkContext.broadcast(unit), base + SHAPES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * classes + 1
        for batch in batches:
            for i in range(len(batch)):
                words = _words(batch, i)
                own = _looked_up(words, shared.value)
                wanted = own < 0
                wanted[0] = False
                found, codes = _codes(batch, i, _units(batch, i, own, base), wanted, classes)
                kind = np.int32 if len(words) * width < 1 << 31 else np.int64
                keys, n = np.unique(found.astype(kind) * kind(width) + codes.astype(kind), return_counts=True)
                numbers = np.flatnonzero(wanted)
                shapes = _numbers(batch, i, "shapes", np.uint8)[numbers].astype(np.int32)
                chunk = pa.array(np.full(len(numbers), batch.column("chunk")[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([words[j] for j in numbers], pa.binary()), pa.array(shapes), chunk, pa.array(numbers.astype(np.int32)), _packed(keys, n, numbers, width)], schema=_FOUND)

    return chunks.select("chunk", "held", "lengths", "ids", "words", "shapes").mapInArrow(run, _FOUND_DDL)


#: Counts up to this have their gains in a table.
_SMALL = 16


class Gains:
    """What the likelihood of the class bigrams gains where a word comes into a class, by the same sum as ``exchange``, for many words at once.

    ``table``: counts of neighbouring classes, the words judged included; the last class is the end, into which no word comes.
    """

    def __init__(self, table: np.ndarray):
        self.table, self.to = table, len(table) - 1
        self.row_sums, self.column_sums = table.sum(axis=1)[:-1], table.sum(axis=0)[:-1]
        self.cells = {False: table[:, :-1], True: table.T[:, :-1]}  # [neighbour's class, class come into], the word after it and before it
        steps = np.arange(_SMALL + 1)[:, None, None]
        self.small = {after: _xlogx(cells + steps) - _xlogx(cells) for after, cells in self.cells.items()}

    def _sum(self, counts: np.ndarray, after: bool) -> np.ndarray:
        word, a = np.nonzero(counts)
        n = counts[word, a].astype(np.int64)
        out = np.zeros((len(counts), self.to))
        if len(word):
            gain = self.small[after][np.minimum(n, _SMALL), a]
            if len(large := np.flatnonzero(n > _SMALL)):
                cells = self.cells[after][a[large]]
                gain[large] = _xlogx(cells + n[large, None]) - _xlogx(cells)
            present, starts = np.unique(word, return_index=True)
            out[present] = np.add.reduceat(gain, starts, axis=0)
        return out

    def _shifted(self, gain: np.ndarray, cells: np.ndarray, own: np.ndarray, here: np.ndarray, there: np.ndarray) -> None:
        """Where the neighbour's class is the word's own, the cell without the word counts."""
        w, b = np.nonzero((here[np.arange(len(own)), own] > 0)[:, None] & (there[:, :-1] > 0))
        cell, less, more = cells[own[w], b], there[w, b], here[w, own[w]]
        gain[w, b] += _xlogx(cell - less + more) - _xlogx(cell - less) - _xlogx(cell + more) + _xlogx(cell)

    def of(self, own: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """(words, classes): ``own``: the words' present classes; ``contexts``: (words, 2 classes + 1) counts as ``_contexts`` codes them."""
        classes, words = len(self.table), np.arange(len(own))
        into, out, twice = contexts[:, :classes], contexts[:, classes:2 * classes], contexts[:, 2 * classes]
        gain = self._sum(into, False) + self._sum(out, True)
        self._shifted(gain, self.cells[False], own, into, out)
        self._shifted(gain, self.cells[True], own, out, into)
        corner = np.diag(self.table)
        w, b = np.nonzero((into[:, :-1] > 0) & (out[:, :-1] > 0) | (twice > 0)[:, None])
        i, o, cell = into[w, b], out[w, b], corner[b]
        gain[w, b] += _xlogx(cell + i + o + twice[w]) + _xlogx(cell) - _xlogx(cell + i) - _xlogx(cell + o)
        count, which = np.unique(into.sum(axis=1) + twice, return_inverse=True)
        for sums in (self.row_sums, self.column_sums):
            gain -= (_xlogx(sums + count[:, None]) - _xlogx(sums))[which]
        gain[words, own] = self._staying(own, into, out, twice, count[which])
        return gain

    def _staying(self, own: np.ndarray, into: np.ndarray, out: np.ndarray, twice: np.ndarray, count: np.ndarray) -> np.ndarray:
        words, total = np.arange(len(own)), np.zeros(len(own))
        for counts, cells in ((into, self.table.T), (out, self.table)):
            w, a = np.nonzero(counts)
            w, a = w[a != own[w]], a[a != own[w]]
            cell = cells[own[w], a]
            total += np.bincount(w, _xlogx(cell) - _xlogx(cell - counts[w, a]), len(own))
        corner = self.table[own, own]
        total += _xlogx(corner) - _xlogx(corner - into[words, own] - out[words, own] - twice)
        for sums in (self.row_sums[own], self.column_sums[own]):
            total -= _xlogx(sums) - _xlogx(sums - count)
        return total

    def best(self, own: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """The core's class of highest gain; the present one if no other gains more by the logarithm of the number of choices, which is what naming a class costs.

        Many words are judged by the same table, so a class without words is no choice: each would find itself alone there.
        """
        choices = np.flatnonzero(self.row_sums[:self.to - SHAPES] > 0)
        if not len(choices):
            return own
        gain, words = self.of(own, contexts), np.arange(len(own))
        best = choices[gain[:, choices].argmax(axis=1)]
        return np.where(gain[words, best] <= gain[words, own] + math.log(len(choices) + 1), own, best)


_PLACED = pa.schema([("chunk", pa.int64()), ("number", pa.int32()), ("shape", pa.int32()), ("c", pa.int64()), ("class", pa.int32()), ("first", pa.bool_())])


def _runs(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in the order of their words as batches that part no word, with the first row of each word."""
    kept: list[pa.RecordBatch] = []

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        batch = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        words = batch.column("word")
        return batch, np.append(0, 1 + np.flatnonzero(np.asarray(pc.not_equal(words[1:], words[:-1]))))

    for batch in batches:
        if len(batch):
            kept.append(batch)
        if sum(map(len, kept)) >= rows:
            batch, starts = joined()
            if len(starts) > 1:
                yield batch.slice(0, starts[-1]), starts[:-1]
            kept = [batch.slice(starts[-1])]
    if kept:
        yield joined()


def _placed(contexts: DataFrame, table: np.ndarray, move: bool) -> DataFrame:
    """The training count and class of the word of each row; ``first`` is true in one row of each word.

    All rows of a word meet in a task. Its class is that of highest likelihood by all its contexts, or that of its shape if words may not ``move``.
    """
    shared, classes = contexts.sparkSession.sparkContext.broadcast(table), len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, width = Gains(shared.value), 2 * classes + 1
        for batch, starts in _runs(batches):
            rows = np.diff(np.append(starts, len(batch)))
            packed = batch.column("entries")
            word = np.repeat(np.repeat(np.arange(len(starts)), rows), np.asarray(pc.binary_length(packed)) // _ENTRY.itemsize)
            entries = np.frombuffer(b"".join(packed.to_pylist()), _ENTRY)
            found = np.bincount(word * width + entries["code"], entries["n"], len(starts) * width).reshape(-1, width)
            own = classes - SHAPES - 1 + np.asarray(batch.column("shape"))[starts]
            best = (gains.best(own, found) if move else own).astype(np.int32)
            c = (found[:, :classes].sum(axis=1) + found[:, -1]).astype(np.int64)
            first = np.zeros(len(batch), bool)
            first[starts] = True
            columns = [batch.column("chunk"), batch.column("number"), batch.column("shape"), *(pa.array(np.repeat(x, rows)) for x in (c, best)), pa.array(first)]
            yield pa.RecordBatch.from_arrays(columns, schema=_PLACED)

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(run, "chunk long, number int, shape int, c long, class int, first boolean").where("c > 0")


@dataclass
class Model:
    """``words``: class and count of each frequent word; ``rest``: a table of the same for all others, by chunk and number there; ``mass``: tokens and words of each class; ``home``: by shape, the class of words not met
    in training; ``n_classes``: the last class is the end; ``ends``: its count; ``alpha``: added to transitions."""

    words: dict[bytes, tuple[int, int]]
    rest: DataFrame
    mass: dict[int, tuple[int, int]]
    home: list[int]
    n_classes: int
    tokens: int
    vocabulary: int
    ends: int
    alpha: float


def train(chunks: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of the training texts in ``chunks``. The vocabulary stays a table; what reaches the driver is bounded by the settings."""
    counts = materialize(_counts(chunks))
    tokens, vocabulary, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0))).first()
    top = {bytes(r.word): r.c for r in counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(max(settings.frequent, settings.clustered or 0)).collect()}
    discard(counts)
    move = settings.clustered is None
    core = list(top)[:settings.core if move else settings.clustered]
    bigrams = _bigrams(chunks, {w: i for i, w in enumerate(core)}, len(core))
    of = exchange(bigrams, len(core), min(settings.classes, max(1, len(core))), settings.rounds)
    n_classes = int(of[-1]) + 1
    first_shape = n_classes - SHAPES - 1
    table = np.zeros((n_classes, n_classes))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)
    class_of = {w: int(c) for w, c in zip(core, of, strict=False)}
    others = [w for w in top if w not in class_of]
    if move and others:
        placed = _placed(_frequent_contexts(chunks, class_of, first_shape, others), table, True).where("first").select("number", "class").collect()
        class_of |= {others[r.number]: r["class"] for r in placed}
        table = _bigrams(chunks, class_of, first_shape)
    else:
        class_of |= {w: first_shape + shape(w) for w in others}
    rest = materialize(_placed(_rare_contexts(chunks, class_of, first_shape), table, move))
    tally: dict[int, Counter] = {}  # by class: tokens, words
    once: Counter = Counter()  # by shape and class: words met once
    for r in rest.where("first").groupBy("shape", "class").agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect():
        tally.setdefault(r["class"], Counter()).update(tokens=r.c, words=r.n)
        once[r["shape"], r["class"]] += r.once
    for w, c in top.items():
        tally.setdefault(class_of[w], Counter()).update(tokens=c, words=1)
        once[shape(w), class_of[w]] += c == 1
    home = [first_shape + s for s in range(SHAPES)]
    if move:
        for s in range(SHAPES):
            most = max(range(n_classes - 1), key=lambda k: (once[s, k], -k))
            home[s] = most if once[s, most] else home[s]
    mass = {k: (n["tokens"], n["words"]) for k, n in tally.items()}
    return Model({w: (class_of[w], c) for w, c in top.items()}, rest, mass, home, n_classes, tokens, vocabulary, ends, settings.alpha)


_FIELDS = [("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())),
           ("emitted", pa.list_(pa.float64())), ("classes", pa.binary())]
_CLASSED = pa.schema(_FIELDS)
_CLASSED_DDL = "doc_ids array<long>, held array<boolean>, lengths array<long>, known array<long>, base array<double>, emitted array<double>, classes binary"
_PARTLY = pa.schema([("chunk", pa.int64()), *_FIELDS, ("rare", pa.binary()), ("shapes", pa.binary())])
#: In the place of a class not yet known.
_OPEN = 65_535


def _classed(chunks: DataFrame, model: Model) -> DataFrame:
    """The chunks with the classes of all their tokens, and for each document n_known, the base score and the sum of the logarithms of the words' shares of their classes.

    Frequent words are looked up before the join, so that only classes and the numbers of rare words are exchanged, not the words.
    """
    spark = chunks.sparkSession
    total, n_classes = model.tokens + model.vocabulary + 1, model.n_classes
    tokens, words = (np.array([model.mass.get(k, (0, 0))[j] for k in range(n_classes)], float) for j in (0, 1))
    shared = spark.sparkContext.broadcast(({w: j for j, w in enumerate(model.words)}, np.array(list(model.words.values()), np.int64).reshape(-1, 2).T))
    open_classes, home, ends = np.isin(np.arange(n_classes), model.home), np.array([*model.home, n_classes - 1]), model.ends

    def logs(of: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore"):
            return np.log10((c + 1) / total), np.log10(np.where(open_classes[of], (c + 1) / (tokens[of] + words[of] + 1), c / np.maximum(tokens[of], 1)))

    def frequent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, frequent = shared.value
        for batch in batches:
            for i in range(len(batch)):
                found = _looked_up(_words(batch, i), place)
                of, c = np.full(len(found), _OPEN), np.zeros(len(found), np.int64)
                own = found >= 0
                of[own], c[own] = frequent[:, found[own]]
                of[0], c[0] = n_classes - 1, ends
                known, base, share = np.zeros((3, len(found)))
                base[own], share[own] = logs(of[own], c[own])
                base[0] = math.log10((ends + 1) / total)
                known[c > 0] = 1
                ids, lengths = _numbers(batch, i, "ids", np.int32), _listed(batch, i, "lengths")
                sums = lambda x: np.add.reduceat(x[ids], np.cumsum(lengths) - lengths)
                classes = of[ids]
                yield record_batch(_PARTLY, {**{x: [batch.column(x)[i].as_py()] for x in ("chunk", "doc_ids", "held", "lengths", "shapes")}, "known": [sums(known).astype(np.int64)], "base": [sums(base)],
                                             "emitted": [sums(share)], "classes": [classes.astype(np.uint16).tobytes()], "rare": [ids[classes == _OPEN].tobytes()]})

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                of = home[_numbers(batch, i, "shapes", np.uint8)]
                c = np.zeros(len(of), np.int64)
                if (answers := batch.column("answers")[i].values) is not None:
                    number = np.asarray(answers.field("number"))
                    of[number], c[number] = np.asarray(answers.field("class")), np.asarray(answers.field("c"))
                of_token, rare, lengths = _numbers(batch, i, "classes", np.uint16).copy(), _numbers(batch, i, "rare", np.int32), _listed(batch, i, "lengths")
                document = np.repeat(np.arange(len(lengths)), lengths)[of_token == _OPEN]
                of_token[of_token == _OPEN] = of[rare]
                more = lambda x: np.bincount(document, x[rare], len(lengths))
                base, share = logs(of, c)
                sums = {"known": more((c > 0).astype(np.int64)).astype(np.int64), "base": more(base), "emitted": more(share)}
                rest = {name: [_listed(batch, i, name) + x] for name, x in sums.items()}
                yield record_batch(_CLASSED, {**{x: [batch.column(x)[i].as_py()] for x in ("doc_ids", "held", "lengths")}, **rest, "classes": [of_token.tobytes()]})

    partly = chunks.select("chunk", "doc_ids", "held", "lengths", "ids", "words", "shapes").mapInArrow(frequent_words, f"chunk long, {_CLASSED_DDL}, rare binary, shapes binary")
    answers = model.rest.groupBy("chunk").agg(F.collect_list(F.struct("number", "class", "c")).alias("answers"))
    return materialize(partly.join(answers, "chunk", "left").drop("chunk").mapInArrow(rare_words, _CLASSED_DDL), codec="zstd")


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(chunks: DataFrame, model: Model) -> DataFrame:
    """A row for each document: n_tokens, n_known, train_tokens, base_score, score.

    A word takes its share of its class's tokens. A word not met in training has the share of one unseen word of the class it goes to.
    """
    classed = _classed(chunks, model)
    units, sequence = model.n_classes, lambda batch, i: _numbers(batch, i, "classes", np.uint16).astype(np.int64)
    table = _pairs(classed.select("held", "lengths", "classes"), units, lambda batch: (sequence(batch, i) for i in range(len(batch))))
    transition = np.log10((table + model.alpha) / (table.sum(axis=1, keepdims=True) + model.alpha * units))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                of, lengths = sequence(batch, i), _listed(batch, i, "lengths")
                moves = transition[np.concatenate([[units - 1], of[:-1]]), of]
                column = lambda name: batch.column(name)[i].values
                scores = np.add.reduceat(moves, np.cumsum(lengths) - lengths) + _listed(batch, i, "emitted")
                yield pa.RecordBatch.from_arrays([column("doc_ids"), column("held"), column("lengths"), column("known"), column("base"), pa.array(scores)], schema=_SCORES)

    scored = classed.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity_scores(documents: DataFrame, folds: int = 7, rest: int = 2, settings: Settings = Settings()) -> DataFrame:
    """Learn from the documents outside the held-out fold and score all.

    Needs doc_id and text; others are ignored. A null text is the empty text, which has one token, the end. A null id is in no fold and is learned
    from. Repeated rows each count and each give a row. With no training document all tokens are unknown. An empty table gives no row.
    """
    chunks = encode(documents.select("doc_id", "text", in_fold("doc_id", folds, rest).alias("held_out")))
    model = train(chunks, settings)
    scored = score(chunks, model)
    discard(chunks, model.rest)
    return scored
