"""Operator 5: benchmark phrases found by a distributed positional inverted index.

The index is a written table. A row is a segment: some whole documents, with the sorted positions of every term (its postings). Positions
count through the segment and leave one free between documents, so that no phrase crosses a border. The phrases are a
stated query set: they are sent in blocks of bounded size to all segments. In a segment a phrase begins with the postings of its
rarest term, moved back by the term's place in the phrase; the lists of the other terms, rarest first, are
intersected with it until it is empty or all terms are met. With ``slop`` over zero every term may stand so many places beside its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import record_batch, row_columns, run_folder, slices, texts, values, with_row
from panelspark.session import materialize

#: Words of a phrase; words of a segment, but for one longer document; phrases of a block.
WINDOW, SEGMENT, BLOCK = 13, 1 << 17, 1 << 15

#: A-Z in lower case; all else in ASCII but digits and letters parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_INDEX = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                    ("starts", pa.binary()),
                    ("terms", pa.binary()), ("ends", pa.binary()), ("positions", pa.binary())])
_INDEX_DDL = ("segment long, doc_ids array<long>, keys array<long>, sizes array<long>, starts binary, terms binary, ends binary, positions binary")
_MATCH = pa.schema([("segment", pa.int64()), ("doc", pa.int32()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64())),
                    ("items", pa.list_(pa.string()))])
_MATCH_DDL = "segment long, doc int, starts array<long>, stops array<long>, items array<string>"


def words(text: bytes | None) -> list[bytes]:
    """Words of ASCII digits, letters and characters outside ASCII, with A-Z in lower case."""
    out: list[bytes] = []
    for part in slices(text or b""):
        out += part.translate(_FOLD).split()
    return out


class _Segment:
    def __init__(self) -> None:
        self.ids: list = []
        self.keys: list = []
        self.starts: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.places: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, key: int | None, found: list[bytes]) -> None:
        terms = self.terms
        self.ids.append(doc_id)
        self.keys.append(key)
        self.starts.append(self.size)
        self.codes.append(np.fromiter((terms.setdefault(w, len(terms)) for w in found), dtype=np.int32, count=len(found)))
        self.places.append(np.arange(self.size, self.size + len(found), dtype=np.int64))
        self.size += len(found) + 1

    def row(self, number: int) -> pa.RecordBatch:
        codes, places = np.concatenate(self.codes), np.concatenate(self.places)
        postings = places[np.argsort(codes, kind="stable")]
        ends = np.cumsum(np.bincount(codes, minlength=len(self.terms)))
        moves = np.diff(postings, prepend=0)
        return record_batch(_INDEX, {
            "segment": [number], "doc_ids": [self.ids], "keys": [self.keys], "sizes": [[len(c) for c in self.codes]],
            "starts": [np.array([*self.starts, self.size], dtype="<i8").tobytes()],
            "terms": [b" ".join(self.terms)], "ends": [ends.astype("<i8").tobytes()],
            "positions": [moves.astype("<i4" if self.size < 1 << 31 else "<i8").tobytes()]})


def build_index(documents: DataFrame, path: str, segment: int = SEGMENT) -> DataFrame:
    """Write the index of ``documents`` (columns ``doc_id`` and ``text``, and ``key`` if there is one) to ``path`` and read it."""
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(["key"] if "key" in documents.columns else [F.lit(None).cast("long").alias("key")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_one = TaskContext.get().partitionId() << 32, _Segment()
        for batch in batches:
            for doc_id, key, text in zip(values(batch, "doc_id"), values(batch, "key"), texts(batch), strict=True):
                found = words(text)
                if open_one.ids and open_one.size + len(found) > segment:
                    yield open_one.row(number)
                    number, open_one = number + 1, _Segment()
                open_one.add(doc_id, key, found)
        if open_one.ids:
            yield open_one.row(number)

    source.mapInArrow(run, _INDEX_DDL).write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(_INDEX_DDL).parquet(path)


class Phrases:
    """A block of phrases: its terms, the terms of every phrase by number (-1 behind a short one), and the phrase's item."""

    def __init__(self, phrases: list[tuple[str, tuple[bytes, ...]]]):
        number: dict[bytes, int] = {}
        self.items = [item for item, _ in phrases]
        self.length = np.array([len(p) for _, p in phrases], dtype=np.int64)
        self.codes = np.full((len(phrases), int(self.length.max())), -1, dtype=np.int32)
        for row, (_, phrase) in zip(self.codes, phrases, strict=True):
            row[:len(phrase)] = [number.setdefault(w, len(number)) for w in phrase]
        self.terms = list(number)


def windows(item_words: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    """All runs of ``size`` words; a shorter text is one run, an empty one none."""
    if not item_words:
        return set()
    return {tuple(item_words[i:i + size]) for i in range(max(1, len(item_words) - size + 1))}


def phrase_blocks(benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> Iterator[Phrases]:
    """The windows of all items, in blocks; the driver holds one block and one item at a time."""
    held: list = []
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").toLocalIterator():
        for phrase in sorted(windows(words((row.text or "").encode()), size)):
            held.append((row.item, phrase))
            if len(held) == block:
                yield Phrases(held)
                held = []
    if held:
        yield Phrases(held)


def find(phrases: Phrases, terms: list[bytes], ends: np.ndarray, postings: np.ndarray, slop: int = 0) -> list[tuple[int, np.ndarray]]:
    """(phrase, starts) of the phrases that occur in a segment."""
    local = {t: i for i, t in enumerate(terms)}
    place = np.array([local.get(t, -1) for t in phrases.terms] + [0])
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    codes = np.where(phrases.codes < 0, -2, place[phrases.codes])
    out = []
    for p in np.flatnonzero((codes != -1).all(axis=1)):
        own = codes[p, :phrases.length[p]]
        order = np.argsort(ends[own] - begins[own], kind="stable")
        starts = postings[begins[own[order[0]]]:ends[own[order[0]]]] - order[0]
        if slop:
            starts = np.unique(starts[:, None] + np.arange(-slop, slop + 1))
        for k in order if slop else order[1:]:
            mine = postings[begins[own[k]]:ends[own[k]]]
            at = np.searchsorted(mine, starts + (k - slop))
            ok = at < len(mine)
            ok[ok] = mine[at[ok]] <= starts[ok] + (k + slop)
            starts = starts[ok]
            if not len(starts):
                break
        else:
            out.append((int(p), starts))
    return out


def search(index: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """A row for each document that holds a phrase: segment, doc (place in it), and spans (starts, stops, items; positions in the document).

    Overlapping or adjoining occurrences of an item are one span. With ``slop`` the words of a match lie within ``slop``
    places of their own; a span reaches from its first place to its last, within the document.
    """
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Phrases = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                borders = np.frombuffer(row["starts"], "<i8")
                ends = np.frombuffer(row["ends"], "<i8")
                wide = len(row["positions"]) == 8 * (ends[-1] if len(ends) else 0)
                postings = np.cumsum(np.frombuffer(row["positions"], "<i8" if wide else "<i4"), dtype=np.int64)
                spans: dict[int, dict[str, list]] = {}
                for p, starts in find(block, row["terms"].split(), ends, postings, slop):
                    n, item = int(block.length[p]), block.items[p]
                    docs = np.searchsorted(borders, np.maximum(starts, 0), side="right") - 1
                    for d, s in zip(docs.tolist(), starts.tolist(), strict=True):
                        a, b = max(s - slop, int(borders[d])), min(s + n + slop, int(borders[d + 1]) - 1)
                        if not slop or _inside(block, p, s, slop, a, b, row, ends, postings):
                            spans.setdefault(d, {}).setdefault(item, []).append((a - int(borders[d]), b - int(borders[d])))
                docs = sorted(spans)
                merged = [[(i, *s) for i, found in sorted(spans[d].items()) for s in _merged(found)] for d in docs]
                yield record_batch(_MATCH, {"segment": [row["segment"]] * len(docs), "doc": docs, "starts": [[s[1] for s in m] for m in merged],
                                            "stops": [[s[2] for s in m] for m in merged], "items": [[s[0] for s in m] for m in merged]})

    return index.drop("doc_ids", "keys", "sizes").mapInArrow(run, _MATCH_DDL)


def _inside(block: Phrases, p: int, start: int, slop: int, low: int, high: int, row: dict, ends: np.ndarray, postings: np.ndarray) -> bool:
    """Every term of a loose match has a place inside the document."""
    local = {t: i for i, t in enumerate(row["terms"].split())}
    for k in range(int(block.length[p])):
        t = local[block.terms[block.codes[p, k]]]
        mine = postings[(ends[t - 1] if t else 0):ends[t]]
        at = np.searchsorted(mine, max(low, start + k - slop))
        if at == len(mine) or mine[at] > min(high - 1, start + k + slop):
            return False
    return True


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _covered(starts: Column, stops: Column) -> Column:
    """Places in the union of spans."""
    spans = F.array_sort(F.arrays_zip(starts.alias("a"), stops.alias("b")))
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda acc, s: F.struct((acc.n + F.greatest(s.b - F.greatest(s.a, acc.to), F.lit(0).cast("long"))).alias("n"), F.greatest(acc.to, s.b).alias("to"))
    return F.aggregate(spans, first, step).n


def judge(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items (their ids as sorted text) and contaminated, for every row of ``documents``.

    Needs doc_id and text in ``documents`` (a column ``key`` is passed on, others are ignored), item_id and text in ``benchmark``. A word is hit
    inside any occurrence of a window. A null text and a text without words have no words and are clean, a null item id is the empty text, items with
    the same id count once, repeated documents each give a row. Without items every document is clean.
    """
    index = build_index(documents, run_folder(documents.sparkSession))
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "keys", "sizes")).alias("doc", "d")).select(
        "segment", "doc", F.col("d.doc_ids").alias("doc_id"), F.col("d.keys").alias("key"), F.col("d.sizes").alias("n_words"))
    found = documents.sparkSession.createDataFrame([], _MATCH_DDL)
    for block in phrase_blocks(benchmark, window):
        found = found.union(search(index, block))
    merged = found.groupBy("segment", "doc").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "stops", "items")]).select(
        "segment", "doc", _covered(F.col("starts"), F.col("stops")).alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))
    hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return docs.join(merged, ["segment", "doc"], "left").select(
        "doc_id", "key", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, all columns kept.

    A row is known by its text, so rows with equal text share their fate.
    """
    keyed = with_row(documents, doc_id=F.col("doc_id"), text=F.col("text"), key=F.xxhash64("text"))
    bad = materialize(judge(keyed, benchmark).where("contaminated").select("doc_id", "key").distinct())
    rows = keyed.select("_row", "doc_id", "key")
    match = rows.doc_id.eqNullSafe(bad.doc_id) & (rows.key == bad.key)
    # the contaminated rows grow with the documents, so the join is a shuffled one at every size
    return row_columns(rows.join(bad.hint("merge"), match, "left_anti"))
