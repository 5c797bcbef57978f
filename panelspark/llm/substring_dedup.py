"""Operator 12: runs of words that a document with a smaller id holds, found with suffix automata of reference shards.

Reference text is what documents share, not what they are. Every window of ``window`` words has a key, the smallest hash among the runs of
``gram`` words in it; equal windows have equal keys. Neighbouring windows of one key form a passage, so a window lies in exactly one passage. A
filter of fixed size holds the keys met in two different texts; passages with other keys are unique and go no further.
Different passages are dealt to shards by key: all passages that may share a window meet in one shard. A key with very many passages (where
a common run of words goes over into different surroundings) is dealt by its single windows instead, so shards stay bounded.

The automaton of a shard is made of its passages and the first document of each. The passages go to every group that streams for the shard; a shard with
many to stream has several groups. A stream gives, word by word, the longest run that an earlier document holds, and spans of ``window``
words or more are removed. A broadcast of all automata to all tasks would grow with the corpus and stream each text through each of them.

Copies of a text need no stream: whatever the first of them keeps, the others lose. They are put aside first. Of repeated passages only the first document of each is
streamed. Three bitmaps of fixed size keep most text from being exchanged: of the texts that have copies, of the shared keys, and of the texts that lose words. Each only lets
too much through, more so with a larger corpus, and an exact step follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.automaton import LAST, SuffixAutomaton
from panelspark.llm.common import SLICE, record_batch, slices, texts, values, with_row
from panelspark.session import discard, materialize, small

WINDOW = 13
GRAM = 5
#: Windows of a passage at most; longer stretches with one key are cut, which parts no window.
PASSAGE_WINDOWS = 32
#: Bits of each filter (16 MB), whatever the input. With more keys it lets more through, which costs time only.
FILTER_BITS = 1 << 27
#: Words of passages with one key beyond which its windows are dealt one by one.
KEY_WORDS = 20_000
#: Words of an automaton, and passages streamed by one group, on average.
SHARD_WORDS = 100_000
STREAMED = 20_000

_BLOCK = 15  # bits of a place in one bitmap of the filter
_rng = np.random.default_rng(12)
_BYTE_CODES = _rng.integers(0, 2 ** 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class _Hasher:
    """Hashes of words: sums of byte codes times powers, taken as differences of one running sum and brought back to power 0."""

    def __init__(self) -> None:
        self.powers = _powers(_BASE, 1 << 16)
        self.inverse = _powers(np.uint64(pow(int(_BASE), -1, 2 ** 64)), 1 << 16)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte and byte after the last of every word."""
        found, base = [], 0
        for part in slices(data, SLICE):
            if len(part) >= len(self.powers):
                n = 1 << (len(part) + 1).bit_length()
                self.powers, self.inverse = _powers(_BASE, n), _powers(np.uint64(pow(int(_BASE), -1, 2 ** 64)), n)
            a = np.frombuffer(part, dtype=np.uint8)
            inside = np.concatenate([[False], ~_SPACES[a], [False]])
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            start, stop = edges[::2], edges[1::2]
            sums = np.zeros(len(a) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODES[a] * self.powers[:len(a)], out=sums[1:])
            found.append((_mixed((sums[stop] - sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64)), start + base, stop + base))
            base += len(part)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))


def window_keys(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The key of every window of word hashes."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.uint64)
    grams = hashes[:len(hashes) - gram + 1].copy()
    for i in range(1, gram):
        grams = grams * _BASE + hashes[i:len(hashes) - gram + 1 + i]
    grams, width = _mixed(grams), window - gram + 1
    # the smallest of `width` neighbours from smallest of 1, 2, 4, ...
    step, least = 1, grams
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return np.minimum(least[:len(grams) - width + 1], least[width - step:]) if width > step else least


def passages(keys: np.ndarray, longest: int = PASSAGE_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of every passage."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(starts, len(keys)))
    parts = -(-counts // longest)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(starts + counts, parts)
        starts = np.repeat(starts, parts) + nth * longest
        counts = np.minimum(longest, ends - starts)
    return starts, counts


def _bitmap(df: DataFrame, code: str, bits: int) -> np.ndarray:
    """The filter of a column of codes: one bit set for each; at most ``bits`` of them reach the driver."""
    place = F.col(code).bitwiseAND(F.lit(bits - 1))
    maps = (df.groupBy(F.shiftright(place, _BLOCK).alias("block"))
            .agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << _BLOCK) - 1))).alias("bits")).collect())
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in maps:
        part = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        out[r.block << (_BLOCK - 3):][:len(part)] = part[:len(out)]
    return out


def _in_bitmap(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    slot = codes.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _split_by(df: DataFrame, bits: np.ndarray, inside: bool) -> DataFrame:
    """Rows whose ``code`` is in the filter, or is not."""
    sent = df.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent.value, dtype=np.uint8)
        for batch in batches:
            found = _in_bitmap(held, np.ascontiguousarray(batch.column("code").to_numpy(zero_copy_only=False)))
            yield batch.filter(pa.array(found == inside))

    return df.mapInArrow(run, df.schema)


def _window_keys_of(text: bytes | None, hasher: _Hasher, window: int, gram: int) -> np.ndarray:
    return window_keys(hasher.words(text or b"")[0], window, gram)


def _shared_keys(different: DataFrame, window: int, gram: int, bits: int) -> np.ndarray:
    """Filter of the keys that stand in two different texts."""
    schema = pa.schema([("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            keys = [np.unique(_window_keys_of(t, hasher, window, gram)) for t in texts(batch)]
            yield record_batch(schema, {"key": np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)})

    return _bitmap(different.select("text").mapInArrow(run, "key long").groupBy("key").count().where("count > 1"), "key", bits)


_PASSAGE = pa.schema([("kind", pa.binary()), ("doc", pa.int64()), ("place", pa.int32()), ("windows", pa.int32()), ("key", pa.int64()), ("words", pa.binary())])


def _passages(different: DataFrame, shared: np.ndarray, window: int, gram: int) -> DataFrame:
    """The passages of all texts whose key passes the filter."""
    sent = different.sparkSession.sparkContext.broadcast(shared.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = _Hasher(), np.frombuffer(sent.value, dtype=np.uint8)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _PASSAGE}
            for doc, kind, text in zip(values(batch, "doc"), values(batch, "kind"), texts(batch), strict=True):
                hashes, first, stop = hasher.words(text)
                keys = window_keys(hashes, window, gram)
                starts, counts = passages(keys)
                keys = keys[starts]
                for i in np.flatnonzero(_in_bitmap(bits, keys)).tolist():
                    a, n = int(starts[i]), int(counts[i])
                    row = (kind, doc, a, n, int(keys[i].view(np.int64)), b" ".join(text[first[a]:stop[a + n + window - 2]].split()))
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
                if len(out["kind"]) > 20_000:
                    yield record_batch(_PASSAGE, out)
                    out = {f.name: [] for f in _PASSAGE}
            yield record_batch(_PASSAGE, out)

    return different.select("kind", "doc", "text").mapInArrow(run, "kind binary, doc long, place int, windows int, key long, words binary")


_UNIT = pa.schema([("passage", pa.binary()), ("offset", pa.int32()), ("first", pa.int64()), ("words", pa.binary())])


def _single_windows(crowded: DataFrame, window: int) -> DataFrame:
    """Passages of crowded keys as their windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _UNIT}
            for passage, first, text in zip(values(batch, "passage"), values(batch, "first"), values(batch, "words"), strict=True):
                words = text.split()
                for offset in range(len(words) - window + 1):
                    for name, value in zip(out, (passage, offset, first, b" ".join(words[offset:offset + window])), strict=True):
                        out[name].append(value)
            yield record_batch(_UNIT, out)

    return crowded.select("passage", "first", "words").mapInArrow(run, "passage binary, offset int, first long, words binary")


def _streamed(units: DataFrame, window: int) -> DataFrame:
    """Covered spans, counted in words of the passage, of the rows (shard, salt, passage, offset, first, words, streams) that stream; a null passage is ``words`` as a whole."""
    def stream(group: pa.Table) -> pa.Table:
        rows = list(zip(*[group.column(c).to_pylist() for c in ("passage", "offset", "first", "words", "streams")], strict=True))
        holders: dict[bytes, int] = {}
        for _, _, first, words, _ in rows:
            holders[words] = min(first, holders.get(words, LAST))
        automaton = SuffixAutomaton.of((words.split(), first) for words, first in holders.items())
        out: dict[str, list] = {f.name: [] for f in _SPAN}
        for passage, offset, first, words, streams in rows:
            for a, b in automaton.covered(words.split(), first, window) if streams else ():
                for name, value in zip(out, (passage or hashlib.md5(words).digest(), offset + a, offset + b), strict=True):
                    out[name].append(value)
        return pa.table(out, schema=_SPAN)

    return units.groupBy("shard", "salt").applyInArrow(stream, "passage binary, start int, stop int")


_SPAN = pa.schema([("passage", pa.binary()), ("start", pa.int32()), ("stop", pa.int32())])
_ROW = ("shard", "salt", "passage", "offset", "first", "words", "streams")


def _covered(distinct: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """passage, start, stop: what the first document of each passage has in common with earlier documents; and a table to discard after use."""
    crowded = small(materialize(distinct.groupBy("key").agg(F.sum(F.col("windows") + window - 1).alias("n")).where(F.col("n") > KEY_WORDS).select("key")))
    apart = distinct.join(crowded, "key", "left_semi").withColumn("passage", F.unhex(F.md5("words")))
    whole = distinct.join(crowded, "key", "left_anti")
    total = whole.agg(F.sum(F.col("windows") + window - 1)).first()[0] or 0
    total += window * (apart.agg(F.sum("windows")).first()[0] or 0)
    shards = -(-max(total, 1) // SHARD_WORDS)
    whole = whole.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), F.lit(None).cast("binary").alias("passage"), F.lit(0).alias("offset"), "first", "words")
    single = materialize(_single_windows(apart, window).select(F.pmod(F.xxhash64("words"), F.lit(shards)).alias("shard"), "passage", "offset", "first", "words"), codec="zstd")
    sizes = small(materialize(whole.select("shard").union(single.select("shard")).groupBy("shard").agg(F.ceil(F.count("*") / STREAMED).alias("salts")).where("salts > 1")))

    def salted(df: DataFrame) -> DataFrame:
        many = df.join(sizes, "shard", "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long")))
        return many.withColumn("own", F.pmod(F.xxhash64("passage", "offset", "words"), F.col("salts")))

    def everywhere(df: DataFrame) -> DataFrame:
        return salted(df).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))

    # a passage is known in all groups of its shard and streams in one of them; of equal windows one row is known, and all stream
    known = single.groupBy("shard", "words").agg(F.min("first").alias("first")).select("shard", F.lit(None).cast("binary").alias("passage"), F.lit(0).alias("offset"), "first", "words")
    parts = [everywhere(whole).withColumn("streams", F.col("salt") == F.col("own")), everywhere(known).withColumn("streams", F.lit(False)),
             salted(single).withColumn("salt", F.col("own")).withColumn("streams", F.lit(True))]
    rows = [part.select(*_ROW) for part in parts]
    return _streamed(rows[0].union(rows[1]).union(rows[2]), window), single


def _removed(different: DataFrame, window: int, gram: int, filter_bits: int) -> DataFrame:
    """kind, spans: places of removed words in every one of different texts that loses some."""
    found = materialize(_passages(different, _shared_keys(different, window, gram, filter_bits), window, gram), codec="zstd")
    distinct = materialize(found.groupBy("words").agg(F.min("doc").alias("first"), F.max("key").alias("key"), F.max("windows").alias("windows")), codec="zstd")
    covered, single = _covered(distinct, window)
    covered = covered.groupBy("passage").agg(F.collect_list(F.struct("start", "stop")).alias("covered"))
    known = distinct.select(F.unhex(F.md5("words")), "first", F.col("windows") + F.lit(window - 1)).toDF("passage", "first", "n").join(covered, "passage", "left")
    whole = F.array(F.struct(F.col("place").alias("start"), (F.col("place") + F.col("n")).alias("stop")))
    part = F.transform("covered", lambda s: F.struct((F.col("place") + s["start"]).alias("start"), (F.col("place") + s["stop"]).alias("stop")))
    places = found.select("kind", "doc", "place", F.unhex(F.md5("words")).alias("passage"))
    spans = places.join(known, "passage").select("kind", F.when(F.col("doc") > F.col("first"), whole).otherwise(part).alias("spans"))
    lost = materialize(spans.where("spans IS NOT NULL").groupBy("kind").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    discard(found, distinct, single)
    return lost


def _kept(text: bytes | None, repeated: bool, spans: list, window: int) -> tuple[int, int, bytes]:
    words = (text or b"").split()
    n = len(words)
    if repeated:
        return (n, n, b"") if n >= window else (n, 0, b" ".join(words))
    if not spans:
        return n, 0, b" ".join(words)
    gone = np.zeros(n + 1, dtype=np.int64)
    for s in spans:
        gone[s["start"]] += 1
        gone[s["stop"]] -= 1
    stay = np.cumsum(gone[:n]) == 0
    return n, int(n - stay.sum()), b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s)


def deduplicate(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``documents`` as ``_row``, with ``n_words``, ``n_removed`` and ``kept``, the words left, joined by one space.

    A word goes if it lies in a run of ``window`` words that a document with a smaller ``doc_id`` holds; runs are looked up in the input, not in what is left.
    A null text has no words. A null ``doc_id`` counts as greater than all others (like 2^63 - 1), so such rows lose to every other and not to each other. Rows with the same id do not
    take words from each other, repeated rows each give a row, an empty table gives none. Other columns may have any name.
    """
    if not 1 <= gram <= window or filter_bits & (filter_bits - 1) or filter_bits < 1 << _BLOCK:
        raise ValueError("gram must be at most the window, and the bits of the filter a power of two, 32768 at least")
    rows = with_row(documents, doc=F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), kind=F.unhex(F.md5(F.col("text"))))
    rows = rows.withColumn("code", F.xxhash64("kind"))
    base = rows.where("kind IS NOT NULL").select("doc", "kind", "code", F.col("_row.text").alias("text"))
    copied = materialize(base.groupBy("kind", "code").agg(F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high")).where("n > 1"))
    copies = _bitmap(copied, "code", filter_bits)
    first = materialize(_split_by(base, copies, True).groupBy("kind").agg(F.min("doc").alias("doc"), F.first("text").alias("text")), codec="zstd")
    different = _split_by(base, copies, False).select("kind", "doc", "text").union(first.select("kind", "doc", "text"))
    spans = _removed(different, window, gram, filter_bits)
    later = copied.where("low < high").select("kind", "low")
    known = materialize(spans.join(later, "kind", "full_outer").select("kind", "low", "spans").withColumn("code", F.xxhash64("kind")))
    losing = _bitmap(known, "code", filter_bits)
    discard(first, spans)
    rows = rows.withColumn("code", F.coalesce("code", F.xxhash64(F.lit(0))))
    met = _split_by(rows, losing, True).join(known.select(F.col("kind").alias("of"), "low", "spans").hint("merge"), F.col("kind") == F.col("of"), "left")
    met = met.select("_row", (F.col("doc") > F.col("low")).alias("repeated"), "spans", F.col("_row.text").alias("text"))
    whole = _split_by(rows, losing, False).select("_row", F.lit(False).alias("repeated"), F.lit(None).cast(known.schema["spans"].dataType).alias("spans"), F.col("_row.text").alias("text"))
    met = met.union(whole)
    schema = T.StructType([met.schema["_row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_kept(t, bool(r), s, window) for t, r, s in zip(texts(batch), values(batch, "repeated"), values(batch, "spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("_row"), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2].decode() for d in done], pa.string())], names=["_row", "n_words", "n_removed", "kept"])

    return met.mapInArrow(run, schema)

