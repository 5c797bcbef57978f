"""Operator 7: passages that repeat an earlier document, line by line.

A passage is a run of consecutive lines with a word, of at least ``min_words`` words. A line is deleted exactly if it lies in a passage that some earlier document
holds verbatim, whichever document that is, wherever it stands there and however often it or its lines occur.

From every line starts a shortest passage, and at every line one ends; both depend on the lines in them alone, so two documents that share a
passage share these (``windows``). They also cover it: of a line in a shared passage either what starts there fits in, or what ends there, or what starts with the
passage reaches over it. So it is enough to know the first document that has each window: each shared passage has its own first holder, no
pairs of documents are formed, and the rows grow with the lines. A document aligned with all earlier ones gives the same lines.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import record_batch, texts, values, with_row
from panelspark.session import materialize

MIN_WORDS = 50

_WINDOWS = pa.schema([("window", pa.binary()), ("doc", pa.binary()), ("start", pa.int32()), ("stop", pa.int32())])
_WINDOWS_DDL = "window binary, doc binary, start int, stop int"


def _hash(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def windows(text: bytes, min_words: int) -> list[tuple[bytes, int, int]]:
    """(hash, first place, place after the last) of the shortest passages from every line and up to every line; places count the lines with a word."""
    lines = [(line, n) for line in text.split(b"\n") if (n := len(line.split()))]
    hashes = b"".join(_hash(line) for line, _ in lines)
    sums = [0, *accumulate(n for _, n in lines)]
    spans = set()
    for place in range(len(lines)):
        stop = bisect_left(sums, sums[place] + min_words, place + 1)
        if stop < len(sums):
            spans.add((place, stop))
        start = bisect_right(sums, sums[place + 1] - min_words, 0, place + 1) - 1
        if start >= 0:
            spans.add((start, place + 1))
    return [(_hash(hashes[16 * a:16 * b]), a, b) for a, b in sorted(spans)]


def _windows(documents: DataFrame, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _WINDOWS}
            for doc, text in zip(values(batch, "doc"), texts(batch), strict=True):
                for window, start, stop in windows(text or b"", min_words):
                    for name, value in zip(out, (window, doc, start, stop), strict=True):
                        out[name].append(value)
            yield record_batch(_WINDOWS, out)

    return documents.select("doc", "text").mapInArrow(run, _WINDOWS_DDL)


def align(links: list[tuple]) -> list[tuple[int, int]]:
    """Patience: the longest chain of (place, earlier place) that rises in both. For tests that compare with the alignment of one pair."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    links = sorted(links)
    for i, (_, j) in enumerate(links):
        at = bisect_left(tops, j)
        tops[at:at + 1] = [j]
        ends[at:at + 1] = [i]
        back.append(ends[at - 1] if at else -1)
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(links[i])
        i = back[i]
    return out[::-1]


def places(spans: list[dict]) -> list[int]:
    """The sorted places in any of the spans."""
    out: list[int] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in spans):
        out += range(max(start, out[-1] + 1) if out else start, stop)
    return out


def _places(spans: DataFrame) -> DataFrame:
    schema = pa.schema([("doc", pa.binary()), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(schema, {"doc": values(batch, "doc"), "places": [places(x) for x in values(batch, "spans")]})

    return spans.select("doc", "spans").mapInArrow(run, "doc binary, places array<int>")


def repeated(keyed: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc`` and the sorted ``places`` (among its lines with a word) to delete; ``keyed`` has ``doc``, whose order is the order of documents, and ``text``."""
    found = materialize(_windows(keyed, min_words))
    firsts = materialize(found.groupBy("window").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("window", "first"))
    spans = found.join(firsts, "window").where("doc > first").groupBy("doc").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return materialize(_places(spans))


def deduplicate(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with the rows kept and repeated passages deleted from ``text``, and ``n_lines`` and ``n_deleted`` beside it.

    Needs doc_id and text; all other columns stay as they are, and are returned as one struct ``_row`` with the new text in it
    (``n_chars``, if there, is counted anew). Earlier means a smaller id; a null id is the latest. Rows with equal id and text are one document and get the same
    result; rows with equal id and other text are ordered by a hash of the text. A null text stays null and has no line. Lines
    without a word stay. A text of which all is deleted becomes the empty text. An empty table gives no row.
    """
    sign = F.lit(-(1 << 63)).cast("long")
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    doc = F.unhex(F.concat(F.lpad(F.hex(number.bitwiseXOR(sign)), 16, "0"), F.lpad(F.hex(F.xxhash64("text")), 16, "0")))
    keyed = with_row(documents, doc=doc)
    gone = repeated(keyed.select("doc", "_row.text"), min_words)
    text = F.col("_row.text")
    lines = F.split(text, "\n", -1)
    # a line with a word has a character other than ASCII white space
    has_word = lambda x: x.rlike("[^\\x20\\x09-\\x0D]")
    rows = F.filter(F.transform(lines, lambda x, i: F.when(has_word(x), i)), lambda i: i.isNotNull())
    bad = F.transform("places", lambda p: F.get(rows, p))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), bad), lambda i: F.get(lines, i)), "\n")
    new = F.when(F.col("places").isNull(), text).otherwise(kept)
    # the deletions grow with the documents, so the join is a shuffled one at every size
    joined = keyed.join(gone.hint("merge"), "doc", "left")
    row = F.col("_row").withField("text", new)
    if "n_chars" in documents.columns:
        row = F.when(F.col("places").isNull(), F.col("_row")).otherwise(row.withField("n_chars", F.length(kept).cast(documents.schema["n_chars"].dataType)))
    counted = F.size(F.filter(lines, has_word))
    return joined.select(row.alias("_row"), F.when(text.isNull(), 0).otherwise(counted).cast("long").alias("n_lines"),
                         F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_deleted"))
