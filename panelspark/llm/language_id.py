"""Operator 1: language identification by multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams by language give a matrix of log probabilities. Its size is the number of languages times the number of buckets, which is checked;
it is broadcast. A text is scored by gathering the rows of its buckets and adding them, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import in_fold, record_batch, texts, values, with_row

#: Hash buckets, longest n-gram, most cells of a matrix, and code points handled at once.
BUCKETS, ORDER, MOST_CELLS, BLOCK = 1 << 16, 3, 1 << 24, 1 << 18
#: Documents learned from, at most about so many of each language.
SAMPLE = 3000
#: Language of a text without a letter.
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of one to three code points of a text in lower case, with a space before and after, in blocks."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    for start in range(0, len(points), BLOCK):
        block = points[start:start + BLOCK + ORDER - 1]
        here = min(BLOCK, len(points) - start)
        mixed = np.zeros(len(block), dtype=np.uint64)
        for n in range(ORDER):
            size = min(here, len(block) - n)
            if size <= 0:
                break
            mixed = (mixed[:size] ^ block[n:n + size]) * _MULTIPLIERS[n % 3]
            mixed ^= mixed >> np.uint64(29)
            yield (mixed >> np.uint64(48)).astype(np.int64) if BUCKETS == 1 << 16 else (mixed % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    #: log P(bucket | language), (buckets, languages).
    weights: np.ndarray


def train(labelled: DataFrame, sample: int = SAMPLE, alpha: float = 0.5) -> Model:
    """Learn from whole texts of ``labelled`` (text, lang, doc_id) where both text and lang are given.

    About ``sample`` documents of each language are used, chosen by a hash of the id and the text; of a language with fewer, all are.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if len(languages) * BUCKETS > MOST_CELLS:
        raise ValueError(f"{len(languages)} languages need a matrix of more than {MOST_CELLS} cells")
    if not languages:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0)))
    number = {lang: i for i, lang in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / sizes[lang]))])
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(texts(batch), values(batch, "lang"), strict=True):
                own = counts.setdefault(number[lang], np.zeros(BUCKETS, dtype=np.int64))
                for found in buckets(text.decode()):
                    own += np.bincount(found, minlength=BUCKETS)
        for lang, own in sorted(counts.items()):
            used = np.flatnonzero(own)
            yield record_batch(schema, {"cell": used * len(languages) + lang, "n": own[used]})

    table = np.zeros(BUCKETS * len(languages))
    for r in chosen.select("text", "lang").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        table[r.cell] = r.n
    table = table.reshape(BUCKETS, -1) + alpha
    prior = np.log(np.array([sizes[x] for x in languages], dtype=float) / sum(sizes.values()))
    return Model(languages, prior, np.log(table / table.sum(axis=0)))


def classify(text: str | None, model: Model) -> tuple[str, float]:
    """Language and its posterior probability; undetermined texts have score 0."""
    if text is None or not model.languages or not _LETTER.search(text):
        return UNDETERMINED, 0.0
    total = model.prior.copy()
    for found in buckets(text):
        total += model.weights[found].sum(axis=0)
    best = int(np.argmax(total))
    return model.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score`` in place of ``text``. Only the text is looked at."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in documents.columns if c != "text"]
    schema = T.StructType([*(documents.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(None if t is None else t.decode(), shared.value) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                                             names=[*kept, "lang_pred", "score"])

    return documents.mapInArrow(run, schema)


def identify(documents: DataFrame, folds: int = 5, rest: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learns from the rows outside the held-out fold.

    Needs doc_id, text and lang; others are ignored. A null text and a text without a letter are ``und`` with score 0, as is every text if there is nothing to
    learn from. A null id is in no fold. Repeated rows each give a row; equal posteriors go to the first language by name. An empty table gives no row.
    """
    held_out = in_fold("doc_id", folds, rest)
    model = train(documents.select("doc_id", "text", "lang").where(~held_out), sample)
    return predict(documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text"), model)


def determined(documents: DataFrame, folds: int = 5, rest: int = 0, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``documents`` whose language can be told, all columns kept. Rejected are null texts and texts without a letter."""
    model = train(documents.select("doc_id", "text", "lang").where(~in_fold("doc_id", folds, rest)), sample)
    return predict(with_row(documents, text=F.col("text")), model).where(F.col("lang_pred") != UNDETERMINED).select("_row.*")
