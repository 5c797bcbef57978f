"""Operator 2: quality rules as a short-circuit cascade.

A rule looks at a text through shared figures, which are counted when a rule first asks for them. On a bounded sample every rule is
run on every text: the time it takes and the share it rejects give its rejections per second, and the cascade tries the rules in falling
order of that. A text leaves at the first rule that rejects it. The order changes the time only, never the verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import record_batch, slices, texts, values

#: Documents, about, on which cost and selectivity are estimated.
SAMPLE = 1000
#: Words of a repeated window.
WINDOW = 8

_SYMBOLS = bytes(sorted(b"#*$%&|<>"))
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Figures:
    """What rules look at, counted on demand."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def codes(self) -> np.ndarray:
        """The words as numbers; equal words have equal numbers."""
        number: dict[bytes, int] = {}
        parts = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in map(bytes.split, slices(self.text))]
        self.vocabulary = number
        return np.concatenate(parts)

    @property
    def n_words(self) -> int:
        return len(self.codes)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.text.translate(None, _CONTINUATION).split()))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text.translate(None, _NOT_SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of eight words that occur more than once."""
        codes, n = self.codes, self.n_words - WINDOW + 1
        if n < 2:
            return 0
        mixed = np.zeros(n, dtype=np.uint64)
        for i in range(WINDOW):
            mixed = (mixed ^ codes[i:i + n].astype(np.uint64)) * _MIX
            mixed ^= mixed >> np.uint64(32)
        _, place, times = np.unique(mixed, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[place] > 1)
        if not len(again):
            return 0
        # equal hashes are compared word by word
        _, place, times = np.unique(codes[again[:, None] + np.arange(WINDOW)], axis=0, return_inverse=True, return_counts=True)
        again = again[times[place.reshape(-1)] > 1]
        edges = np.zeros(self.n_words + 1, dtype=np.int64)
        np.add.at(edges, again, 1)
        np.add.at(edges, again + WINDOW, -1)
        return int((np.cumsum(edges) > 0).sum())

    @cached_property
    def n_shouted(self) -> int:
        """ASCII capitals."""
        return sum(65 <= b <= 90 for b in self.text) if len(self.text) < 64 else int(((a := np.frombuffer(self.text, np.uint8)) >= 65).sum() - (a > 90).sum())

    @cached_property
    def n_letters(self) -> int:
        """ASCII letters and characters outside ASCII."""
        a = np.frombuffer(self.text, np.uint8)
        return int(((a | 32) - 97 < 26).sum() + (a >= 0xC0).sum())

    @cached_property
    def n_echoes(self) -> int:
        """Words equal to the word before."""
        return int((self.codes[1:] == self.codes[:-1]).sum())

    @cached_property
    def n_wordless(self) -> int:
        """Words without a letter."""
        counts = np.bincount(self.codes, minlength=len(self.vocabulary)) if self.n_words else []
        return int(sum(c for c, w in zip(counts, self.vocabulary, strict=True) if w.isascii() and not any(b in _LETTERS for b in w)))

    @cached_property
    def n_trailing(self) -> int:
        """Lines that end in an ellipsis."""
        return sum(x.rstrip().endswith((b"...", "…".encode())) for x in self.lines)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text to be thrown out."""

    name: str
    rejects: Callable[[Figures], bool]


RULES = (
    Rule("few_words", lambda t: t.n_words < 20),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 12 * t.n_words),
    # a short text whose first line is also its last is no junk, so more than half of the lines must repeat
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("shouting", lambda t: 2 * t.n_shouted > t.n_letters),
    Rule("echoes", lambda t: 10 * t.n_echoes > 2 * t.n_words),
    Rule("wordless", lambda t: 10 * t.n_wordless > 3 * t.n_words),
    Rule("trailing", lambda t: 10 * t.n_trailing > 3 * len(t.lines)),
)


def estimate(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """Seconds a text and rejected share of every rule on about ``sample`` texts, chosen by a hash.

    A rule's time holds the figures it needs, as if it came first.
    """
    n = documents.count()
    schema = pa.schema([("rule", pa.int32()), ("n", pa.int64()), ("rejected", pa.int64()), ("ns", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rejected, ns, seen = [0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for text in texts(batch):
                seen += 1
                for i, rule in enumerate(rules):
                    began = time.perf_counter_ns()
                    rejected[i] += bool(rule.rejects(Figures(text)))
                    ns[i] += time.perf_counter_ns() - began
        yield record_batch(schema, {"rule": list(range(len(rules))), "n": [seen] * len(rules), "rejected": rejected, "ns": ns})

    chosen = documents.where(F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / max(n, 1)))
    found = chosen.select("text").mapInArrow(run, "rule int, n long, rejected long, ns long").groupBy("rule").agg(F.sum("n").alias("n"), F.sum("rejected").alias("r"), F.sum("ns").alias("ns")).collect()
    out = {rules[r.rule].name: (r.ns / 1e9 / max(r.n, 1), r.r / max(r.n, 1)) for r in found}
    return {rule.name: out.get(rule.name, (0.0, 0.0)) for rule in rules}


def ordered(rules: tuple[Rule, ...], estimates: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Rules by falling rejections per second; of equal ones the cheaper first."""
    def worth(rule: Rule) -> tuple[float, float]:
        seconds, share = estimates[rule.name]
        return -share / max(seconds, 1e-12), seconds

    return tuple(sorted(rules, key=worth))


def first_rejection(figures: Figures, rules: tuple[Rule, ...]) -> str | None:
    return next((rule.name for rule in rules if rule.rejects(figures)), None)


def cascade(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, base figures, base_failed, kept and rejected_by of every row (columns doc_id, text; others are ignored).

    ``rejected_by`` is the first rule of the cascade that rejects the text; with other estimates it can be another one. A null text has no words and is
    rejected, as is an empty one. Repeated rows each give a row. An empty table gives no row.
    """
    order = ordered(rules, estimate(documents, rules, sample))
    fields = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
              ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, text in zip(values(batch, "doc_id"), texts(batch), strict=True):
                t = Figures(text)
                by = first_rejection(t, order)
                row = (doc_id, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed, by is None and not t.base_failed, by)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield record_batch(schema, out)

    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)
