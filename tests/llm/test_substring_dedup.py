"""Substring de-duplication against sets of windows."""

import hashlib
import random

import numpy as np
import pytest
from cases import ODD_TEXTS, SF
from pyspark.sql import functions as F

from panelspark.llm import queries, substring_dedup
from panelspark.llm.automaton import SuffixAutomaton


def slow(rows, window=13):
    """{(id, text): (words, removed, kept)} from the first id of every window."""
    first, out = {}, {}
    order = lambda d: 2 ** 63 - 1 if d is None else d
    split = [(d, t, (t or "").encode().split()) for d, t in rows]
    for d, _, w in split:
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            first[g] = min(order(d), first.get(g, 2 ** 63))
    for d, t, w in split:
        gone = {p for i in range(len(w) - window + 1) if first[tuple(w[i:i + window])] < order(d) for p in range(i, i + window)}
        out[d, t] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def check(docs, rows, **options):
    got = substring_dedup.deduplicate(docs(rows), **options).select("_row.*", "n_words", "n_removed", "kept").collect()
    want = slow(rows, options.get("window", 13))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id, r.text], (r.doc_id, r.text)
    return want


def made(rnd, n, words=40):
    """Texts of own words, shared passages in different surroundings, copies and texts of very few words."""
    stock = [f"w{i}" for i in range(words)]
    shared = [[rnd.choice(stock) + str(rnd.randrange(30)) for _ in range(rnd.randrange(10, 60))] for _ in range(12)]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            passage = rnd.choice(shared)
            a = rnd.randrange(len(passage))
            parts += rnd.choice([passage, passage[a:], passage[:a], [f"own{d}_{rnd.randrange(5)}" for _ in range(rnd.randrange(30))], ["a", "b"] * rnd.randrange(20), ["same"] * rnd.randrange(60)])
        rows.append((rnd.choice([d, d, d, d // 2]), rnd.choice([" ", "  ", "\n"]).join(parts)))
    return rows + rnd.sample(rows, n // 10) + [(n + i, rows[i][1]) for i in range(n // 5)]


def test_random_documents(docs):
    want = check(docs, made(random.Random(1), 150))
    assert sum(n for _, n, _ in want.values()) > 3000


def test_crowded_keys_and_salted_shards(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "KEY_WORDS", 60)
    monkeypatch.setattr(substring_dedup, "STREAMED", 25)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 500)
    check(docs, made(random.Random(2), 120))


def test_other_windows(docs):
    check(docs, made(random.Random(3), 60), window=7, gram=7)
    check(docs, made(random.Random(4), 60), window=5, gram=1)


def test_odd_texts_ids_and_columns(docs, spark):
    rows = [(i % 9 if i % 4 else None, t) for i, t in enumerate(ODD_TEXTS + ODD_TEXTS[::-1])]
    check(docs, rows)
    frame = docs([(1, "x " * 20), (2, "x " * 20)]).withColumn("doc", F.lit(1)).withColumn("kept", F.lit("k")).withColumn("a b", F.lit(None)).withColumn("_row", F.lit(0))
    got = {r["_row"].doc_id: r for r in substring_dedup.deduplicate(frame).collect()}
    assert got[2].n_removed == 20 and got[2]["_row"].kept == "k" and got[2].kept == ""
    assert substring_dedup.deduplicate(docs([])).count() == 0


def test_filter_may_be_small(docs):
    check(docs, made(random.Random(5), 60), filter_bits=1 << 15)


def test_long_text(docs):
    rnd = random.Random(6)
    long = " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(300_000))
    check(docs, [(1, "start " + long[900_000:1_300_000]), (2, long), (3, "q" * 1_500_000 + " " + long[:200])])


def test_query_on_the_table(spark):
    got = {r.doc_id: r for r in queries.op12_substring_dedup(spark, SF).collect()}
    want = slow([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in got.items()} == {d: (a, b, hashlib.sha256(c.encode()).hexdigest()) for (d, _), (a, b, c) in want.items()}


def test_keys_are_of_windows_alone():
    h = np.random.default_rng(0).integers(0, 50, 400, dtype=np.uint64)
    for window, gram in ((13, 5), (13, 13), (13, 1), (4, 2), (9, 2)):
        keys = substring_dedup.window_keys(h, window, gram)
        alone = [int(substring_dedup.window_keys(h[i:i + window], window, gram)[0]) for i in range(len(h) - window + 1)]
        assert keys.tolist() == alone
    starts, counts = substring_dedup.passages(np.array([1] * 70 + [2] * 3 + [1]), 32)
    assert list(zip(starts.tolist(), counts.tolist())) == [(0, 32), (32, 32), (64, 6), (70, 3), (73, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_automaton(seed):
    rnd = random.Random(seed)
    texts = [([rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(1, 25))], rnd.randrange(9)) for _ in range(25)]
    made = SuffixAutomaton.of(texts)
    for words, doc in texts:
        held = {tuple(w[i:j]) for w, d in texts if d < doc for i in range(len(w)) for j in range(i + 3, len(w) + 1)}
        want = {p for i in range(len(words)) for j in range(i + 3, len(words) + 1) if tuple(words[i:j]) in held for p in range(i, j)}
        assert {p for a, b in made.covered(words, doc, 3) for p in range(a, b)} == want
