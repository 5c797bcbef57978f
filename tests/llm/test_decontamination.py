import hashlib
import re

import pytest
from cases import ODD_TEXTS, SF

from panelspark.llm import decontamination as dc


def slow_words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def slow(rows, items):
    out = []
    grams = {}
    for item, text in items:
        w = slow_words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            grams.setdefault(tuple(w[i:i + 13]), set()).add("" if item is None else str(item))
    sizes = {len(g) for g in grams}
    for doc_id, text in rows:
        w, hit, found = slow_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i:i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in dc.digest(df).collect()), key=str)


def test_words():
    for text in ODD_TEXTS:
        assert [w.decode() for w in dc.words(None if text is None else text.encode())] == slow_words(text)


def test_whole_tables(spark, small):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = slow([(r.doc_id, r.text) for r in small.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    assert got(dc.judge(small, benchmark)) == want
    assert any(r[5] for r in want)


def test_edges_in_small_segments_and_blocks(spark, docs, monkeypatch):
    long_item = " ".join(f"w{i % 9}{i % 4}" for i in range(40))
    items = [(1, "Short one"), (2, long_item), (2, "the the the"), (None, "no id here"), (10, ""), (11, None), (3, "!!!"), (4, "a b " * 9)]
    rows = [(1, long_item.upper()), (2, "x " * 30 + long_item), (2, "x " * 30 + long_item), (3, "short"), (4, "one short one, SHORT-ONE"), (None, "No id; here"),
            (5, None), (6, ""), (7, "short"), (8, "one"), (9, "the " * 50), (10, "b a " * 30), (11, " ".join(long_item.split()[5:30])),
            *((100 + i, t) for i, t in enumerate(ODD_TEXTS))]
    monkeypatch.setattr(dc.build_index, "__defaults__", (60,))
    monkeypatch.setattr(dc.phrase_blocks, "__defaults__", (13, 4))
    df = docs([(d, t, "x", "y", 1) for d, t in rows], "doc_id long, text string, segment string, item_id string, n_words int")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    assert got(dc.judge(df, bench)) == slow(rows, items)
    kept = dc.decontaminate(df, bench)
    assert kept.columns == df.columns
    clean = [r[0] for r in slow(rows, items) if not r[5]]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.judge(docs([]), bench).collect() == []
    assert [r.contaminated for r in dc.judge(docs([(1, "a b"), (2, None)]), bench.limit(0)).collect()] == [False, False]


@pytest.mark.parametrize("slop, want", [(0, {1}), (1, {1, 2, 3}), (2, {1, 2, 3})])
def test_proximity(docs, tmp_path, slop, want):
    rows = [(1, "zero red green blue end"), (2, "red green very blue"), (3, "red very green very blue"), (4, "red green"), (5, "blue"), (6, "blue very very green red")]
    index = dc.build_index(docs(rows).coalesce(1), str(tmp_path / "i"))
    found = dc.search(index, dc.Phrases([("q", (b"red", b"green", b"blue"))]), slop).collect()
    assert {rows[r.doc][0] for r in found} == want
    if not slop:
        assert [(r.starts, r.stops, r["items"]) for r in found] == [([1], [4], ["q"])]
