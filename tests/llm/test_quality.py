import re
from collections import Counter

from cases import ODD_TEXTS

from panelspark.llm import quality as q


def slow(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    times = Counter(grams)
    hit = {p for i, g in enumerate(grams) if times[g] > 1 for p in range(i, i + 8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))
    return *base, len(w) < 20 or 100 * len(hit) > 30 * len(w)


REPEATS = ["a b c d e f g h " * 3, "a " * 40, "a b c d e f g h i a b c d e f g h j", "x\ny\nx\n x\n\n\nx"]


def test_figures(small):
    for text in [*ODD_TEXTS, *REPEATS, *(r.text for r in small.limit(80).collect())]:
        t = q.Figures(None if text is None else text.encode())
        assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed) == slow(text), text


def test_cascade_is_every_rule(docs, small):
    rows = [(i, t) for i, t in enumerate([*ODD_TEXTS, *REPEATS])] + [(r.doc_id, r.text) for r in small.collect()] + [(None, "x y"), (5, None), (5, None)]
    out = q.cascade(docs([(d, t, "x", True) for d, t in rows], "doc_id long, text string, n_words string, kept boolean")).collect()
    want = []
    for d, t in rows:
        figures = q.Figures(None if t is None else t.encode())
        want.append((d, *slow(t), not any(rule.rejects(figures) for rule in q.RULES)))
    assert sorted((tuple(r)[:8] for r in out), key=str) == sorted(want, key=str)
    for r in out:
        if r.rejected_by:
            assert not r.kept
    assert q.cascade(docs([])).collect() == []


def test_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    kept = q.cascade(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 20").collect()
    good, bad = [r.kept for r in kept if r.quality == 1], [r.kept for r in kept if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.02 * len(bad), (sum(good), len(good), sum(bad), len(bad))


def test_order():
    rules = tuple(q.Rule(n, lambda t: False) for n in "abcd")
    order = q.ordered(rules, {"a": (1.0, 0.5), "b": (0.1, 0.2), "c": (0.1, 0.0), "d": (2.0, 0.0)})
    assert [r.name for r in order] == ["b", "a", "c", "d"]
    seen = []
    probe = tuple(q.Rule(n, lambda t, n=n: bool(seen.append(n)) or n == "b") for n in "abc")
    assert q.first_rejection(q.Figures(b""), probe) == "b" and seen == ["a", "b"]
