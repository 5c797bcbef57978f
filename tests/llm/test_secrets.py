import random
import re

from panelspark.llm import secrets as sc

SPACE, CANDIDATE = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[A-Za-z0-9+/_=.-]{16,}")


def slow_candidates(rows):
    out = []
    for doc_id, text in rows:
        words = SPACE.split(text) if text is not None else []
        for i, w in enumerate(words):
            if m := CANDIDATE.search(w):
                out.append((doc_id, i, m.group(), words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
    return sorted(out, key=str)


def test_candidates(docs, small):
    rows = [(r.doc_id, r.text) for r in small.collect()] + [(None, 'key = "abcdefghij0123456789"'), (1, None), (2, ""), (3, "x" * 40), (3, "x" * 40), (4, "short")]
    df = docs([(d, t, None, "v") for d, t in rows], "doc_id long, text string, source string, value string")
    got = [(r.doc_id, r.place, r.value, r.before, r.after) for r in sc.candidates(df).collect()]
    assert sorted(got, key=str) == slow_candidates(rows)


def test_planted_secrets_are_told_from_words(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    out = sc.scan(df).collect()
    assert len(out) == len(slow_candidates([(r.doc_id, r.text) for r in df.collect()]))
    hexes = [r.is_secret for r in out if re.fullmatch(r"[0-9a-f]{40}", r.value)]
    words = [r.is_secret for r in out if re.fullmatch(r"[A-Za-z]+", r.value)]
    assert hexes and all(hexes) and words and not any(words)


def test_forest_learns_labels_given(docs):
    rnd = random.Random(3)
    rows, labels = [], {}
    for i in range(300):
        value = "".join(rnd.choice("abcdef0123456789") for _ in range(32)) if i % 2 else "".join(rnd.choice(["tion", "able", "ing", "over"]) for _ in range(6))
        rows.append((i, f"some words {'=' if i % 2 else 'and'} {value} end"))
        labels[i] = float(i % 2)
    df = docs([(d, t, "src/a.py") for d, t in rows], "doc_id long, text string, source string")
    found = sc.candidates(df)
    marked = found.join(docs(list(labels.items()), "doc_id long, label double"), "doc_id").where("doc_id < 200")
    out = sc.scan(df, marked).where("doc_id >= 200").collect()
    assert len(out) == 100 and all(r.is_secret == bool(labels[r.doc_id]) for r in out)


def test_nothing_to_learn_from(docs):
    one = docs([(1, "token = 0123456789abcdef0123", "s")], "doc_id long, text string, source string")
    assert [(r.probability, r.is_secret) for r in sc.scan(one).collect()] == [(1.0, True)]
    assert sc.scan(one.limit(0)).collect() == []
