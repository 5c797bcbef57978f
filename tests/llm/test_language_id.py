import zlib

import numpy as np
import pytest
from cases import ODD_TEXTS

from panelspark.llm import language_id as li


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = li.identify(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def slow_score(text, model):
    total = model.prior.copy()
    for grams in li.buckets(text):
        for g in grams:
            total = total + model.weights[g]
    return total


def test_training_and_scores(docs, monkeypatch):
    rows = [(1, "aaa bbb", "x"), (2, "zzz yyy", "y"), (3, "aba", "x"), (4, "no lang", None), (5, None, "x"), (6, "", "y")]
    model = li.train(docs(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["x", "y"] and np.allclose(np.exp(model.prior), [0.5, 0.5])
    assert np.allclose(np.exp(model.weights).sum(axis=0), 1)
    for text in ["ab", "zz y", "q"]:
        total = slow_score(text, model)
        lang, score = li.classify(text, model)
        assert lang == model.languages[int(np.argmax(total))] and score == pytest.approx(np.exp(total.max()) / np.exp(total).sum())
    whole = [np.sort(np.concatenate(list(li.buckets(t or "")))) for t in ODD_TEXTS]
    monkeypatch.setattr(li, "BLOCK", 3)
    for w, t in zip(whole, ODD_TEXTS):
        assert np.array_equal(w, np.sort(np.concatenate(list(li.buckets(t or "")))))


def test_defined_results(docs):
    rows = [(i, t, "en", "s", 0.0) for i, t in enumerate(ODD_TEXTS)] + [(None, "words", None, None, None), (3, "1 2 3", "de", "a", 1.0), (3, "1 2 3", "de", "a", 1.0)]
    df = docs(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    out = li.identify(df).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.lang_pred == "und":
            assert r.score == 0
    kept = li.determined(df)
    assert kept.columns == df.columns
    want = [t for _, t, *_ in rows if t and any(c.isalpha() for c in t)]
    assert sorted(r.text for r in kept.collect()) == sorted(want)
    assert {r.lang_pred for r in li.identify(docs([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}
    assert li.identify(docs([], "doc_id long, text string, lang string")).collect() == []
