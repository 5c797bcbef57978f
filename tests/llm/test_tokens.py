"""Chunk by chunk ids against the library on whole texts."""

from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import ODD_TEXTS
from panelspark.llm import tokens


def whole(encoder, text):
    ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
    return array("I", [*ids, encoder.vocabulary.end_id]).tobytes()


@pytest.mark.parametrize("vocabulary", [tokens.WORD_BPE, tokens.BYTE_BPE])
def test_equal_to_the_library(vocabulary, small, monkeypatch):
    encoder = tokens.Encoder(vocabulary)
    for text in [*ODD_TEXTS, *(r.text for r in small.limit(60).collect())]:
        assert encoder.document(None if text is None else text.encode()) == whole(encoder, text), text
    monkeypatch.setattr(tokens, "SLICE", 50)
    for text in ODD_TEXTS:
        assert encoder.document(None if text is None else text.encode()) == whole(encoder, text), text


ALPHABET = st.sampled_from(list(" éÉÀßÿ÷×^`~[({\n\tabAB'stredȩ́́　\x1c\x1f.,!19½_🙂ßΣİ  "))


@pytest.mark.parametrize("vocabulary", [tokens.WORD_BPE, tokens.BYTE_BPE])
@settings(max_examples=400, deadline=None)
@given(text=st.text(ALPHABET, max_size=30))
def test_any_text(vocabulary, text):
    encoder = tokens.encoder(vocabulary)
    assert encoder.document(text.encode()) == whole(encoder, text)


def test_store_is_bounded():
    encoder = tokens.Encoder(tokens.Vocabulary("word_bpe_49k.json", end_id=2, size=49_408, lower=True, kept=20))
    for i in range(200):
        text = f"alpha{i} beta gamma{i % 7}"
        assert encoder.document(text.encode()) == whole(encoder, text)
    assert len(encoder.young) <= 24 and len(encoder.old) <= 24
