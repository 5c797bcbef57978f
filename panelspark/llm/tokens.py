"""Ids of whole texts by a public tokenizer.

The tokenizers library needs some ten microseconds for a word. Words repeat, so every Python worker keeps the ids
of chunks it has met; the library sees a chunk once. A text is cut only where the tokenizer itself always
cuts, so the joined ids of its chunks are its ids. A text that holds the string of a special token goes
to the library whole. The store of chunks is bounded: when the younger half is full it becomes the older half,
from which chunks in use come back.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

from panelspark.llm.common import SLICE, slices


@dataclass(frozen=True)
class Vocabulary:
    """``file``: a name among the public tokenizers, or a path on every node. ``spaced``: tokens carry the space before them,
    as in byte-level vocabularies; otherwise white space is dropped. ``lower``: the tokenizer folds case.
    ``end_id`` is appended to every document. ``size``: one more than the largest id."""

    file: str
    end_id: int
    size: int
    spaced: bool = False
    lower: bool = False
    #: Chunks kept in each half of the store.
    kept: int = 400_000

    @property
    def narrow(self) -> bool:
        """Ids fit 16 bits."""
        return self.size <= 1 << 16

    def path(self) -> str:
        if os.sep in self.file:
            return self.file
        import public_tokenizers

        return public_tokenizers.path(self.file)


WORD_BPE = Vocabulary("word_bpe_49k.json", end_id=2, size=49_408, lower=True)
BYTE_BPE = Vocabulary("byte_bpe_50k.json", end_id=0, size=50_257, spaced=True)

#: White space of the byte-level pattern: as in Python, but for the four separators U+001C to U+001F.
_CHUNK = re.compile(r" ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+")
#: Letters of ASCII and Latin-1, then ASCII marks other than the apostrophe, where every tokenizer here cuts.
_PLAIN = re.compile(r"( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)?([!-&(-/:-@\[-`{-~]*)")
_SAFE_CUT = re.compile(r"(?<=[\S\x1c-\x1f]) (?=[\S\x1c-\x1f])")


def _byte_letters() -> str:
    """The characters that stand for the bytes in byte-level vocabularies: printable ones for themselves, the rest in order from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return "".join(chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256))


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary
        self.tokenizer = Tokenizer.from_file(vocabulary.path())
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # the model's own store costs more than it saves on words it sees once
        self.mark_ids: dict[str, bytes] = {}
        self.young: dict = {}
        self.old: dict = {}
        self.end = array("I", [vocabulary.end_id]).tobytes()

    def document(self, text: bytes | None) -> bytes:
        """All ids of a text and the end id; a null text has only the end id."""
        text = text or b""
        if any(s in text for s in self.special):
            ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
            return array("I", ids).tobytes() + self.end
        return b"".join([*map(self._known, self._chunks(text)), self.end])

    def _chunks(self, text: bytes) -> Iterator[list]:
        if self.vocabulary.spaced:
            for part in _spaced_slices(text.decode()):
                yield _CHUNK.findall(part)
        else:
            for part in slices(text):
                yield (part.lower() if self.vocabulary.lower else part).split()

    def _known(self, chunks: list) -> bytes:
        try:
            return b"".join(map(self.young.__getitem__, chunks))
        except KeyError:
            self._learn(chunks)
            return b"".join(map(self.young.__getitem__, chunks))

    def _learn(self, chunks: list) -> None:
        if len(self.young) > self.vocabulary.kept:
            self.young, self.old = {}, self.young
        missing = set(chunks).difference(self.young)
        for chunk in [c for c in missing if c in self.old]:
            self.young[chunk] = self.old[chunk]
            missing.discard(chunk)
        hard = []
        for chunk in missing:
            plain = _PLAIN.fullmatch(chunk if self.vocabulary.spaced else chunk.decode())
            if plain is None:
                hard.append(chunk)
            else:
                word, marks = plain.groups()
                self.young[chunk] = (self._word(word) if word else b"") + (self._marks(marks) if marks else b"")
        plain = hard if self.vocabulary.spaced else [c.decode() for c in hard]
        for chunk, found in zip(hard, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False), strict=True):
            self.young[chunk] = array("I", found.ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of letters, with the space before them, straight from the library's model: there is nothing to fold but case and nothing to cut."""
        if self.vocabulary.lower:
            word = word.lower()
        key = word if self.vocabulary.spaced else word.encode()
        found = self.young.get(key) or self.old.get(key)
        if found is None:
            found = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_LETTERS))]).tobytes()
        return found

    def _marks(self, marks: str) -> bytes:
        found = self.mark_ids.get(marks)
        if found is None:
            found = array("I", self.tokenizer.encode(marks, add_special_tokens=False).ids).tobytes()
            if len(self.mark_ids) < 10_000:
                self.mark_ids[marks] = found
        return found


def _spaced_slices(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > SLICE:
        cut = _SAFE_CUT.search(text, start + SLICE)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


_ENCODERS: dict[Vocabulary, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder; tasks that follow each other in one worker share it."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]
