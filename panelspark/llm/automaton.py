"""Suffix automata over words, with the smallest document id of every state.

The automaton of some passages knows every run of words in them. A state stands for runs that end at the same places; ``first`` is the smallest
document among those.
"""

from __future__ import annotations

from collections.abc import Iterable

#: Rank of documents without an id: after all others.
LAST = 2 ** 63 - 1


class SuffixAutomaton:
    """States are numbers; 0 is the empty run."""

    def __init__(self) -> None:
        self.edges: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [LAST]

    @classmethod
    def of(cls, passages: Iterable[tuple[list[bytes], int]]) -> SuffixAutomaton:
        """The automaton of (words, document) pairs."""
        made = cls()
        known: dict[bytes, bytes] = {}
        for words, doc in passages:
            state = 0
            for word in words:
                state = made._extend(state, known.setdefault(word, word))
                if doc < made.first[state]:
                    made.first[state] = doc
        for state in sorted(range(1, len(made.link)), key=made.length.__getitem__, reverse=True):
            up = made.link[state]
            if made.first[state] < made.first[up]:
                made.first[up] = made.first[state]
        return made

    def _state(self, edges: dict[bytes, int], link: int, length: int) -> int:
        self.edges.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(LAST)
        return len(self.link) - 1

    def _split(self, state: int, word: bytes, after: int) -> int:
        """The state of exactly the run of ``state`` and ``word``, cut out of ``after`` if that has longer runs."""
        if self.length[after] == self.length[state] + 1:
            return after
        shorter = self._state(dict(self.edges[after]), self.link[after], self.length[state] + 1)
        self.link[after] = shorter
        while state >= 0 and self.edges[state].get(word) == after:
            self.edges[state][word] = shorter
            state = self.link[state]
        return shorter

    def _extend(self, state: int, word: bytes) -> int:
        after = self.edges[state].get(word)
        if after is not None:
            return self._split(state, word, after)
        made = self._state({}, 0, self.length[state] + 1)
        while state >= 0 and word not in self.edges[state]:
            self.edges[state][word] = made
            state = self.link[state]
        if state >= 0:
            self.link[made] = self._split(state, word, self.edges[state][word])
        return made

    def covered(self, words: list[bytes], doc: int, least: int) -> list[tuple[int, int]]:
        """Maximal spans of ``words`` that are covered by runs of ``least`` words or more which a document before ``doc`` holds.

        At every word the statistic is the longest run ending there that the passages hold, and of its suffixes the longest that an earlier document holds.
        """
        spans: list[tuple[int, int]] = []
        state = held = 0
        for place, word in enumerate(words, 1):
            while state and word not in self.edges[state]:
                state = self.link[state]
                held = self.length[state]
            if word in self.edges[state]:
                state, held = self.edges[state][word], held + 1
            near, run = state, held
            while near and self.first[near] >= doc:
                near = self.link[near]
                run = self.length[near]
            if near and run >= least:
                if spans and spans[-1][1] >= place - run:
                    spans[-1] = (min(spans[-1][0], place - run), place)
                else:
                    spans.append((place - run, place))
        return spans
