import zlib
from collections import defaultdict

import numpy as np
from cases import ODD_TEXTS

from panelspark.llm import packing, tokens

COLUMNS = "doc_id long, text string, start string, ids string, sequence_id string"


def check(rows, expected, capacity=1024):
    """``expected``: the ids of every document; returns the padding in tokens."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        windows[r.sequence_id].append(r)
    got = []
    for rs in pieces.values():
        rs.sort(key=lambda r: r.start)
        got += [(r.doc_id, r.start, r.length, r.ids_crc32) for r in rs]
    want = {d: ids for d, ids in expected}
    for d, start, length, crc in got:
        assert zlib.crc32(want[d][4 * start:4 * (start + length)]) == crc and length > 0
    for d, ids in want.items():
        spans = sorted((s, n) for x, s, n, _ in got if x == d)
        assert [s for s, _ in spans] == list(np.cumsum([0, *[n for _, n in spans]])[:-1]) and sum(n for _, n in spans) == len(ids) // 4
    padding = 0
    for rs in windows.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == list(np.cumsum([0, *[r.length for r in rs]])[:-1])
        n = sum(r.length for r in rs)
        assert n <= capacity
        padding += 0 if n & (n - 1) == 0 else capacity - n
    return padding


def test_every_id_lies_in_one_piece(docs):
    rows = list(enumerate(ODD_TEXTS))
    encode = tokens.encoder(tokens.BYTE_BPE).document
    out = packing.pack(docs([(i, t, "s", "i", "q") for i, t in rows], COLUMNS)).collect()
    check(out, [(i, encode(None if t is None else t.encode())) for i, t in rows])
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in out)


def test_little_padding(small):
    out = packing.pack(small.coalesce(1), with_ids=False).collect()
    encode = tokens.encoder(tokens.BYTE_BPE).document
    padding = check(out, [(r.doc_id, encode(r.text.encode())) for r in small.collect()])
    assert padding <= 1024 + 0.003 * sum(r.length for r in out)


def test_nulls_repeats_and_empty(docs):
    out = packing.pack(docs([(None, "a b"), (5, None), (5, None)])).collect()
    assert sorted((r.doc_id is None, r.length) for r in out) == [(False, 1), (False, 1), (True, 3)]
    assert packing.pack(docs([])).collect() == []


def test_differencing():
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 129, 600)]
    for k in (1, 2, 7, 40):
        sums = np.bincount(packing.difference(sizes, k), weights=sizes, minlength=k)
        assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= 3
    assert packing.difference([8, 7, 6, 5, 4], 2) == [1, 0, 1, 0, 0]  # 14 and 16, one more than the optimum
    assert len(set(packing.balanced([6, 6, 6], 10))) == 3  # the count of windows rises from 2
    assert packing.balanced([], 10) == []
