import random

import numpy as np
import xxhash
from cases import ODD_TEXTS

from panelspark.llm import golay, simhash
from panelspark.llm.components import components


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_groups(rows):
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    distinct = sorted({f for _, f in fps})
    root = roots(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 2])
    low = {}
    for d, f in fps:
        if d is not None:
            low[root[f]] = min(d, low.get(root[f], d))
    return sorted(((d, f"{f:016x}", low.get(root[f])) for d, f in fps), key=str)


def test_golay_keys():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 3000)
    flips = np.zeros_like(words)
    for _ in range(2):
        flips ^= np.where(rng.random(3000) < 0.8, 1 << rng.integers(0, 23, 3000), 0)
    for a, b in zip(golay.keys(words), golay.keys(words ^ flips)):
        assert set(a[a >= 0]) & set(b[b >= 0])
        assert len(set(a[a >= 0])) in (1, 6)


def test_fingerprints(small, monkeypatch):
    texts = [*ODD_TEXTS, *(r.text for r in small.limit(40).collect())]
    want = [slow_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == want
    import panelspark.llm.common as common
    monkeypatch.setattr(common.slices, "__defaults__", (64,))
    assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == want


def test_against_all_pairs(docs, small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    rows += [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "only here no id"), (None, rows[0][1]), (7, None), (7, None)]
    df = docs([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, fp string, key string")
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == slow_groups(rows)


def test_links_of_crowded_keys(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << x for x in {rnd.randrange(64) for _ in range(rnd.randrange(5))}) for b in base for _ in range(400)}
    fps |= {base[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12, 30)}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    found = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    got = {r.node: r.root for r in found.collect()}
    want = roots(sorted(signed), [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    assert {n: got.get(n, n) for n in signed} == want


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(500, 501), (501, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_group_stays(docs):
    text = "one two three four five six"
    rows = [(4, text, "a"), (2, text.upper(), "b"), (2, text, "c"), (9, "other words here now", "d"), (None, None, "e"), (8, "", "f"), (None, "sole", "g"), (None, "sole", "h")]
    out = simhash.deduplicate(docs(rows, "doc_id long, text string, fp string"))
    assert out.columns == ["doc_id", "text", "fp"]
    kept = sorted(r.fp for r in out.collect())
    assert len(kept) == 4 and set(kept) - {"b", "c", "g", "h"} == {"d", "f"}
    assert simhash.deduplicate(docs([])).collect() == []
