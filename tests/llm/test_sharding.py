import hashlib
from collections import Counter

import pytest

from panelspark.llm import sharding as sh


def slow_lookup(shards, slots):
    digits = lambda s, seed: int(hashlib.md5(f"{seed}:{s}".encode()).hexdigest()[:15], 16)
    orders = [iter([(digits(s, "offset") + j * (digits(s, "skip") % (slots - 1) + 1)) % slots for j in range(slots)]) for s in shards]
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(orders):
            if len(owner) == slots:
                break
            owner[next(x for x in order if x not in owner)] = i
    return [owner[i] for i in range(slots)]


@pytest.mark.parametrize("n, slots", [(1, 7), (3, 101), (10, 251), (7, 7)])
def test_table(n, slots):
    shards = [f"s{i}" for i in range(n)]
    table = sh.lookup(shards, slots)
    assert table == slow_lookup(shards, slots)
    sizes = Counter(table).values()
    assert len(sizes) == n and max(sizes) - min(sizes) <= 1


def test_few_slots_move():
    shards = [f"s{i}" for i in range(20)]
    old, new = sh.lookup(shards, 4099), sh.lookup(shards[:-1], 4099)
    moved = sum(a != b and a != 19 for a, b in zip(old, new))
    assert moved < 0.12 * 4099


def test_placement(docs):
    rows = [(1, "a"), (1, "a"), (None, None), (7, ""), (-3, "x")]
    df = docs([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, slot int, shard string")
    table = sh.lookup(["a", "b", "c"], 101)
    out = sh.assign(df, "doc_id", ["a", "b", "c"], 101).collect()
    for r in out:
        slot = int(hashlib.md5(("" if r._row.doc_id is None else str(r._row.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard, r.shard_name) == (slot, table[slot], "abc"[table[slot]]) and r._row.slot == 0
    assert len(out) == len(rows)
    assert sh.assign(docs([]), "doc_id", ["a"], 7).collect() == []


def test_whole_table(small):
    out = sh.assign(small.select("doc_id"), "doc_id", ["a", "b"]).collect()
    assert sorted(r._row.doc_id for r in out) == sorted(r.doc_id for r in small.collect())


def test_bad_parameters():
    for shards, slots in ((["a"], 8), ([], 7), (["a", "a"], 7), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sh.lookup(shards, slots)
