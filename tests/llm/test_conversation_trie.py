"""Conversation tries against a dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest
from cases import SF
from pyspark.sql import functions as F

from panelspark.llm import conversation_trie as ct
from panelspark.llm import queries

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def slow(rows):
    """Nodes of all rebuilt conversations from a dictionary of prefixes."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    members = {}
    length = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        made = turns.get(base, [])[:h] + own[h:]
        length[c] = len(made)
        for d in range(len(made) + 1):
            members.setdefault(tuple(made[:d]), []).append(c)
    out = []
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[:len(p)] == p] for p in members} if len(members) < 1500 else None
    if children is None:
        children = {p: [] for p in members}
        for q in members:
            if q:
                children[q[:-1]].append(q)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or (not children[p])
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = sorted(c for c in members[p] if length[c] == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), int(leaves[p]), saved[p],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r[n] for n in NAMES) for r in ct.nodes(frame, **options).collect()), key=str)
    assert got == slow(rows)
    return got


def made(rnd, convs, turns=9, words="abc"):
    rows = []
    for c in convs:
        for t in range(rnd.randrange(1, turns)):
            rows.append((c, rnd.choice([t, t, t, None, 3]), rnd.choice(["user", "user", None]), rnd.choice([*words, None, "é🙂"])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [10 ** 6, 40, 3])
def test_random_conversations(spark, limit):
    rnd = random.Random(limit)
    check(spark, made(rnd, [*range(0, 60), *range(100, 130), *range(250, 290), -5, -205, -200]), shard_turns=limit)


def test_long_and_copied_conversations(spark):
    long = [(7, t, "user", f"turn {t % 5}") for t in range(300)]
    copies = [(c, t, "bot", f"same {t}") for c in range(300, 330) for t in range(12)]
    nodes = check(spark, long + copies + [(8, t, "user", f"turn {t % 5}") for t in range(200)], shard_turns=20)
    assert max(n[1] for n in nodes) >= 299


def test_conversation_over_many_tasks(spark):
    rows = [(11, i // 3, "user", f"t{i % 7}") for i in range(900)] + [(12, 1, "user", "same")] * 400 + [(13, 0, "a", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = sorted((tuple(r[n] for n in NAMES) for r in ct.nodes(frame).collect()), key=str)
    assert got == slow(rows)


def test_nulls_empty_tables_and_odd_columns(spark):
    rows = [(None, 1, "user", "x"), (1, None, None, None), (1, None, None, None), (2, 1, "", ""), (3, 1, "a", "b c"), (4, 1, "a b", "c")]
    check(spark, rows)
    check(spark, [])
    check(spark, [(None, 1, "a", "b")])
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit("x")).withColumn("path", F.lit(1)).withColumn("a b", F.lit(2))
    assert ct.nodes(frame).count() == len(slow(rows))


def test_turnless_conversation(spark):
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    check(spark, [(turnless, 0, "user", "gone"), (turnless + 100, 0, "user", "x"), (5, 0, "user", "y")])


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_trie(spark, SF)
    assert got.columns == list(NAMES)
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow(rows)


def test_double_array():
    rnd = random.Random(1)
    sequences = list({tuple(rnd.randrange(30) for _ in range(rnd.randrange(1, 7))) for _ in range(400)})
    trie = ct.DoubleArray([list(s) for s in sequences], 30)
    seen = {}
    for s in sequences:
        state = 0
        for i, t in enumerate(s):
            state = trie.step(state, t)
            assert seen.setdefault(state, s[:i + 1]) == s[:i + 1]
    assert len(seen) == len({s[:i] for s in sequences for i in range(1, len(s) + 1)})
    with pytest.raises(KeyError):
        trie.step(0, 31)
