"""Line de-duplication against the rule itself: runs of lines that any earlier document holds verbatim."""

import random

from test_line_dedup import result, sentence


def by_rule(rows, min_words=50):
    """Deleted lines of each document; every run of lines is looked up in all earlier documents."""
    held, out = set(), {}
    for d, text in sorted(rows):
        lines = [x for x in text.split("\n") if x.split()]
        runs = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)]
        out[d] = len({p for i, j in runs if tuple(lines[i:j]) in held and sum(len(x.split()) for x in lines[i:j]) >= min_words for p in range(i, j)})
        held |= {tuple(lines[i:j]) for i, j in runs}
    return out


def test_passage_held_twice(docs):
    a, b, c = (sentence(x) for x in "abc")
    passage = "\n".join([a, b, c])
    got = result(docs([(1, f"head\n{passage}"), (2, f"{passage}\nbetween\n{passage}"), (3, "\n".join([a, a, b, b, c, c])), (4, "\n".join([a] * 4)), (5, "\n".join(["x", *[a] * 4]))]))
    assert got[2] == ("between", 7, 6)
    assert got[3][2] == 0 and got[4][2] == 0 and got[5][0] == "x"


def test_lines_first_met_elsewhere(docs):
    lines = [sentence(f"l{i}x", 15) for i in range(6)]
    got = result(docs([(1, "\n".join(lines[:3])), (2, "\n".join(lines[3:])), (5, "\n".join(lines)), (9, "\n".join(lines))]))
    assert [got[d][2] for d in (1, 2, 5, 9)] == [0, 0, 0, 6]


def test_random_documents(docs):
    rnd = random.Random(4)
    stock = [sentence(f"s{i}x", rnd.choice([1, 3, 12, 30, 55])) for i in range(9)]
    passages = [[rnd.choice(stock) for _ in range(rnd.randrange(1, 7))] for _ in range(8)]
    rows = [(d, "\n".join(x for _ in range(rnd.randrange(1, 4)) for x in [*rnd.choice(passages), f"own {d} {rnd.random()}", ""])) for d in range(120)]
    want = by_rule(rows)
    assert {d: n for d, (_, _, n) in result(docs(rows)).items()} == want and sum(want.values()) > 100
