"""Line de-duplication against a slow version that aligns every later document with every earlier one that first had one of its lines."""

from cases import ODD_TEXTS
from hypothesis import given
from hypothesis import strategies as st

from panelspark.llm import line_dedup as ld


def slow(rows, min_words=50):
    """Texts after deletion; ``rows``: (doc_id, text) with different ids."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    worded = {d: [(i, x) for i, x in enumerate((t or "").encode().split(b"\n")) if x.split()] for d, t in order}
    lone = {d: {x: p for p, (_, x) in enumerate(w) if sum(y == x for _, y in w) == 1} for d, w in worded.items()}
    first, out = {}, {}
    for d, text in order:
        partners = {}
        for x, p in lone[d].items():
            if x in first:
                partners.setdefault(first[x], []).append((p, lone[first[x]][x]))
        gone = set()
        for e, pairs in partners.items():
            best = longest_chain(sorted(pairs))
            whole = dict(best)
            mine, other = worded[d], worded[e]
            for i, j in best:
                for s in (-1, 1):
                    if 0 <= i + s < len(mine) and 0 <= j + s < len(other) and mine[i + s][1] == other[j + s][1]:
                        whole.setdefault(i + s, j + s)
            block = []
            for i in [*sorted(whole), None]:
                if block and (i is None or i != block[-1] + 1 or whole[i] != whole[block[-1]] + 1):
                    if sum(len(mine[b][1].split()) for b in block) >= min_words:
                        gone |= {mine[b][0] for b in block}
                    block = []
                if i is not None:
                    block.append(i)
        for x in lone[d]:
            first.setdefault(x, d)
        kept = [x for i, x in enumerate((text or "").encode().split(b"\n")) if i not in gone]
        out[d] = (None if text is None else b"\n".join(kept).decode(), len(worded[d]), len(gone))
    return out


def longest_chain(pairs):
    assert ld.align(list(pairs)) == ld.align(list(reversed(pairs)))
    chain = ld.align(pairs)
    best = [1] * len(pairs)
    for b in range(len(pairs)):
        best[b] = 1 + max((best[a] for a in range(b) if pairs[a][1] < pairs[b][1]), default=0)
    assert len(chain) == max(best, default=0) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(chain, chain[1:]))
    return chain


@given(st.permutations(range(9)))
def test_alignment_is_longest(order):
    longest_chain(list(enumerate(order)))


def result(df, **more):
    return {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in ld.deduplicate(df, **more).select("_row.doc_id", "_row.text", "n_lines", "n_deleted").collect()}


def test_whole_table(small):
    want = slow([(r.doc_id, r.text) for r in small.collect()])
    assert result(small) == want
    assert sum(n for _, _, n in want.values()) > 0


def sentence(name, n=20):
    return " ".join(f"{name}{i}" for i in range(n))


def test_cases(docs):
    a, b, c, d = (sentence(x) for x in "abcd")
    rows = [(1, "\n".join([a, b, c, "x", d])), (2, "\n".join(["head", a, b, c, "tail"])), (3, "\n".join([c, b, a])), (4, "\n".join([a, "", b, " ", c])), (5, f"{a}\n{b}\nother\n{c}"),
            (6, "\n".join([a, a, b, c, d])), (7, "x"), (8, None), (9, ""), (-1, "x\nother words"), (10, "\n".join([a, b, c, "x", d])), (None, "\n".join([a, b, c])), (11, sentence("z", 60)),
            (12, sentence("z", 60)), (13, sentence("z", 60) + "\n"), *((100 + i, t) for i, t in enumerate(ODD_TEXTS))]
    df = docs([(i, t, "p", "q", 3) for i, t in rows], "doc_id long, text string, doc string, places string, n_chars int")
    want = slow(rows)
    assert result(df) == want
    assert want[2][0] == "head\ntail" and want[3][2] == 0 and want[4][0] == "\n " and want[12][0] == "" and want[None][0] == ""
    assert want[10][0] == ""  # the common line x between is closed from its neighbours
    full = ld.deduplicate(df).select("_row.*").where("doc_id = 2").first()
    assert full.n_chars == len("head\ntail") and (full.doc, full.places) == ("p", "q")


def test_equal_ids_and_empty(docs):
    a = "\n".join(sentence(x) for x in "efg")
    rows = ld.deduplicate(docs([(1, a), (1, a), (2, a), (2, a)])).select("_row.*", "n_deleted").collect()
    assert sorted((r.doc_id, r.n_deleted) for r in rows) == [(1, 0), (1, 0), (2, 3), (2, 3)]
    other = a.replace("e0", "changed")
    texts = [r.text for r in ld.deduplicate(docs([(1, a), (1, other)]), min_words=30).select("_row.text").collect()]
    assert sorted(t.count("\n") for t in texts) == [0, 2]
    assert ld.deduplicate(docs([])).collect() == []
