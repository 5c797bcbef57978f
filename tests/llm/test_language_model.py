import math
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import ODD_TEXTS

from panelspark.llm import language_model as lm

FEW = lm.Settings(clustered=30, classes=5, frequent=60, rounds=4)


def tokens(text):
    return [*(text or "").encode().lower().split(), lm.END]


def slow(rows, settings):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    train = [tokens(t) for (_, t), h in zip(rows, held) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    ranked = sorted((w for w in c if w != lm.END), key=lambda w: (-c[w], w))
    top = ranked[:settings.clustered]
    unit = {w: i for i, w in enumerate(top)} | {lm.END: len(top) + lm.SHAPES}
    of_unit = lambda w: unit[w] if w in unit else len(top) + lm.shape(w)
    grams = np.zeros((len(top) + lm.SHAPES + 1,) * 2)
    for t in train:
        for a, b in zip([lm.END, *t], t):
            grams[of_unit(a), of_unit(b)] += 1
    of = lm.exchange(grams, len(top), min(settings.classes, max(1, len(top))), settings.rounds)
    k = of[-1] + 1
    moves = np.zeros((k, k))
    for i in range(len(grams)):
        for j in range(len(grams)):
            moves[of[i], of[j]] += grams[i, j]
    p = (moves + settings.alpha) / (moves.sum(axis=1, keepdims=True) + settings.alpha * k)
    cls = lambda w: int(of[of_unit(w)])
    mass, kinds = Counter(), Counter()
    for w, x in c.items():
        mass[cls(w)] += x
        kinds[cls(w)] += 1

    def emission(w):
        if w == lm.END:
            return 1.0
        return c[w] / mass[cls(w)] if w in unit else (c[w] + 1) / (mass[cls(w)] + kinds[cls(w)] + 1)

    out = []
    for (d, t), h in zip(rows, held):
        t = tokens(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(p[cls(a), cls(b)] * emission(b)) for a, b in zip([lm.END, *t], t))
        out.append((d, h, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return sorted(out, key=str)


def compare(got, want):
    got = sorted(map(tuple, got), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_small_table(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    compare(lm.perplexity_scores(small, settings=FEW).collect(), slow(rows, FEW))


def test_odd_rows(docs):
    rows = [*enumerate(ODD_TEXTS), (None, "no id"), (3, "again again")]
    df = docs([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, held_out string, score int")
    compare(lm.perplexity_scores(df, settings=FEW).collect(), slow(rows, FEW))
    assert lm.perplexity_scores(docs([]), settings=FEW).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.perplexity_scores(docs([(only, "unseen words")]), settings=FEW).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(2)
    order = rng.permutation(12)
    grams = np.zeros((12, 12))
    for _ in range(4000):
        a, b = order[rng.integers(6)], order[6 + rng.integers(6)]
        grams[a, b] += 1
        grams[b, order[rng.integers(6)]] += 1
    of = lm.exchange(grams, 12, 2, 10)
    assert len({of[x] for x in order[:6]}) == 1 and len({of[x] for x in order[6:]}) == 1 and of[order[0]] != of[order[6]]


def test_exchange_ends_where_no_single_move_helps():
    def objective(grams, of):
        table = np.zeros((of.max() + 1,) * 2)
        np.add.at(table, (of[:, None], of[None, :]), grams)
        return sum(x * math.log(x) for x in table.reshape(-1) if x) - sum(x * math.log(x) for x in [*table.sum(0), *table.sum(1)] if x)

    rng = np.random.default_rng(0)
    for _ in range(5):
        grams = rng.integers(0, 9, (14, 14)).astype(float)
        of = lm.exchange(grams, 12, 4, 50)
        best = objective(grams, of)
        for w in range(12):
            for k in range(4):
                moved = of.copy()
                moved[w] = k
                assert objective(grams, moved) <= best + 1e-6


def test_beats_the_base_on_held_out_text(spark):
    held = lm.perplexity_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.05


def test_gains_are_differences_of_the_likelihood():
    def objective(of):
        table = np.zeros((6, 6))
        np.add.at(table, (of[:, None], of[None, :]), grams)
        return sum(x * math.log(x) for x in table.reshape(-1) if x) - sum(x * math.log(x) for x in [*table.sum(0), *table.sum(1)] if x)

    rng = np.random.default_rng(1)
    for most in (2, 40):
        grams = rng.integers(0, most, (15, 15)).astype(float)
        grams += np.diag(grams.sum(axis=0) - grams.sum(axis=1)).clip(0)  # as many before as after each word, ends last
        grams[-1, :-1] += (grams.sum(axis=0) - grams.sum(axis=1))[:-1].clip(max=0) * -1
        grams[:-1, -1] += (grams.sum(axis=0) - grams.sum(axis=1))[:-1].clip(min=0)
        of = np.append(rng.integers(0, 5, 14), 5)
        table = np.zeros((6, 6))
        np.add.at(table, (of[:, None], of[None, :]), grams)
        contexts = np.zeros((14, 13))
        for w in range(14):
            for x in range(15):
                if x == w:
                    contexts[w, 12] = grams[w, w]
                else:
                    contexts[w, of[x]] += grams[x, w]
                    contexts[w, 6 + of[x]] += grams[w, x]
        assert (contexts[:, :6].sum(axis=1) == contexts[:, 6:12].sum(axis=1)).all()
        gain = lm.Gains(table).of(of[:-1], contexts)
        for w in range(14):
            for k in range(5):
                moved = of.copy()
                moved[w] = k
                assert gain[w, k] - gain[w, of[w]] == pytest.approx(objective(moved) - objective(of), abs=1e-6)


def contexts_and_table(train, of, words):
    """What ``Gains`` takes, word by word, from lists of tokens; ``of``: the class of every word, ends with the highest."""
    k = of[lm.END] + 1
    table, contexts = np.zeros((k, k)), {w: np.zeros(2 * k + 1) for w in words}
    for t in train:
        for a, b in zip([lm.END, *t], t):
            table[of[a], of[b]] += 1
            if a == b and a in contexts:
                contexts[a][2 * k] += 1
            elif a != b:
                if b in contexts:
                    contexts[b][of[a]] += 1
                if a in contexts:
                    contexts[a][k + of[b]] += 1
    return table, np.array([contexts[w] for w in words])


def test_every_word_is_placed_by_all_its_bigrams(small, spark):
    settings = lm.Settings(classes=5, frequent=60, rounds=4, core=30)
    marked = small.select("doc_id", "text", lm.in_fold("doc_id", 7, 2).alias("held_out"))
    chunks = lm.encode(marked, tokens=3000, words=900)
    assert chunks.count() > 8
    model = lm.train(chunks, settings)
    words = {(r.chunk, j): w for r in chunks.collect() for j, w in enumerate([lm.END, *bytes(r.words).split()])}
    rest = {words[r.chunk, r.number]: (r["class"], r.c) for r in model.rest.collect()}
    rows = [(r.doc_id, r.text, r.held_out) for r in marked.collect()]
    train = [tokens(t) for _, t, h in rows if not h]
    c = Counter(w for t in train for w in t)
    ranked = sorted((w for w in c if w != lm.END), key=lambda w: (-c[w], w))
    assert {w: n for w, (_, n) in (model.words | rest).items()} == {w: c[w] for w in ranked} and list(model.words) == ranked[:60]
    first = model.n_classes - lm.SHAPES - 1
    own = {w: first + lm.shape(w) for w in ranked} | {lm.END: model.n_classes - 1}
    state = own | {w: model.words[w][0] for w in ranked[:30]}
    for band, got in ((ranked[30:60], model.words), (ranked[60:], rest)):
        table, contexts = contexts_and_table(train, state, band)
        want = lm.Gains(table).best(np.array([own[w] for w in band]), contexts)
        assert [got[w][0] for w in band] == want.tolist()
        state |= dict(zip(band, want.tolist()))
    assert any(state[w] != own[w] for w in ranked[60:])
    mass, kinds = Counter(), Counter(state[w] for w in ranked)
    for w in ranked:
        mass[state[w]] += c[w]
    once = Counter((lm.shape(w), state[w]) for w in ranked if c[w] == 1)
    home = [min(range(model.n_classes - 1), key=lambda k: (-once[s, k], k)) for s in range(lm.SHAPES)]
    home = [k if once[s, k] else first + s for s, k in enumerate(home)]
    moves, _ = contexts_and_table(train, state, ranked[:1])
    p = (moves + settings.alpha) / (moves.sum(axis=1, keepdims=True) + settings.alpha * len(moves))

    def cls(w):
        return state[w] if w in state else home[lm.shape(w)]

    def emission(w):
        k = cls(w)
        return 1.0 if w == lm.END else (c[w] + 1) / (mass[k] + kinds[k] + 1) if k in home else c[w] / mass[k]

    want = {d: sum(math.log10(p[cls(a), cls(b)] * emission(b)) for a, b in zip([lm.END, *tokens(t)], tokens(t))) for d, t, _ in rows}
    assert {r.doc_id: r.score for r in lm.score(chunks, model).collect()} == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("frequent", [50_000, 1000])
def test_rare_words_are_told_apart_by_their_neighbours(docs, frequent):
    rng = np.random.default_rng(3)
    name = lambda head, i: f"{head}{chr(97 + i // 26)}{chr(97 + i % 26)}"
    kinds = [[f"{head}{i:03d}x" for i in range(334)] for head in ("first", "second", "third")]
    picked = lambda k: kinds[k][rng.integers(334)]
    texts = [f"{picked(0)} {picked(1)} {picked(2)}" for _ in range(8000)]
    for i in range(60):  # in the place of words of the second kind, of the third
        texts += [f"{picked(0)} {name('za', i)} {picked(2)}" for _ in range(5)] + [f"{picked(0)} {picked(1)} {name('zb', i)}" for _ in range(5)]
    held = [i for i in range(12_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    learned = [i for i in range(12_000) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [*zip(learned, texts), *zip(held, ["first007x zaab third007x", "first007x zbab third007x", "first007x second007x zbab", "first007x second007x zaab"])]
    got = {r.doc_id: r for r in lm.perplexity_scores(docs(rows), settings=lm.Settings(frequent=frequent)).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score) and got[held[0]].n_known == 4
    assert got[held[0]].score > got[held[1]].score + 0.5 and got[held[2]].score > got[held[3]].score + 0.5
