"""Whitening against numpy on the whole fit list."""

import numpy as np
import pytest
from cases import SF
from pyspark.sql import functions as F

from panelspark.llm import whitening


def slow(vectors, components=4):
    """Distinct vectors, their sums, and eigenvalues and eigenvectors of the covariance."""
    x = [np.floor(256 * np.asarray(v, dtype=np.float64)).astype(np.int64) for v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    distinct = np.array(sorted({tuple(int(c) for c in v) for v in x}), dtype=np.int64)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return n, [int(s) for s in sums], e[::-1][:components], u[:, ::-1][:, :components], e.sum()


def check(spark, frame, rows):
    got = whitening.whitened(frame).collect()
    n, sums, e, u, trace = slow([v for _, v in rows])
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == len(good) * min(4, len(e))
    signs = {}
    for i, v in good:
        x = [int(c) for c in np.floor(256 * np.asarray(v, dtype=np.float64))]
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for j in range(len(e)):
            for r in by[i, j + 1]:
                assert (r.n, r.deviation) == (n, deviation)
                assert r.explained == pytest.approx(e[j] / trace, rel=1e-9) and r.identity_error < 1e-9
                want = (np.array(x) - np.array(sums) / n) @ u[:, j] / np.sqrt(e[j])
                if abs(want) > 1e-3:
                    assert signs.setdefault(j, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
                assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-6, abs=1e-8)


def test_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    check(spark, table, [(r.vec_id, r.embedding) for r in table.collect()])


def test_nulls_repeats_and_odd_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [9, 5, 3, 1, 1]]) for i in range(60)] + [(60 + i, None) for i in range(2)]
    rows += [(70, [1.0, None, 0.0, 0.0, 0.0]), (71, [float("nan")] * 5), (72, [float("inf"), 0.0, 0.0, 0.0, 0.0])] + [(80 + i, rows[0][1]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("x")).withColumn("n", F.lit(1)).withColumn("a b", F.lit(2))
    check(spark, frame, rows)


def test_ill_conditioned_and_dependent_columns(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 3)) * [3e6, 40, 2]
    rows = [(i, [float(c) for c in (*b, b[0], 7.0)]) for i, b in enumerate(np.round(base))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(frame)
    x = np.array([v for _, v in rows]) * 256
    e = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2 / len(x)
    assert len(model.values) == 3 and model.identity_error < 1e-6
    np.testing.assert_allclose(model.values, e[:3], rtol=1e-8)
    assert {r.component for r in whitening.whitened(frame).collect()} == {1, 2, 3}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (None, [1.0]), (2, [])], [(1, []), (2, [])]])
def test_tables_without_spread(spark, rows):
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    # [1.0] and the empty vector, which ends in zeros, differ in one dimension
    assert len(got) == (3 if len(rows) == 3 else 0)


def test_deviation_beyond_a_long(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, 2.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and {r.deviation for r in got if r.vec_id < 3} == {None}
