"""Operator 13: whitening components of embeddings by shifted CholeskyQR.

Entries become whole numbers, so the sums of the fit list (each distinct vector once) are exact. The centred rows are never stored: a pass
centres a row, sends it through the triangular factors found so far and adds its products to a Gram matrix, of which each task hands on one.
The driver holds d x d matrices only. The first Gram matrix gets a shift, so that its Cholesky factor exists however badly
the columns depend on each other; the next passes orthogonalise what is left of the rows until the Gram matrix is the identity. Then the composed
factors R hold the centred rows as Q R with orthonormal Q, and the singular value decomposition of R gives the components
without ever squaring the condition of the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import stored

#: Vectors become floor(SCALE * entry).
SCALE = 256.0
#: Components of the registered query.
COMPONENTS = 4
#: Passes after which the factors are taken as they are; three or four are enough unless columns depend on each other.
PASSES = 12
#: Rows orthogonalised at once.
ROWS = 2048
_EPS = np.finfo(np.float64).eps
_LONG = 2 ** 63 - 1


@dataclass(frozen=True)
class Fit:
    """Sums of the fit list and the components found in it."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  #: eigenvalues, falling
    vectors: np.ndarray  #: one column for each component
    trace: float
    identity_error: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less their mean; whole and broken part of the mean go one after the other, so nothing is lost to large means."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        return (x - np.array(whole, dtype=np.int64)).astype(np.float64) - rest


def _vectors(df: DataFrame, vector: str, kept: dict) -> DataFrame:
    """``kept`` columns and ``x`` of the rows whose vector has finite entries only."""
    entries = F.col(f"`{vector}`").cast("array<double>")
    plain = df.select(*[c.alias(n) for n, c in kept.items()], entries.alias("x")).where(
        F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    limit = float(2 ** 62)
    return plain.withColumn("x", F.transform("x", lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * SCALE, F.lit(limit)), F.lit(-limit))), F.lit(2 ** 62)), F.lit(-2 ** 62)).cast("long")))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as rows; shorter ones end in zeros."""
    column = batch.column("x")
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < np.asarray(lengths)[:, None]] = flat
    return out


def _total(fit: DataFrame, width: int, product) -> np.ndarray:
    """Sum of the d x d matrices that ``product`` makes of blocks of rows; a task sums its own before anything is exchanged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch, width)
            for start in range(0, len(x), ROWS):
                part = product(x[start:start + ROWS])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"row": np.arange(len(total), dtype=np.int32), "entries": list(total)})

    parts = fit.mapInArrow(run, "row int, entries array<double>")
    sums = parts.select("row", F.posexplode("entries").alias("column", "v")).groupBy("row", "column").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((max((r.row for r in sums), default=-1) + 1,) * 2)
    for r in sums:
        out[r.row, r.column] = r.v
    return (out + out.T) / 2


def solve_rows(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangle, column by column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _through(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    for upper in factors:
        rows = solve_rows(rows, upper)
    return rows


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor; the shift grows only where rounding still leaves a negative pivot."""
    d = len(gram)
    norm = np.linalg.norm(gram, 2)
    shift = 11 * (n * d + d * (d + 1)) * _EPS / 2 * norm if shifted else 0.0
    shift = min(shift, 1e-8 * norm)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T.copy()
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 1e-14 * norm)


def _orthogonalise(rows: DataFrame, centre: Fit) -> np.ndarray:
    """R of the centred rows, composed from the factors of all passes."""
    width, factors, composed = centre.width, [], np.eye(centre.width)
    for step in range(PASSES):
        known = list(factors)

        def product(x: np.ndarray) -> np.ndarray:
            q = _through(centre.centred(x), known)
            return q.T @ q

        gram = _total(rows, width, product)
        norm = np.linalg.norm(gram, 2)
        if not norm:
            return np.zeros((width, width))
        if step:
            # directions that the data hold; the others have singular values of rounding size in R and shrink with every shifted pass
            held = np.linalg.eigvalsh(gram)
            live = held > 1e-6
            if np.abs(held[live] - 1).max(initial=0) < 1e-13 * width and (live.all() or _rank(composed, centre.n) <= live.sum()):
                break
        upper = _factor(gram, centre.n, step == 0 or np.linalg.eigvalsh(gram)[0] < 1e-6)
        factors.append(upper)
        composed = upper @ composed
    return composed


def _rank(r: np.ndarray, n: int) -> int:
    found = np.linalg.svd(r, compute_uv=False)
    return int((found > found[0] * max(len(r), 64) * np.sqrt(n) * _EPS).sum()) if found.size and found[0] else 0


def _distinct(df: DataFrame, vector: str) -> DataFrame:
    return stored(_vectors(df, vector, {}).distinct())


def fit(df: DataFrame, vector: str = "embedding", components: int | None = None) -> Fit:
    """Components of the distinct vectors of ``df``: all whose eigenvalue is not zero to double precision, or the first ``components``."""
    rows = _distinct(df, vector)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    found = rows.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).collect()
    sums = [0] * width
    for r in found:
        sums[r.place] = int(r.s)
    empty = Fit(n, tuple(sums), np.zeros(0), np.zeros((width, 0)), 0.0, 0.0)
    if not n or not width:
        return empty
    r = _orthogonalise(rows, empty)
    _, sigma, turned = np.linalg.svd(r)
    rank = _rank(r, n)
    values, vectors = sigma ** 2 / n, turned.T
    trace = float(values.sum())
    kept = rank if components is None else min(rank, components)
    model = Fit(n, tuple(sums), values[:kept], vectors[:, :kept], trace, 0.0)
    if not kept:
        return model

    def product(x: np.ndarray) -> np.ndarray:
        ones = np.ones((len(x), 1))
        w = np.hstack([whiten(model, x), ones])
        return w.T @ w

    total = _total(rows, width, product)
    mean = total[:kept, kept] / n
    error = np.abs(total[:kept, :kept] / n - np.outer(mean, mean) - np.eye(kept)).max()
    return Fit(n, model.sums, model.values, model.vectors, trace, float(error))


def whiten(model: Fit, x: np.ndarray) -> np.ndarray:
    """Rows on the components, over the root of their eigenvalues."""
    return model.centred(x) @ model.vectors / np.sqrt(model.values)


def _deviations(model: Fit, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 in whole numbers; None beyond 64 bits."""
    sums, n = np.array(model.sums, dtype=object), model.n
    most = max(max((abs(s) for s in model.sums), default=0), n * int(np.abs(x).max(initial=0)))
    if (2 * most) ** 2 * max(1, model.width) <= _LONG:
        gaps = n * x - np.array(model.sums, dtype=np.int64)
        return (gaps * gaps).sum(axis=1).tolist()
    exact = [int(v) for v in ((n * x.astype(object) - sums) ** 2).sum(axis=1)]
    return [v if v <= _LONG else None for v in exact]


def whitened(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, model: Fit | None = None) -> DataFrame:
    """A row (vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and component.

    Rows whose vector is null or holds a null, NaN or infinite entry give none; a null key stays null and repeated rows each give theirs. Vectors
    shorter than the longest end in zeros. Entries beyond 2^54 count as 2^54 (2^62 after scaling). Components without spread to double precision
    (constant or dependent dimensions, fewer vectors than dimensions) are left out, so a table with less than two different
    vectors, and an empty one, give no row. ``deviation`` is null where it does not fit a long. Columns other than key and vector are ignored and may have any name.
    """
    model = model or fit(df, vector, components)
    kept = min(components, len(model.values))
    model = Fit(model.n, model.sums, model.values[:kept], model.vectors[:, :kept], model.trace, model.identity_error)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not kept:
                continue
            x = _matrix(batch, model.width)
            ids = batch.column("vec_id").to_pylist()
            rows = len(ids) * kept
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i in ids for _ in range(kept)], pa.int64()), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(ids))),
                pa.array(np.full(rows, model.n, dtype=np.int64)), pa.array([v for v in _deviations(model, x) for _ in range(kept)], pa.int64()),
                pa.array(whiten(model, x).reshape(-1)), pa.array(np.tile(model.values / model.trace, len(ids))),
                pa.array(np.full(rows, model.identity_error))], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _vectors(df, vector, {"vec_id": F.col(f"`{key}`").cast("long")}).mapInArrow(run, schema)
