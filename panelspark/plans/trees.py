"""Boosted and bagged trees, one model for every region and walk-forward fold, in one job.

Values become codes: the number of quantile cuts below them, and one code for a missing value, so nothing is filled in. A level of a tree needs, of every open node, the sums of
residuals and weights by feature and code; running sums over the codes give the best cut, and on which side missing values do best. A level takes its best cuts first until the
budget of leaves is used up.

A model whose rows fit a task (``TASK_ROWS``) is trained inside one. The others grow together, level by level, each level one Spark aggregate over partial sums
of the tasks, so no task ever holds the rows of a large region. Both ways share the code that codes, sums, cuts and applies, and give the same trees.

Fitted models are a table: a row for each model with its trees as flat arrays, written, versioned and joined like any other data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.nulls import finite, nan_to_null
from panelspark.plans.ridge import FINAL, training_sets
from panelspark.session import discard, materialize, ship, stored

#: Rows of a model up to which it is trained in one task.
TASK_ROWS = 2_000_000
#: Tasks that train models, at most; each then trains several, one after the other.
MOST_TASKS = 20_000
#: Bytes of models up to which they are broadcast to the rows they predict; beyond, rows are grouped with their model.
BROADCAST_BYTES = 64 << 20
#: Rows of such a group, on average.
GROUP_ROWS = 200_000


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``least``: rows of a leaf; ``patience``: rounds without gain on ``validation`` of the rows before boosting stops;
    ``symmetric``: one cut for all nodes of a level; ``bagged``: trees on bootstrap weights, averaged, in place of boosting."""

    name: str
    rounds: int = 300
    rate: float = 0.05
    depth: int | None = None
    leaves: int | None = None
    l2: float = 1.0
    least: int = 1
    rows: float = 1.0
    columns: float = 1.0
    symmetric: bool = False
    bagged: bool = False
    patience: int | None = None
    validation: float = 0.1
    bins: int = 64
    seed: int = 42


# Parameters of the variants.
VARIANTS = {
    "hist_gb": Growth("HistGB", leaves=63, l2=0.1, least=20, patience=20),
    "xgboost": Growth("XGBoost", depth=6, rows=0.8, columns=0.8),
    "lightgbm": Growth("LightGBM", leaves=63, rows=0.8, columns=0.8, least=20),
    "lightgbm_gpu": Growth("LightGBM-GPU", leaves=63, rows=0.8, columns=0.8, least=20),
    "catboost": Growth("CatBoost", rounds=500, depth=6, l2=3.0, symmetric=True),
    "random_forest": Growth("RandomForest", rounds=200, l2=0.0, least=5, bagged=True),
}


def variant(key: str, **changes) -> Growth:
    if key not in VARIANTS:
        raise KeyError(f"unknown model {key}; known: {sorted(VARIANTS)}")
    return replace(VARIANTS[key], **changes)


# --- rows: codes, weights, sums ------------------------------------------------------------------

def codes_of(x: np.ndarray, cuts: list[np.ndarray], bins: int) -> np.ndarray:
    """Code of every value; ``bins`` stands for missing."""
    out = np.empty(x.shape, dtype=np.int16)
    for j, edges in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), bins, np.searchsorted(edges, x[:, j], side="left"))
    return out


def _uniform(rows: np.ndarray, stream: int) -> np.ndarray:
    """A number in [0, 1) for each row hash and stream, the same on every partitioning."""
    h = rows.view(np.uint64) ^ np.uint64((stream * 0x9E3779B97F4A7C15) % 2 ** 64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2 ** 53


_POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def held_back(rows: np.ndarray, growth: Growth) -> np.ndarray:
    return _uniform(rows, growth.seed) < growth.validation if growth.patience else np.zeros(len(rows), dtype=bool)


def weights(rows: np.ndarray, growth: Growth, step: int) -> np.ndarray:
    u = _uniform(rows, growth.seed + 1 + step)
    drawn = np.searchsorted(_POISSON, u, side="right").astype(np.float64) if growth.bagged else (u < growth.rows).astype(np.float64)
    return np.where(held_back(rows, growth), 0.0, drawn)


def columns(n: int, growth: Growth, step: int) -> np.ndarray:
    taken = max(1, int(np.ceil(n * growth.columns)))
    return np.arange(n) if taken == n else np.sort(np.random.default_rng([growth.seed, step]).choice(n, taken, replace=False))


def sums(codes: np.ndarray, slot: np.ndarray, slots: int, residual: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """(slots, features, bins + 1, 2): residuals and weights of the rows in open nodes."""
    here = (slot >= 0) & (weight > 0)
    codes, slot, weight, residual = codes[here], slot[here].astype(np.int64), weight[here], residual[here]
    features = codes.shape[1]
    place = ((slot[:, None] * features + np.arange(features)) * (bins + 1) + codes).ravel()
    size = slots * features * (bins + 1)
    both = [np.bincount(place, weights=np.repeat(v, features), minlength=size) for v in (residual * weight, weight)]
    return np.stack(both, axis=-1).reshape(slots, features, bins + 1, 2)


# --- trees ---------------------------------------------------------------------------------------

@dataclass
class Tree:
    """Flat arrays; node 0 is the root, feature -1 marks a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])
    level: int = 0

    def slots(self, node: np.ndarray) -> np.ndarray:
        """Place of each row's node among the open ones, or -1."""
        table = np.full(len(self.feature), -1, dtype=np.int64)
        table[self.open] = np.arange(len(self.open))
        return table[node]

    def advance(self, node: np.ndarray, codes: np.ndarray, bins: int) -> np.ndarray:
        """The node of each row one level down, where its node was split."""
        feature = np.array(self.feature)[node]
        inner = np.flatnonzero(feature >= 0)
        code = codes[inner, feature[inner]]
        goes_left = np.where(code == bins, np.array(self.missing_left)[node[inner]], code <= np.array(self.cut)[node[inner]])
        out = node.copy()
        out[inner] = np.array(self.left)[node[inner]] + ~goes_left
        return out

    def leaf(self, codes: np.ndarray, bins: int) -> np.ndarray:
        node = np.zeros(len(codes), dtype=np.int64)
        for _ in range(self.level):
            node = self.advance(node, codes, bins)
        return node

    def grow(self, found: np.ndarray, growth: Growth, taken: np.ndarray) -> bool:
        """Split open nodes by their sums; false if the tree is finished."""
        if not self.level:
            self.value[0] = _value(found[0, 0].sum(axis=0), growth)
        gains, left = _gains(found, growth, taken)
        flat = _settled(gains).reshape(len(gains), -1)
        if growth.symmetric:
            best = np.full(len(flat), int(np.where(np.isfinite(flat), flat, 0.0).sum(axis=0).argmax()))
            worth = np.full(len(flat), np.where(np.isfinite(flat), flat, 0.0).sum(axis=0).max())
        else:
            best, worth = flat.argmax(axis=1), flat.max(axis=1)
        room = len(self.feature) if growth.leaves is None else growth.leaves - (len(self.feature) + 1) // 2
        chosen = sorted(sorted((i for i in range(len(flat)) if worth[i] > 1e-12), key=lambda i: (-worth[i], i))[:room])
        opened = []
        for i in chosen:
            node = self.open[i]
            feature, cut, side = (int(v) for v in np.unravel_index(best[i], gains.shape[1:]))
            low = left[i, feature, cut, side]
            whole = found[i, 0].sum(axis=0)
            self.feature[node], self.cut[node], self.missing_left[node], self.left[node] = feature, cut, bool(side), len(self.feature)
            self.gain[node] = float(max(gains[i, feature, cut, side], 0.0)) if np.isfinite(gains[i, feature, cut, side]) else 0.0
            for part in (low, whole - low):
                opened.append(len(self.feature))
                self.feature.append(-1)
                self.cut.append(0)
                self.missing_left.append(False)
                self.left.append(-1)
                self.gain.append(0.0)
                self.value.append(_value(part, growth))
        self.open = opened
        if opened:
            self.level += 1
        return bool(opened) and (growth.depth is None or self.level < growth.depth)


def _value(part: np.ndarray, growth: Growth) -> float:
    rate = 1.0 / growth.rounds if growth.bagged else growth.rate
    return float(rate * part[0] / (part[1] + growth.l2)) if part[1] + growth.l2 > 0 else 0.0


def _gains(found: np.ndarray, growth: Growth, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain of each (node, feature, cut, side of missing values), and the sums left of it."""
    running = np.cumsum(found[:, :, :-1], axis=2)
    left = np.stack([running, running + found[:, :, -1:]], axis=3)
    whole = found[:, 0].sum(axis=1)[:, None, None, None]
    right = whole - left

    def score(part: np.ndarray) -> np.ndarray:
        return part[..., 0] ** 2 / np.maximum(part[..., 1] + growth.l2, 1e-300)

    gains = score(left) + score(right) - score(whole)
    gains[(left[..., 1] < growth.least) | (right[..., 1] < growth.least)] = -np.inf
    without = np.ones(found.shape[1], dtype=bool)
    without[taken] = False
    gains[:, without] = -np.inf
    # a side for missing values only where some are missing
    gains[..., 1][np.broadcast_to((found[:, :, -1, 1] == 0)[:, :, None], gains.shape[:-1])] = -np.inf
    return gains, left


def _settled(gains: np.ndarray) -> np.ndarray:
    """Gains without their last digits, which hang on the order of summation: cuts that part the rows alike stay tied, and the first one is taken."""
    finite = np.where(np.isfinite(gains), np.abs(gains), 0.0)
    unit = np.maximum(finite.reshape(len(gains), -1).max(axis=1), 1e-300) * 1e-10
    unit = unit[:, None, None, None]
    return np.round(gains / unit) * unit


@dataclass
class Boosting:
    """State of one model between rounds."""

    base: float
    trees: list[Tree] = field(default_factory=list)
    best: float = np.inf
    best_rounds: int = 0
    done: bool = False

    def judge(self, loss: float | None, growth: Growth) -> None:
        """Stop where the held-back rows have not gained for ``patience`` rounds; a model without such rows runs to the end."""
        if growth.patience and loss is not None:
            if loss < self.best - 1e-7:
                self.best, self.best_rounds = loss, len(self.trees)
            elif len(self.trees) - self.best_rounds >= growth.patience:
                self.done = True
        self.done |= len(self.trees) >= growth.rounds


def fit_rows(codes: np.ndarray, y: np.ndarray, rows: np.ndarray, growth: Growth) -> Boosting:
    """A model of rows in memory."""
    held = held_back(rows, growth)
    model = Boosting(float(y[~held].mean()) if (~held).any() else 0.0)
    margin = np.full(len(y), model.base)
    while not model.done:
        step = len(model.trees)
        tree, weight, taken = Tree(), weights(rows, growth, step), columns(codes.shape[1], growth, step)
        node, going = np.zeros(len(y), dtype=np.int64), True
        while going:
            found = sums(codes, tree.slots(node), len(tree.open), y - margin, weight, growth.bins)
            going = tree.grow(found, growth, taken)
            node = tree.advance(node, codes, growth.bins) if tree.open else node
        model.trees.append(tree)
        if not growth.bagged:
            margin = margin + np.array(tree.value)[node]
        model.judge(float(((y - margin)[held] ** 2).mean()) if held.any() else None, growth)
    return model


# --- models as a table -----------------------------------------------------------------------------

_ARRAYS = {"roots": "int", "node_feature": "int", "threshold": "double", "missing_left": "boolean", "child": "int", "value": "double", "importance": "double"}


def _row(model: Boosting, cuts: list[np.ndarray]) -> dict:
    """Trees one after the other; ``child`` is the left child, the right one follows it."""
    out: dict = {name: [] for name in _ARRAYS}
    importance = np.zeros(len(cuts))
    for tree in model.trees:
        start = len(out["value"])
        out["roots"].append(start)
        for f, b, m, left, v, g in zip(tree.feature, tree.cut, tree.missing_left, tree.left, tree.value, tree.gain, strict=True):
            out["node_feature"].append(f)
            out["threshold"].append(0.0 if f < 0 else float(cuts[f][b]) if b < len(cuts[f]) else float("inf"))
            out["missing_left"].append(m)
            out["child"].append(-1 if f < 0 else start + left)
            out["value"].append(v)
            if f >= 0:
                importance[f] += g
    total = importance.sum()
    return out | {"importance": (importance / total if total > 0 else importance).tolist(), "base": model.base,
                  "depth": max((t.level for t in model.trees), default=0), "n_trees": len(model.trees)}


def _cut_points(sets: DataFrame, group: list[str], features: list[str], bins: int) -> DataFrame:
    """Rows and quantile cuts of each model; up to 10,000 rows the quantiles are exact."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return sets.groupBy(*group).agg(F.count("*").alias("n_train"), F.array(*[
        F.coalesce(F.array_distinct(F.percentile_approx(c, at, F.lit(10_000))), F.array().cast("array<double>")) for c in features]).alias("cuts"))


def fit(df: DataFrame, keys: list[str], features: list[str], growth: Growth, target: str = "demand_mw", fold: str = "fold", task_rows: int = TASK_ROWS) -> DataFrame:
    """The models of all (keys, k): k = 0 to 4 are trained on the folds before k, k = 5 on all of them.

    Rows without a finite target train nothing. A feature that a region never has gets no split.
    """
    ship(df.sparkSession)
    values = {c: nan_to_null(F.col(c).cast("double")) for c in (*features, target)}
    rows = df.withColumns(values).where(finite(F.col(target)))
    named = rows.select(*keys, F.col(fold), F.col(target), F.array(*features).alias("x"), F.xxhash64(*keys, *features, target, fold).alias("row"), *features)
    sets = stored(training_sets(named, target, fold).withColumnRenamed(target, "y"))
    group = [*keys, "k"]
    cuts = stored(_cut_points(sets, group, features, growth.bins))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.select(*group).schema)
    schema = f"{kinds}, n_train long, base double, depth int, n_trees int, " + ", ".join(f"{n} array<{t}>" for n, t in _ARRAYS.items())

    def train(data: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        edges = [np.asarray(e, dtype=np.float64) for e in of["cuts"].iloc[0]]
        data = data.sort_values(["row", "y"], kind="stable")  # so that sums do not depend on the order of arrival
        x = np.vstack(data["x"].to_numpy()).astype(np.float64)
        model = fit_rows(codes_of(x, edges, growth.bins), data["y"].to_numpy(np.float64), data["row"].to_numpy(np.int64), growth)
        made = _row(model, edges) | {"n_train": int(of["n_train"].iloc[0])} | {c: of[c].iloc[0] for c in group}
        return pd.DataFrame([made])[[*group, "n_train", "base", "depth", "n_trees", *_ARRAYS]]

    few = cuts.where(F.col("n_train") <= task_rows)
    inside = sets.join(few.select(*group), group, "left_semi").select(*group, "x", "y", "row")
    # a stated number of partitions, since training costs far more than its bytes tell; models are dealt over at most that many tasks
    dealt = max(1, min(2 * few.count(), MOST_TASKS))
    models = inside.repartition(dealt, *group).groupBy(*group).cogroup(few.repartition(dealt, *group).groupBy(*group)).applyInPandas(train, schema)
    large = cuts.where(F.col("n_train") > task_rows).collect()  # bounded by rows / task_rows
    if large:
        models = models.unionByName(_fit_together(sets, large, group, growth, schema))
    return models


def _fit_together(sets: DataFrame, large: list, group: list[str], growth: Growth, schema: str) -> DataFrame:
    """Models with more rows than a task takes, all at once, level by level."""
    spark = sets.sparkSession
    number = spark.createDataFrame([(i, *[r[c] for c in group]) for i, r in enumerate(large)], "m int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.select(*group).schema))
    edges = [[np.asarray(e, dtype=np.float64) for e in r.cuts] for r in large]
    bins, features = growth.bins, len(edges[0])
    data = sets.join(F.broadcast(number), group).select("m", "row", "y", "x")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("m").to_numpy()
            x = np.array([[np.nan if v is None else v for v in r] for r in batch.column("x").to_pylist()], dtype=np.float64).reshape(-1, features)
            codes = np.empty(x.shape, dtype=np.int16)
            for i in np.unique(m):
                codes[m == i] = codes_of(x[m == i], edges[i], bins)
            yield pa.RecordBatch.from_arrays([batch.column("m"), batch.column("row"), batch.column("y"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("y")],
                                             names=["m", "row", "residual", "codes", "y"])

    rows = materialize(data.mapInArrow(code, "m int, row long, residual double, codes binary, y double"))

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        m = batch.column("m").to_numpy()
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.int16).reshape(-1, features)
        row, residual = np.array(batch.column("row").to_numpy()), np.array(batch.column("residual").to_numpy())
        for i in np.unique(m).tolist():
            here = m == i
            yield i, here, codes[here], row[here], residual[here]

    def totals(table: DataFrame, of) -> dict[int, np.ndarray]:
        """Sums over all tasks of the arrays that ``of`` makes of the rows of a model, one for each task and model before anything is exchanged."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, _, codes, row, residual in each(batch):
                    part = of(i, codes, row, residual)
                    if part is not None:
                        own[i] = own[i] + part if i in own else part
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([a.astype(np.float64).tobytes() for a in own.values()], pa.binary())], names=["m", "part"])

        def merge(rows: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(b, dtype=np.float64) for b in rows.column("part").to_pylist()], axis=0)
            return pa.table({"m": rows.column("m")[:1], "part": pa.array([total.tobytes()], pa.binary())})

        parts = table.mapInArrow(run, "m int, part binary").withColumn("salt", F.spark_partition_id() % 32)
        first = parts.groupBy("m", "salt").applyInArrow(lambda rows: merge(rows), "m int, part binary")
        return {r.m: np.frombuffer(bytes(r.part), dtype=np.float64) for r in first.groupBy("m").applyInArrow(lambda rows: merge(rows), "m int, part binary").collect()}

    def lowered(table: DataFrame, by: dict[int, float] | None, trees: dict[int, Tree]) -> DataFrame:
        """Residuals less a constant or less the values of a tree."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.array(batch.column("residual").to_numpy())
                for i, here, codes, _, residual in each(batch):
                    if by is not None:
                        out[here] = residual - by[i]
                    elif i in trees:
                        out[here] = residual - np.array(trees[i].value)[trees[i].leaf(codes, bins)]
                yield batch.set_column(2, "residual", pa.array(out))

        done = materialize(table.mapInArrow(run, table.schema))
        discard(table)
        return done

    def sizes(i: int, codes: np.ndarray, row: np.ndarray, residual: np.ndarray) -> np.ndarray:
        held = held_back(row, growth)
        return np.array([(~held).sum(), residual[~held].sum(), held.sum(), (residual[held] ** 2).sum()])

    found = totals(rows, sizes)
    models = {i: Boosting(float(t[1] / t[0]) if t[0] else 0.0) for i, t in found.items()}
    rows = lowered(rows, {i: m.base for i, m in models.items()}, {})
    while going := [i for i, m in models.items() if not m.done]:
        step = len(models[going[0]].trees)
        trees, taken = {i: Tree() for i in going}, columns(features, growth, step)
        unfinished = dict(trees)
        while unfinished:
            def of(i: int, codes: np.ndarray, row: np.ndarray, residual: np.ndarray, now=dict(unfinished), step=step) -> np.ndarray | None:
                if i not in now:
                    return None
                slot = now[i].slots(now[i].leaf(codes, bins))
                return sums(codes, slot, len(now[i].open), residual, weights(row, growth, step), bins).ravel()

            level = totals(rows, of)
            unfinished = {i: t for i, t in unfinished.items() if t.grow(level[i].reshape(len(t.open), features, bins + 1, 2), growth, taken)}
        if not growth.bagged:
            rows = lowered(rows, None, trees)
        losses = totals(rows, sizes) if growth.patience else {}
        for i in going:
            models[i].trees.append(trees[i])
            loss = losses.get(i)
            models[i].judge(float(loss[3] / loss[2]) if loss is not None and loss[2] else None, growth)
    discard(rows)
    made = [{**{c: large[i][c] for c in group}, "n_train": large[i].n_train, **_row(m, edges[i])} for i, m in models.items()]
    order = [*group, "n_train", "base", "depth", "n_trees", *_ARRAYS]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in made], schema)


def _walk(x: Column) -> Column:
    """Prediction of the model beside a row: every tree is walked from its root by array lookups."""
    def leaf(root: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            feature, child = F.get("node_feature", node), F.get("child", node)
            v = F.get(x, feature)
            left = F.when(v.isNull(), F.get("missing_left", node)).otherwise(v <= F.get("threshold", node))
            return F.when(feature < 0, node).when(left, child).otherwise(child + 1)

        return F.when(F.col("depth") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest("depth", F.lit(1))), root, step)).otherwise(root)

    return F.aggregate("roots", F.col("base"), lambda total, root: total + F.get("value", leaf(root)))


def predict(df: DataFrame, models: DataFrame, keys: list[str], features: list[str], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with ``prediction``; ``models`` has one row for each ``keys``. Rows without a model are left out.

    Models of a checked size are broadcast and walked in SQL. Larger ones go, once each, to groups of the rows they predict.
    """
    models = stored(models).select(*keys, "base", "depth", *[a for a in _ARRAYS if a != "importance"])
    size = models.agg(F.sum(F.size("value") * 25)).first()[0] or 0
    values = F.array(*[nan_to_null(F.col(c).cast("double")) for c in features])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    if size <= broadcast_bytes:
        joined = df.select(row, *keys, values.alias("_x")).join(F.broadcast(models), keys)
        return joined.select("_row.*", _walk(F.col("_x")).alias("prediction"))
    ship(df.sparkSession)
    kept = df.select(row, *keys, values.alias("_x"))
    counts = kept.groupBy(*keys).agg(F.ceil(F.count("*") / GROUP_ROWS).alias("_groups"))
    salted = kept.join(counts, keys).withColumn("_salt", F.pmod(F.xxhash64("_row", F.monotonically_increasing_id()), F.col("_groups"))).drop("_groups")
    copies = models.join(counts, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1))).drop("_groups")

    def run(rows: pa.Table, model: pa.Table) -> pa.Table:
        if not rows.num_rows or not model.num_rows:
            return pa.table({"_row": rows.column("_row")[:0], "prediction": pa.array([], pa.float64())})
        m = {n: np.array(model.column(n)[0].as_py()) for n in ("roots", "node_feature", "threshold", "missing_left", "child", "value")}
        x = np.array([[np.nan if v is None else v for v in r] for r in rows.column("_x").to_pylist()], dtype=np.float64)
        total = np.full(len(x), model.column("base")[0].as_py())
        for root in m["roots"]:
            node = np.full(len(x), root)
            for _ in range(model.column("depth")[0].as_py()):
                feature = m["node_feature"][node]
                v = x[np.arange(len(x)), np.maximum(feature, 0)]
                left = np.where(np.isnan(v), m["missing_left"][node], v <= m["threshold"][node])
                node = np.where(feature < 0, node, m["child"][node] + ~left)
            total += m["value"][node]
        return pa.table({"_row": rows.column("_row"), "prediction": pa.array(total)})

    from pyspark.sql import types as T

    schema = T.StructType([kept.schema["_row"], T.StructField("prediction", T.DoubleType())])
    done = salted.groupBy(*keys, "_salt").cogroup(copies.groupBy(*keys, "_salt")).applyInArrow(run, schema)
    return done.select("_row.*", "prediction")


def walk_forward_predictions(df: DataFrame, models: DataFrame, keys: list[str], features: list[str], fold: str = "fold") -> DataFrame:
    """Every validation row by the model trained on earlier folds."""
    rows = df.where(F.col(fold).between(0, FINAL - 1)).withColumn("k", F.col(fold))
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if getattr(df, "_is_stored", False) and len(df.inputFiles()) < tasks:  # a table of few files: walking trees costs more than dealing its rows
        rows = rows.repartition(tasks)
    return predict(rows, models, [*keys, "k"], features).drop("k")


def importance(models: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Share of each feature in the gain of all splits."""
    return models.select(*keys, "k", F.array(*[F.lit(c) for c in features]).alias("feature_names"), F.col("importance").alias("feature_importance"))


def publish(models: DataFrame, path: str, model: str, version: int) -> None:
    """Add models to a table of all versions."""
    models.withColumns({"model": F.lit(model), "version": F.lit(version)}).write.mode("append").partitionBy("model", "version").parquet(path)


def champion(table: DataFrame, keys: list[str]) -> DataFrame:
    """Of each (keys, k, model) the models of the newest version, found from the key columns alone."""
    group = [*keys, "k", "model"]
    newest = table.groupBy(*group).agg(F.max("version").alias("version"))
    return table.join(newest, [*group, "version"])
