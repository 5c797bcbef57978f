"""Ridge regression per region for all walk-forward folds in one job.

Training rows of fold f belong to every later training set. No row is copied to these sets: medians and quartiles come from counts
made for all sets side by side, and each task scales a row for one set after the other while it sums the cross products
that the normal equations need. Sums are merged in two salted steps, so no task ever holds the rows of a region. Only
a (p + 2) x (p + 2) matrix per region and fold reaches the solver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.nulls import finite, nan_to_null
from panelspark.functions.scaling import CLIP
from panelspark.operators.quantiles import unpivot
from panelspark.operators.radix import order_statistics
from panelspark.session import ship, stored

#: Number of the training set that holds all folds but the hold-out (the final refit).
FINAL = 5
SALT = 64
#: Sums a task keeps before it hands them on.
MAX_OPEN = 256
#: Bytes of medians and scales that may be sent to every task as one table.
MAX_LOOKUP = 64 << 20


def training_sets(df: DataFrame, target: str, fold: str) -> DataFrame:
    """Copy every row with a target to the training sets (column ``k``) of later folds."""
    usable = df.where(F.col(fold).between(-1, FINAL - 1) & finite(F.col(target)))
    return usable.withColumn("k", F.explode(F.sequence(F.greatest(F.col(fold) + 1, F.lit(0)), F.lit(FINAL))))


def scaling_table(df: DataFrame, keys: list[str], features: list[str], fold: str) -> DataFrame:
    """(keys, k, medians, scales) of every training set: the exact median fills gaps, the spread is taken after filling.

    A feature without values gets 0 and 1. The filled values are those present with the median put in among them, so their
    quartiles are found by rank from the values present, and one pass counts for all sets side by side.
    """
    def spots(n: Column, m: Column) -> list[tuple[Column, Column]]:
        """(rank among the values present or null where the median stands, part beyond it) of both ends of q25, q50 and q75."""
        out, below = [], F.floor((n - 1) / 2) + 1
        for p in (0.25, 0.5, 0.75):
            position = F.lit(p) * ((n if p == 0.5 else n + m) - 1)
            for spot in (F.floor(position), F.ceil(position)):
                rank = spot if p == 0.5 else F.when(spot < below, spot).when(spot >= below + m, spot - m)
                out.append((rank, position - F.floor(position)))
        return out

    named = df.select(*keys, fold, *[F.col(c).cast("double").alias(str(i)) for i, c in enumerate(features)])
    long = unpivot(named, [*keys, fold], [str(i) for i in range(len(features))], "_feature", "_value")
    long._is_stored = True  # a projection of a written table
    sets = [F.col(fold) < k for k in range(FINAL + 1)]
    found = order_statistics(long, [*keys, "_feature"], "_value", lambda n, m: [rank for rank, _ in spots(n, m)], sets)
    ends = found.groupBy(*keys, F.col("_k").alias("k"), "_feature").agg(
        F.max("_n").alias("n"), F.max("_m").alias("m"), *[F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(f"x{i}") for i in range(6)])
    beyond = [part for _, part in spots(F.col("n"), F.col("m"))]

    def between(i: int, fill: Column | None = None) -> Column:
        low, high = (F.col(f"x{j}") if fill is None else F.coalesce(f"x{j}", fill) for j in (i, i + 1))
        return low + (high - low) * beyond[i]

    ends = ends.withColumn("median", between(2))
    ends = ends.withColumn("scale", F.coalesce(F.nullif(between(4, F.col("median")) - between(0, F.col("median")), F.lit(0.0)), F.lit(1.0)))
    by_name = ends.groupBy(*keys, "k").agg(F.map_from_entries(F.collect_list(F.struct("_feature", F.struct("median", "scale")))).alias("_by"))
    # Every training set with rows has a line, also where no feature has a value.
    rows = df.groupBy(*keys, fold).agg(F.lit(1).alias("_one"))
    present = rows.select(*keys, F.explode(F.sequence(F.greatest(F.col(fold) + 1, F.lit(0)), F.lit(FINAL))).alias("k")).distinct()
    out = present.join(by_name, [*keys, "k"], "left")

    def all_of(part: str, default: float) -> Column:
        return F.array(*[F.coalesce(F.col("_by")[str(i)][part], F.lit(default)) for i in range(len(features))])

    return out.select(*keys, "k", all_of("median", 0.0).alias("medians"), all_of("scale", 1.0).alias("scales"))


def _scaled(features: list[str]) -> Column:
    """Filled, centred, scaled and limited features as one array."""
    def one(i: int, c: str) -> Column:
        z = (F.coalesce(c, F.col("medians")[i]) - F.col("medians")[i]) / F.col("scales")[i]
        return F.greatest(F.least(z, F.lit(CLIP)), F.lit(-CLIP))

    return F.array(*[one(i, c) for i, c in enumerate(features)])


def _cross_products(keys: list[str], n_features: int, lookup):
    """Per task: one matrix of cross products of (1, z, y) for every training set seen. A row is scaled for each of its sets in turn."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, names = [*keys, "k"], [f"_x{i}" for i in range(n_features)]
        open_sums: dict[tuple, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame(list(open_sums), columns=group)
            out["gram"] = [g.ravel() for g in open_sums.values()]
            open_sums.clear()
            return out

        for batch in batches:
            for key, part in batch.groupby(keys, sort=False, dropna=False):
                x, y, fold = part[names].to_numpy(float), part["_y"].to_numpy(float), part["_fold"].to_numpy()
                missing = np.isnan(x)
                for of_set in lookup.value[key] if lookup else part["_sets"].iloc[0]:
                    k = of_set["k"]
                    mine = fold < k
                    if not mine.any():
                        continue
                    medians, scales = np.asarray(of_set["medians"]), np.asarray(of_set["scales"])
                    z = np.clip((np.where(missing[mine], medians, x[mine]) - medians) / scales, -CLIP, CLIP)
                    a = np.column_stack([np.ones(len(z)), z, y[mine]])
                    seen = open_sums.get((*key, k))
                    open_sums[(*key, k)] = a.T @ a if seen is None else seen + a.T @ a
            if len(open_sums) >= MAX_OPEN:
                yield rows()
        if open_sums:
            yield rows()

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf.iloc[[0]].copy()
    out["gram"] = [np.sum(np.vstack(pdf["gram"].to_numpy()), axis=0)]
    return out


def _solver(group: list[str], alpha: float):
    """Merge the remaining sums of one group and solve for intercept and coefficients."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.vstack(pdf["gram"].to_numpy()), axis=0)
        size = int(round(np.sqrt(total.size)))
        g = total.reshape(size, size)
        n, p = g[0, 0], size - 2
        mean_z, mean_y = g[0, 1:p + 1] / n, g[0, p + 1] / n
        zz = g[1:p + 1, 1:p + 1] - n * np.outer(mean_z, mean_z)
        zy = g[1:p + 1, p + 1] - n * mean_z * mean_y
        beta = np.linalg.solve(zz + alpha * np.eye(p), zy)
        out = pdf.iloc[[0]][group].copy()
        out["n_train"] = int(n)
        out["intercept"] = float(mean_y - mean_z @ beta)
        out["coefficients"] = [beta]
        return out

    return run


def fit(df: DataFrame, keys: list[str], features: list[str], target: str = "demand_mw", fold: str = "fold",
        alpha: float = 1.0, max_lookup: int = MAX_LOOKUP) -> DataFrame:
    """One row per (keys, k): medians, scales, intercept and coefficients; k = 5 is the final refit.

    Medians and scales of all sets go to the tasks as one table if its bytes stay within ``max_lookup``; a larger table is joined
    to the rows instead. Either way a row is read once for all its training sets, and only sums are exchanged. Rows without a
    key belong to no region.
    """
    ship(df.sparkSession)  # the functions below run in workers
    values = {c: nan_to_null(F.col(c).cast("double")) for c in (*features, target)}
    usable = df.withColumns(values).where(F.col(fold).between(-1, FINAL - 1) & finite(F.col(target))).dropna(subset=keys)
    usable = stored(usable.select(*keys, fold, target, *features))
    scaling = stored(scaling_table(usable, keys, features, fold))
    rows = usable.select(*keys, F.col(fold).alias("_fold"), F.col(target).alias("_y"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(features)])
    lookup = None
    if scaling.count() * len(features) * 16 <= max_lookup:
        table: dict[tuple, list] = {}
        for r in scaling.collect():
            table.setdefault(tuple(r[c] for c in keys), []).append({"k": r.k, "medians": np.array(r.medians), "scales": np.array(r.scales)})
        lookup = df.sparkSession.sparkContext.broadcast(table)
    else:
        sets = scaling.groupBy(*keys).agg(F.collect_list(F.struct("k", "medians", "scales")).alias("_sets"))
        rows = rows.join(sets, keys)
    group = [*keys, "k"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scaling.select(*group).schema.fields)
    partial = rows.mapInPandas(_cross_products(keys, len(features), lookup), f"{kinds}, gram array<double>")
    salted = partial.withColumn("_salt", (F.spark_partition_id() % SALT).cast("int"))
    merged = salted.groupBy(*group, "_salt").applyInPandas(_merge, f"{kinds}, gram array<double>, _salt int").drop("_salt")
    solved = merged.groupBy(*group).applyInPandas(
        _solver(group, alpha), f"{kinds}, n_train long, intercept double, coefficients array<double>")
    return scaling.join(solved, group)


def predict(df: DataFrame, model: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Add ``prediction``; ``model`` holds one row per key."""
    products = F.zip_with(_scaled(features), F.col("coefficients"), lambda z, b: z * b)
    total = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x) + F.col("intercept")
    values = {c: nan_to_null(F.col(c).cast("double")) for c in features}
    joined = df.withColumns(values).join(model, keys)
    return joined.select(*df.columns, total.alias("prediction"))


def walk_forward_predictions(df: DataFrame, model: DataFrame, keys: list[str], features: list[str],
                             fold: str = "fold") -> DataFrame:
    """Predict every validation row with the model trained on earlier folds."""
    rows = df.where(F.col(fold).between(0, FINAL - 1)).withColumn("k", F.col(fold))
    return predict(rows, model, [*keys, "k"], features).drop("k")


def importance(model: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """|coefficient x scale| of every feature, normalised to sum 1."""
    raw = F.zip_with("coefficients", "scales", lambda b, s: F.abs(b * s))
    total = F.aggregate("_raw", F.lit(0.0), lambda acc, x: acc + x)
    out = model.withColumn("_raw", raw).withColumn("_total", total)
    share = F.transform("_raw", lambda x: F.when(F.col("_total") > 0, x / F.col("_total")).otherwise(x))
    names = F.array(*[F.lit(c) for c in features])
    return out.select(*keys, "k", names.alias("feature_names"), share.alias("feature_importance"))
