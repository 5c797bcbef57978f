"""Exact quantiles per group by radix selection, without holding a group in one task.

A double becomes a 64-bit code in the same order. Rows are counted by the leading bits of their codes, and running
counts name the cell that holds a wanted rank; further passes look only inside these cells, by the next bits.
After the last pass a cell is one value. Counts are made where the rows lie, so only cells are exchanged, and no pass orders
more than 2 ** 22 cells of a group, whatever the number of rows. Nested sets of rows (training sets) are counted side by
side in the same pass, so no row is copied. Each pass is a job, so on small inputs the brackets of ``quantiles`` are faster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import materialize, small, stored

#: Bits of the code that each pass looks at; 64 in all.
DIGITS = (22, 21, 21)


def order_code(v: Column) -> Column:
    """A 64-bit integer in the order of the doubles ``v``: sign, exponent and fraction, by exact arithmetic.

    0.0 and -0.0 have code 0; infinities come after all finite values of their sign and NaN after everything, as in Spark's own order.
    """
    magnitude = F.abs(v)
    size = F.when((magnitude > 0) & (magnitude < float("inf")), magnitude)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(-1022)).cast("int")
    power = F.pow(F.lit(2.0), guess)
    # The logarithm is rounded, so next to a power of two the guess may be one off.
    exponent = guess + F.when(size < power, -1).when(size / 2 >= power, 1).otherwise(0)
    exponent = F.greatest(exponent, F.lit(-1022))
    fraction = (size / F.pow(F.lit(2.0), exponent) * F.lit(2.0 ** 52)).cast("long")
    bits = F.shiftleft((exponent + 1022).cast("long"), 52) + fraction
    top = F.lit(2047 << 52)
    code = F.when(v == 0, F.lit(0).cast("long")).when(magnitude == float("inf"), top).otherwise(bits)
    return F.when(F.isnan(v), top + 1).when(v < 0, -code).otherwise(code)


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: Callable[[Column, Column], list[Column]],
                     sets: list[Column] | None = None) -> DataFrame:
    """Values at given ranks: rows (keys, _k, _i, _n, _m, _x) for entry ``_i`` of ``ranks`` in set ``_k`` of a group.

    ``ranks(n, m)`` gives ranks from 0 on, given the counts of values (``n``) and of nulls (``m``); a rank that is null or
    outside of the values gives no row. ``sets`` are conditions on the columns of ``df``; a row may lie in many. Without them there is one set of all rows.
    """
    sets = sets or [F.lit(True)]
    data = stored(df).select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_v"), *[c.alias(f"_in{k}") for k, c in enumerate(sets)])
    data = data.withColumn("_code", order_code(F.col("_v")))
    members = [F.count(F.when(F.col(f"_in{k}"), 1)) for k in range(len(sets))]
    found, seen = None, 0
    for bits in DIGITS:
        first, seen = found is None, seen + bits
        group = keys if first else [*keys, "_prefix"]
        rows = data
        if not first:
            prefix = F.shiftright("_code", 64 - seen + bits)
            rows = data.withColumn("_prefix", prefix).join(found.select(*group), group, "left_semi")
        cells = rows.groupBy(*group, F.shiftright("_code", 64 - seen).alias("_cell")).agg(
            F.min("_v").alias("_x"), *[c.alias(f"_c{k}") for k, c in enumerate(members)])
        whole = Window.partitionBy(*group)
        before = whole.orderBy(F.col("_cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)

        def total(k: int, w: Window, null: bool = False) -> Column:
            wanted = F.col("_cell").isNull() if null else F.col("_cell").isNotNull()
            return F.coalesce(F.sum(F.when(wanted, F.col(f"_c{k}"))).over(w), F.lit(0))

        placed = cells.withColumns({f"_b{k}": total(k, before) for k in range(len(sets))})
        if first:
            placed = placed.withColumns({
                **{f"_n{k}": total(k, whole) for k in range(len(sets))}, **{f"_m{k}": total(k, whole, True) for k in range(len(sets))}})
            wanted = F.array(*[
                F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.col(f"_n{k}").alias("n"), F.col(f"_m{k}").alias("m"), rank.cast("long").alias("rank"))
                for k in range(len(sets)) for i, rank in enumerate(ranks(F.col(f"_n{k}"), F.col(f"_m{k}")))])
        else:
            placed, wanted = placed.join(found, group), F.col("_wanted")
        counts = F.array(*[F.col(f"_c{k}") for k in range(len(sets))])
        starts = F.array(*[F.col(f"_b{k}") for k in range(len(sets))])
        placed = placed.where("_cell IS NOT NULL").select(*keys, "_cell", "_x", counts.alias("_c"), starts.alias("_b"), wanted.alias("_w"))
        hit = F.filter("_w", lambda t: (F.get("_b", t["k"]) <= t["rank"]) & (t["rank"] < F.get("_b", t["k"]) + F.get("_c", t["k"])))
        inside = F.transform(hit, lambda t: t.withField("rank", t["rank"] - F.get("_b", t["k"])))
        placed = placed.withColumn("_wanted", inside).where(F.size("_wanted") > 0)
        if seen < sum(DIGITS):
            found = small(materialize(placed.select(*keys, F.col("_cell").alias("_prefix"), "_wanted")))
    return placed.select(*keys, "_x", F.explode("_wanted").alias("_t")).select(*keys, *[F.col(f"_t.{c}").alias(f"_{c}") for c in "kinm"], "_x")


def radix_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], count: str | None = None) -> DataFrame:
    """One row per group with one column per entry of ``probs`` (linearly interpolated) and, if named, the value count."""
    names = list(probs)

    def ranks(n: Column, m: Column) -> list[Column]:
        return [edge(F.lit(float(p)) * (n - 1)) for p in probs.values() for edge in (F.floor, F.ceil)]

    found = order_statistics(df, keys, value, ranks)
    ends = found.groupBy(*keys).agg(
        F.max("_n").alias("_n"), *[F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(f"_x{i}") for i in range(2 * len(names))])

    def between(j: int, p: float) -> Column:
        position = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col(f"_x{2 * j}"), F.col(f"_x{2 * j + 1}")
        return low + (high - low) * (position - F.floor(position))

    out = [between(j, p).alias(name) for j, (name, p) in enumerate(probs.items())]
    return ends.select(*keys, *out, *([F.col("_n").alias(count)] if count else []))
