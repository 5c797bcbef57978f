"""Window functions over long series, split into time blocks.

``Window.partitionBy(respondent)`` puts a whole series into one task. With few, long series (or one
series that holds a third of the rows) that is the bottleneck of the job. Here every row carries the
number of its time block, and rows close to a block border are copied to the neighbouring block (the
halo). A window is then partitioned by (keys, block), and copies are dropped afterwards. The result is the
same as that of the unsplit window as long as the halo covers the frame.

All frames count rows, so the input must be a gap-free grid (``cleaning.regular_grid``).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelspark.panel import Panel
from panelspark.session import stored

BLOCK = "_block"
OWN = "_own"


@dataclass(frozen=True)
class Over:
    """A window expression and how many rows it looks back and ahead."""

    build: Callable[[WindowSpec], Column]
    back: int = 0
    ahead: int = 0
    #: Helper columns evaluated before, level by level, and dropped afterwards.
    needs: tuple[Mapping[str, "Over | Column"], ...] = ()


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lag(c: str | Column, rows: int, default=None) -> Over:
    return Over(lambda w: F.lag(_col(c), rows, default).over(w), back=rows)


def lead(c: str | Column, rows: int) -> Over:
    return Over(lambda w: F.lead(_col(c), rows).over(w), ahead=rows)


def _finite(c: str | Column) -> Column:
    """The value as a double; NaN and infinite values count as missing."""
    value = _col(c).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


#: What is carried for an aggregate: number, sum, mean and squared deviations from the mean.
_CARRIED = {F.count: "n", F.sum: "ns", F.avg: "ns", F.stddev_samp: "nmq"}


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _doubled(c: str | Column, name: str, kinds: str, width: int, ahead: bool) -> list[dict[str, Over | Column]]:
    """Partial aggregates of the last (or, ``ahead``, the next) 1, 2, 4, ... rows with the current one, each made from two of half the length.

    Nothing is ever subtracted, so a value touches only the frames that hold it: a spike elsewhere in the
    block costs no digit, and the deviation of a constant stretch is exactly 0.
    """
    value = _finite(c)
    first = {"n": F.when(value.isNotNull(), 1.0).otherwise(0.0), "s": _or_zero(value), "m": value, "q": F.lit(0.0)}
    levels: list[dict[str, Over | Column]] = [{_part(k, 1, name, ahead): first[k] for k in kinds}]
    size = 1
    while 2 * size <= width:
        levels.append({_part(k, 2 * size, name, ahead): Over(lambda w, k=k, size=size: _joined(w, k, size, name, ahead)) for k in kinds})
        size *= 2
    return levels


def _part(kind: str, size: int, name: str, ahead: bool) -> str:
    return f"_{kind}{'f' if ahead and size > 1 else ''}{size}_{name}"


def _shifted(c: str, rows: int, w: WindowSpec) -> Column:
    return F.lag(c, -rows).over(w) if rows < 0 else F.lead(c, rows).over(w) if rows else F.col(c)


def _joined(w: WindowSpec, kind: str, size: int, name: str, ahead: bool) -> Column:
    def here(k: str) -> Column:
        return F.col(_part(k, size, name, ahead))

    def beside(k: str) -> Column:
        return _shifted(_part(k, size, name, ahead), size if ahead else -size, w)

    if kind in "ns":
        return here(kind) + _or_zero(beside(kind))
    n, m = _or_zero(beside("n")), beside("m")
    apart = m - here("m")
    if kind == "m":
        return F.coalesce(here("m") + apart * n / (here("n") + n), here("m"), m)
    return here("q") + _or_zero(beside("q")) + _or_zero(apart * apart * here("n") * n / (here("n") + n))


def _pieces(width: int) -> list[tuple[int, int]]:
    """(rows before it, size) of the powers of two that make up a width."""
    out, done = [], 0
    for bit in range(width.bit_length()):
        if width >> bit & 1:
            out.append((done, 1 << bit))
            done += 1 << bit
    return out


def _from_parts(agg: Callable, c: str | Column, start: int, end: int, min_periods: int) -> Over:
    """Count, sum, mean or sample deviation of the rows start ... end from partial aggregates.

    Rows up to the current one come from aggregates that look back and later rows from ones that look ahead, so that a frame may
    reach over either end of the series.
    """
    name = c if isinstance(c, str) else f"{zlib.crc32(str(c).encode()):08x}"
    kinds, last, next_one = _CARRIED[agg], min(end, 0), max(start, 1)
    sides = [(False, last - start + 1, last), (True, end - next_one + 1, next_one)]
    sides = [side for side in sides if side[1] > 0]
    needs: list[dict] = []
    for ahead, width, _ in sides:
        for level, columns in enumerate(_doubled(c, name, kinds, width, ahead)):
            needs[level:level + 1] = [(needs[level] if level < len(needs) else {}) | columns]

    # Pieces, their number and their mean are columns of their own, so that no expression is repeated inside another.
    tag = f"{start}_{end}_{name}".replace("-", "m")
    pieces = [(f"{i}_{tag}", size, ahead, first + done if ahead else first - done)
              for i, (ahead, first, done, size) in enumerate((a, f, d, n) for a, w, f in sides for d, n in _pieces(w))]
    needs.append({f"_{k}p{at}": Over(lambda w, k=k, size=size, ahead=ahead, row=row: _shifted(_part(k, size, name, ahead), row, w))
                  for at, size, ahead, row in pieces for k in kinds})

    def each(k: str) -> list[Column]:
        return [F.col(f"_{k}p{at}") for at, *_ in pieces]

    def total(values: list[Column]) -> Column:
        return reduce(add, [_or_zero(v) for v in values])

    n, near, mean = (F.col(f"_{x}_{tag}") for x in ("rows", "near", "mean"))
    needs.append({f"_rows_{tag}": total(each("n"))} | ({f"_near_{tag}": F.coalesce(*each("m"))} if "m" in kinds else {}))
    if "m" in kinds:
        needs.append({f"_mean_{tag}": near + F.try_divide(total([c * (m - near) for c, m in zip(each("n"), each("m"), strict=True)]), n)})

    def build(w: WindowSpec) -> Column:
        if agg is F.count:
            value = n.cast("long")
        elif "s" in kinds:
            value = F.when(n > 0, total(each("s")) if agg is F.sum else F.try_divide(total(each("s")), n))
        else:
            spread = [q for q in each("q")] + [c * (m - mean) * (m - mean) for c, m in zip(each("n"), each("m"), strict=True)]
            value = F.sqrt(F.try_divide(total(spread), n - 1))
        return F.when(n >= min_periods, value)

    return Over(build, back=max(0, -start), ahead=max(0, end), needs=tuple(needs))


def rolling(
    agg: Callable[[Column], Column],
    c: str | Column,
    width: int,
    min_periods: int = 1,
    offset: int = 0,
    center: bool = False,
) -> Over:
    """Rolling aggregate over ``width`` rows ending ``offset`` rows before the current one.

    NULL unless at least ``min_periods`` values are present. A centred even window reaches one row
    further back than ahead. Counts, sums, means and deviations take a number of steps per row that grows with the logarithm
    of the width, and count NaN and infinite values as missing; other aggregates look at each row of the frame.
    """
    if center:
        start, end = -(width // 2), (width - 1) // 2
    else:
        start, end = -(width - 1) - offset, -offset

    if agg in _CARRIED:
        return _from_parts(agg, c, start, end, min_periods)

    def build(w: WindowSpec) -> Column:
        frame = w.rowsBetween(start, end)
        value = _col(c)
        return F.when(F.count(value).over(frame) >= min_periods, agg(value).over(frame))

    return Over(build, back=max(0, -start), ahead=max(0, end))


def with_halo(df: DataFrame, panel: Panel, back: int, ahead: int) -> DataFrame:
    """Add the block number; copy rows near a border into the blocks whose frames reach them."""
    if max(back, ahead) > panel.block:
        raise ValueError(f"frame of {max(back, ahead)} rows does not fit a block of {panel.block} steps")
    slot = panel.slot()
    own = F.floor(slot / F.lit(panel.block)).cast("long")
    if back == 0 and ahead == 0:
        return df.withColumns({BLOCK: own, OWN: F.lit(True)})
    place = F.pmod(slot, F.lit(panel.block))
    targets = [own]
    if back:
        targets.append(F.when(place >= panel.block - back, own + 1))
    if ahead:
        targets.append(F.when(place < ahead, own - 1))
    return df.select(
        "*", own.alias("_home"), F.explode(F.array_compact(F.array(*targets))).alias(BLOCK)
    ).select(*df.columns, BLOCK, (F.col(BLOCK) == F.col("_home")).alias(OWN))


def block_window(panel: Panel) -> WindowSpec:
    return Window.partitionBy(*panel.keys, BLOCK).orderBy(panel.ts)


def apply_stages(df: DataFrame, panel: Panel, stages: tuple[Mapping[str, Over | Column], ...]) -> DataFrame:
    """Evaluate stages one after the other on a frame that already carries blocks."""
    w = block_window(panel)

    def extend(frame: DataFrame, columns: Mapping[str, Over | Column]) -> DataFrame:
        return frame.withColumns({n: e.build(w) if isinstance(e, Over) else e for n, e in columns.items()})

    for stage in stages:
        helpers: list[dict] = []
        for e in stage.values():
            for level, columns in enumerate(e.needs if isinstance(e, Over) else ()):
                if level == len(helpers):
                    helpers.append({})
                helpers[level].update(columns)
        for level in helpers:
            df = extend(df, level)
        df = extend(df, stage).drop(*[n for level in helpers for n in level])
    return df


def reach(*stages: Mapping[str, Over | Column]) -> tuple[int, int]:
    """Total look-back and look-ahead of stages that build on each other."""
    def widest(stage, attr):
        return max((getattr(e, attr) for e in stage.values() if isinstance(e, Over)), default=0)

    return sum(widest(s, "back") for s in stages), sum(widest(s, "ahead") for s in stages)


def over_blocks(df: DataFrame, panel: Panel, *stages: Mapping[str, Over | Column]) -> DataFrame:
    """Add the columns of every stage with one exchange on (keys, block) and one sort.

    A stage may use columns of earlier stages, also inside its own frames; the halo is the sum of the
    widest frames of the stages.
    """
    back, ahead = reach(*stages)
    out = apply_stages(with_halo(df, panel, back, ahead), panel, stages)
    return out.where(OWN).drop(BLOCK, OWN)


def row_position(df: DataFrame, panel: Panel, position: str = "row_no", total: str | None = None) -> DataFrame:
    """1-based position of every row within its series (and the series length), for any series.

    Rows are counted per block, the small table of counts gets a running sum, and positions within
    a block are added to it. No task holds a whole series.
    """
    df = stored(df)
    blocked = with_halo(df, panel, 0, 0).drop(OWN)
    series = Window.partitionBy(*panel.keys)
    counts = blocked.groupBy(*panel.keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(series.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    cols = [F.coalesce(before, F.lit(0)).alias("_before")]
    if total:
        cols.append(F.sum("_n").over(series).alias(total))
    offsets = counts.select(*panel.keys, BLOCK, *cols)
    joined = blocked.join(offsets, [*panel.keys, BLOCK])
    out = joined.withColumn(position, F.row_number().over(block_window(panel)) + F.col("_before"))
    keep = [*df.columns, position, *([total] if total else [])]
    return out.select(*keep)
