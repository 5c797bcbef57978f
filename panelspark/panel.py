"""Description of a panel: which columns identify a series and how it is spaced."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
DAY = 86400


@dataclass(frozen=True)
class Panel:
    """Keys and spacing of a set of series.

    ``block`` is the number of steps kept together in one window group. A series of any length is cut
    into blocks, so that no single task ever has to hold one whole series (see ``operators.blocks``).
    """

    keys: tuple[str, ...] = ("respondent",)
    ts: str = "period"
    step: int = HOUR
    block: int = 4096

    def with_(self, **changes) -> "Panel":
        return replace(self, **changes)

    def slot(self, ts: Column | None = None) -> Column:
        """Number of whole steps since the epoch."""
        col = F.col(self.ts) if ts is None else ts
        return F.floor(F.unix_seconds(col.cast("timestamp")) / F.lit(self.step)).cast("long")

    def slot_start(self, slot: Column) -> Column:
        """Inverse of ``slot``: the (zone-free) timestamp at which a step starts."""
        return F.timestamp_seconds(slot * F.lit(self.step)).cast("timestamp_ntz")

    def shift(self, steps: int, ts: Column | None = None) -> Column:
        """The time ``steps`` steps later."""
        col = F.col(self.ts) if ts is None else ts
        return col + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(steps * self.step)))
