"""Operator 6: sharding through a permutation-filled lookup table, in DataFrame operations only.

Every shard has its own order of preference over the slots of a table of prime size: from an offset on in steps of a skip, both from its name. Shards take
turns and each claims the first slot of its order that is still free, so each gets almost the same number. A row goes to the slot that the hash of its key
names. The table has as many rows as slots, whatever the data; it is broadcast, so a placement takes constant time and no row is moved. If a shard goes, the
others keep most of their slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table, a prime; the table is broadcast, and this bounds it.
SLOTS, MOST_SLOTS = 65_537, 1 << 22


def _digits(name: str, seed: str) -> int:
    return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:15], 16)


def lookup(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in ``shards``) of every slot."""
    if slots < 2 or slots > MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime up to {MOST_SLOTS}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be different names, no more than slots")
    place = [_digits(s, "offset") % slots for s in shards]
    skip = [_digits(s, "skip") % (slots - 1) + 1 for s in shards]
    owner, free, turn = [-1] * slots, slots, 0
    while free:
        while owner[place[turn]] >= 0:
            place[turn] = (place[turn] + skip[turn]) % slots
        owner[place[turn]] = turn
        free, turn = free - 1, (turn + 1) % len(shards)
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 15 hexadecimal digits of the MD5 of its text. A null key is the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots))


def table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    owner = lookup(shards, slots)
    return spark.createDataFrame([(i, s, shards[s]) for i, s in enumerate(owner)], "slot long, shard int, shard_name string")


def assign(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The rows of ``rows`` as one struct ``_row``, with ``slot``, ``shard`` and ``shard_name``.

    Rows with equal keys go to the same shard; null and empty keys share one. All columns are kept, whatever their names. An empty table gives no row.
    """
    placed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), slot_of(F.col(key), slots).alias("slot"))
    return placed.join(F.broadcast(table(rows.sparkSession, shards, slots)), "slot").select("_row", "slot", "shard", "shard_name")
