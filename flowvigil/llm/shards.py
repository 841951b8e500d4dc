"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: a start
and a step drawn from its name. The shards take turns and claim the next free slot of their
order until the table is full, so each has as many slots as any other, give or take one, and
a shard that comes or goes moves few slots. The table is broadcast - its size is a parameter -
and a key is placed by one hash and one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 2039


def draw(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:12], 16)


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """Number of the shard of each slot. ``slots`` must be a prime, larger than the number of shards."""
    if len(names) != len(set(names)) or not names or slots < len(names) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("names must differ, and slots be a prime not below their number")
    orders = [(draw(n, "offset") % slots, draw(n, "skip") % (slots - 1) + 1) for n in names]
    at, table, free = [0] * len(names), [-1] * slots, slots
    while free:
        for shard, (offset, skip) in enumerate(orders):
            while table[slot := (offset + at[shard] * skip) % slots] >= 0:
                at[shard] += 1
            table[slot] = shard
            free -= 1
            if not free:
                break
    return table


def slot_of(key: str, slots: int = SLOTS) -> Column:
    """The slot of a key: 48 bits of the MD5 of its text (null: of the empty text)."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """All columns of ``df`` with the slot (``_slot``) and shard number (``_shard``) of each row.

    Rows with equal keys go to one shard, however often a row is repeated and however long its key is; a null key is
    placed like an empty text, and an empty table gives no rows. Columns of ``df`` that have these two names already are
    replaced; a key of one of these names stays, and the new column has one underscore more. No shuffle.
    """
    slot, shard = ("_" + c if c == key else c for c in ("_slot", "_shard"))
    df = df.drop(slot, shard, *({"_slot", "_shard"} - {key}))
    table = df.sparkSession.createDataFrame(list(enumerate(fill(names, slots))), f"{slot} long, {shard} int")
    return df.withColumn(slot, slot_of(key, slots)).join(F.broadcast(table), slot)
