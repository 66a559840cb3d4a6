"""Sharding by a permutation-filled lookup table of prime size.

Every shard has a permutation of the table's slots, (offset + skip * j) mod size, from two hashes of its name. In turns, in order of
names, each shard claims its next free slot; a shard of weight w claims w slots a turn. A row's hash picks a slot, and the table, whose size is
fixed, is broadcast. Taking a shard away moves little more than its own rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime, far more than the shards.
SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: dict[str, int] | list[str] | tuple[str, ...], size: int = SIZE) -> list[str]:
    """The shard of each slot. Names are distinct; weights are whole and positive."""
    weight = shards if isinstance(shards, dict) else dict.fromkeys(shards, 1)
    if not weight or min(weight.values()) < 1 or len(weight) > size:
        raise ValueError("there must be shards, of positive weights, and no more than slots")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    names = sorted(weight)
    at = {n: _hash(n, "offset") % size for n in names}
    skip = {n: _hash(n, "skip") % (size - 1) + 1 for n in names}
    slots: list[str | None] = [None] * size
    left = size
    while left:
        for n in names:
            for _ in range(min(weight[n], left)):
                while slots[at[n]] is not None:
                    at[n] = (at[n] + skip[n]) % size
                slots[at[n]] = n
                left -= 1
    return slots


def place(rows: DataFrame, key: str = "doc_id", shards: dict[str, int] | list[str] | tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """Add slot (int) and shard (string) to every row. Equal keys, repeated rows included, share a slot; null keys share one slot as well.
    Columns of those names are replaced (one of them may still be the key); all others stay. An empty table gives no rows."""
    slots = rows.sparkSession.createDataFrame(list(enumerate(fill_table(shards, size))), "meridian_slot int, meridian_shard string")
    slot = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(size)).cast("int")
    kept = [c for c in rows.columns if c not in ("slot", "shard")]
    hashed = rows.withColumn("meridian_slot", slot).select(*kept, "meridian_slot")
    return hashed.join(F.broadcast(slots), "meridian_slot").select(*kept, F.col("meridian_slot").alias("slot"), F.col("meridian_shard").alias("shard"))


def write_shards(rows: DataFrame, path: str, key: str = "doc_id", shards: dict[str, int] | list[str] | tuple[str, ...] = SHARDS, size: int = SIZE, tasks: int = 4) -> None:
    """Write one folder a shard. Each shard is dealt over `tasks` tasks by the row's content, so a key that holds many rows is split."""
    placed = place(rows, key, shards, size)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(tasks))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
