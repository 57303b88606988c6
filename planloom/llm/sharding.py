"""Operator 6: shards by a permutation-filled lookup table.

Each shard orders the slots of a table of prime size by a permutation of its own; the shards take turns, each claiming the first
free slot of its order, until the table is full. So every shard gets the same number of slots, give or take one, and when a shard
comes or goes few slots change hands. The table has a fixed size and is broadcast: a row's slot is a hash of its key,
and its shard stands in the slot. Rows are placed where they are read; nothing is shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots: a prime, some hundred times the number of shards.
SLOTS = 65537
#: Shards that ``shard`` makes where none are named.
SHARDS = 64


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard in each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots or not _prime(slots):
        raise ValueError("shards must be some different names, no more than the slots, whose number must be a prime")
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    table = [-1] * slots
    left = slots
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard (a number), shard_name: ``slots`` rows."""
    return spark.createDataFrame([(i, s, shards[s]) for i, s in enumerate(fill(shards, slots))], "slot int, shard int, shard_name string")


def slot_of(key, slots: int = SLOTS):
    """The slot of a key: 60 bits of the MD5 of its text, modulo the number of slots. A null key counts as an empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def shard(rows: DataFrame, shards: list[str] | int = SHARDS, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``rows`` with all their columns, and slot, shard and shard_name, which replace columns of these names.

    Rows with equal keys go to the same shard; so hot values of other columns (sources, copies of a text) are spread as their keys are.
    Null keys share a shard. An empty table gives an empty result. The table of slots is broadcast; its size is fixed by
    ``slots``.
    """
    names = shard_names(shards) if isinstance(shards, int) else list(shards)
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("slot", "shard", "shard_name")]
    placed = rows.select(*kept, slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    return placed.join(F.broadcast(lookup(rows.sparkSession, names, slots)), "slot", "left").select(*[F.col(f"`{c}`") for c in placed.columns if c != "slot"], "slot", "shard", "shard_name")


def write_shards(rows: DataFrame, path: str, shards: list[str] | int = SHARDS, key: str = "doc_id") -> None:
    """Writes one folder of Parquet files for each shard."""
    shard(rows, shards, key).write.partitionBy("shard_name").parquet(path)
