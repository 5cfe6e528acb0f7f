"""Consistent sharding by a permutation-filled lookup table of prime size."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import quoted
from .common import fresh

#: Slots of the table; far more than shards, so that shares differ by little.
TABLE_SIZE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def hash_number(text: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{text}".encode()).digest()[:8], "big")


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard number of every slot.

    Every shard has its own order of preference over all slots, a start and a stride drawn from its name;
    the size is prime, so each stride visits every slot. In turn, each takes the first slot of its order
    that is still free. Slots, not rows, are filled here: the work is bounded by the size of the table.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > size or not is_prime(size):
        raise ValueError("sharding needs distinct shard names and a prime number of slots, at least one for each")
    start = [hash_number(s, "start") % size for s in shards]
    stride = [hash_number(s, "stride") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner, free = [-1] * size, size
    while free:
        for shard in range(min(len(shards), free)):
            while owner[start[shard]] >= 0:
                start[shard] = (start[shard] + stride[shard]) % size
            owner[start[shard]] = shard
            free -= 1
    return owner


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: 60 bits of its MD5, modulo the size. A null key is hashed like the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % size


def lookup_table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``slot, shard``: the filled table as a frame of ``size`` rows."""
    names = F.array(*[F.lit(s) for s in shards])
    owner = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",").cast("array<int>")
    return (spark.range(1).select(F.posexplode(owner).alias("slot", "owner"))
            .select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("owner") + 1).alias("shard")))


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The rows with ``slot`` (long) and ``shard``: one look-up per row in a broadcast table of ``size`` rows.

    Equal keys meet in one shard, repeated rows included; null keys count as the empty text. A shard that
    joins or leaves moves little more than its own share. Input columns named ``slot`` or ``shard`` are
    replaced (a key of such a name is read first). No row moves: there is no shuffle and no skew.
    """
    held = fresh(df, "_slot")
    table = lookup_table(df.sparkSession, shards, size)
    rest = [quoted(c) for c in df.columns if c.lower() not in ("slot", "shard")]
    return (df.select(*rest, slot_of(quoted(key), size).alias(held))
            .join(F.broadcast(table), F.col(held) == F.col("slot")).select(*rest, F.col("slot"), F.col("shard")))
