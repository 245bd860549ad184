"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table.  The shards
take turns; on its turn a shard claims its most preferred slot that is still free.  The
finished table is a broadcast: a key's slot is its hash modulo the size, and the slot names
the shard.  Shards get equal shares to within one slot, and when a shard leaves or joins few
other slots change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

TABLE_SIZE = 65537  # prime; at least a hundred slots per shard keeps the shares even


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index into ``shards``.  Memory and time follow ``size``, never the data."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be a non-empty list of distinct names")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)) or size < len(shards):
        raise ValueError("size must be a prime not below the number of shards")
    start = [_number(f"offset:{s}") % size for s in shards]
    step = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    at, owner, free = start[:], [-1] * size, size
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def key_slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """60 bits of the key's MD5, modulo the table size.  A null key counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE,
                  slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` plus its slot and shard; no shuffle.

    The table is broadcast: it has exactly ``size`` rows, whatever the data.  Null keys all go
    to the shard of the empty key; repeated rows go to the same shard; an empty table gives an
    empty table.  Columns of ``df`` that are called like the two new ones are replaced.
    """
    spark = df.sparkSession
    owner = lookup_table(shards, size)
    at, shard = free_name(df, "_slot"), free_name(df, "_shard")
    rows = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(owner)],
                                 T.StructType([T.StructField(at, T.IntegerType()),
                                               T.StructField(shard, T.StringType())]))
    out = df.withColumn(at, key_slot(F.col(key), size)).join(F.broadcast(rows), at, "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in (slot_col.lower(), shard_col.lower())],
                      F.col(at).alias(slot_col), F.col(shard).alias(shard_col))


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, size: int = TABLE_SIZE,
                 files_per_shard: int = 8) -> None:
    """One folder per shard (``shard=<name>``); null keys, repeated rows and empty tables as in
    ``assign_shards``, and columns called slot or shard are replaced as there; each shard's rows are spread over ``files_per_shard`` tasks, so a
    shard that holds most rows is not one task's work."""
    placed = assign_shards(df, key, shards, size)
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(files_per_shard))
    (placed.repartition(len(shards) * files_per_shard, "shard", part)
     .write.mode("overwrite").partitionBy("shard").parquet(path))
