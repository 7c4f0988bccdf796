"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table, made
from two hashes of its name. Shards take turns; each claims the first slot of its order
that is still free, until the table is full. A key's slot is a hash of the key modulo the
table's size, so placing a row is one lookup, shards get equal numbers of slots (give or
take one), and a removed shard moves little more than its own keys. The table's size is a
parameter, whatever the data, so that it can be broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """By slot, the index of the shard that holds it."""
    if not _is_prime(slots):
        raise ValueError(f"{slots} slots: a prime is needed, so that every step visits all slots")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if len(shards) > slots:
        raise ValueError("more shards than slots")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    owner = [-1] * slots
    left = slots
    while True:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            owner[at[shard]] = shard
            left -= 1
            if not left:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text, modulo the table size; null counts as empty."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(slots))


def lookup_table(spark: SparkSession, shards: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): `slots` rows."""
    rows = [(slot, shards[shard]) for slot, shard in enumerate(fill(shards, slots))]
    return spark.createDataFrame(rows, "slot bigint, shard string")


def assign(
    docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, id_col: str = "doc_id"
) -> DataFrame:
    """One row per input row: doc_id, slot, shard.

    Equal ids share a shard, null ids the one of the empty key. An empty table gives no rows;
    other columns are never read."""
    names = lookup_table(docs.sparkSession, shards, slots)
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), slot_of(docs[f"`{id_col}`"], slots).alias("slot"))
    return rows.join(F.broadcast(names), "slot").select("doc_id", "slot", "shard")


def write_sharded(
    docs: DataFrame, path: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", parts: int = 1
) -> None:
    """Write all rows and columns as Parquet, a folder `shard=...` for each shard.

    Rows are dealt by shard and by one of `parts` hashes of the id, so that a shard's files are
    written by that many tasks. The docs must have no column called shard."""
    names = lookup_table(docs.sparkSession, shards, slots).select(F.col("slot").alias("__slot"), "shard")
    rows = docs.withColumn("__slot", slot_of(docs[f"`{id_col}`"], slots)).join(F.broadcast(names), "__slot").drop("__slot")
    part = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(parts))
    rows.repartition(F.col("shard"), part).write.partitionBy("shard").parquet(path)
