"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table: offset + i * skip.
Shards take turns, each claiming its next free slot in that order, until the table is full;
so shares differ by one slot at most, and when a shard comes or goes few slots change hands.
The table's size is a constant, so the driver fills it; documents find their shard by a
broadcast hash join on their slot.

Defined cases: a null key goes to the slot of the text 'null'; repeated keys share a shard;
an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Slots; a prime of at least a hundred times the shards keeps shares even. This also bounds the broadcast.
SLOTS = 65_537
SHARDS = 64


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Slot -> index of the shard that claimed it."""
    if not _prime(slots) or not shards or len(shards) > slots or len(set(shards)) < len(shards):
        raise ValueError("slots must be prime, and distinct shards at most as many")
    first, skip = [], []
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        first.append(int.from_bytes(d[:8], "big") % slots)
        skip.append(int.from_bytes(d[8:16], "big") % (slots - 1) + 1)
    table, at, free = [-1] * slots, first, slots
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def table_frame(spark: SparkSession, table: list[int]) -> DataFrame:
    """slot int, shard int; made inside the JVM from one text."""
    text = ",".join(map(str, table))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key, slots: int = SLOTS):
    """The first 60 bits of the key's MD5, modulo the slots."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """df with slot and shard; nothing is shuffled. Columns of those names give way to the results; all others stay."""
    shards = shards or [f"shard-{i}" for i in range(SHARDS)]
    kept = df.drop("slot", "shard")
    at, held = common.fresh(kept, "at_slot", "at_shard")
    table = table_frame(df.sparkSession, fill(shards, slots)).withColumnsRenamed({"slot": at, "shard": held})
    keyed = kept.withColumn("slot", slot_of(F.col(key), slots))
    return keyed.join(F.broadcast(table), F.col("slot") == F.col(at), "inner").drop(at).withColumnRenamed(held, "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return place(docs.select("doc_id", "source", F.octet_length(common.whole_text()).cast("long").alias("n_bytes")))
