"""Placement of documents on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of an MD5 that make a key's 60-bit number.
KEY_DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:KEY_DIGITS], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int) -> list[int]:
    """The shard of each slot.

    Shard i prefers the slots ``(offset_i + j * skip_i) mod size`` in the order of j.
    Shards take turns, and each claims the first slot of its order that is free.
    ``size`` is prime, so each order visits every slot. Taking turns gives every
    shard the same number of slots, but for one.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each by a name of its own")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime not below the number of shards")
    offsets = [_number(f"offset:{s}") % size for s in shards]
    skips = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    slots, tried = [-1] * size, [0] * len(shards)
    for claim in range(size):
        i = claim % len(shards)
        while slots[slot := (offsets[i] + tried[i] * skips[i]) % size] >= 0:
            tried[i] += 1
        slots[slot] = i
    return slots


def slot_of(key: Column, size: int) -> Column:
    """A key's slot: 60 bits of the MD5 of its text, modulo the size. A null key is the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign(docs: DataFrame, key: str, shards: list[str], size: int) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (index into ``shards``).

    The table is one literal array of ``size`` integers, so its size is bounded by the
    argument and placement takes one lookup per row, without a shuffle. Rows of the
    same key, repeated or not, share a shard; a null key counts as the empty text; an
    empty input gives no rows. Columns of ``docs`` named slot or shard are replaced.
    """
    place = F.lit(lookup_table(shards, size))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("slot", "shard")]
    placed = docs.select(*kept, slot_of(F.col(f"`{key}`"), size).alias("slot"))
    return placed.withColumn("shard", F.element_at(place, F.col("slot") + 1))


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 4) -> None:
    """Writes each shard to a folder of its own. A random salt spreads a shard over its files."""
    salt = F.floor(F.rand(17) * files_per_shard)
    placed.repartition(F.col("shard"), salt).write.partitionBy("shard").parquet(path)
