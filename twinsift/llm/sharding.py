"""Sharding by jump consistent hash (Lamping and Veach, 2014).

A row's stable key alone decides its shard, without a ring table; when one
shard is appended, a row either stays or moves into the new one.

The 64-bit congruential generator is computed on 32-bit halves kept in longs,
because SQL integers do not wrap. Each row runs its own short loop inside one
projection, so the assignment needs no shuffle. Slots are dealt in two steps:
counts for each (shard, bucket) give offsets, and rows are numbered inside
their bucket only.

Defined results: a null key is a key like any other; equal keys share a shard;
a null text has no bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.llm.common import documents

SHARDS = 40
OVERHEAD = 16
#: The generator's multiplier, 2862933555777941757, in halves.
HI, LO = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
M32, M16 = 0xFFFFFFFF, 0xFFFF


def key_halves(key: Column) -> Column:
    """The first 64 bits of the md5 of a key's text, as a struct (hi, lo)."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.struct(part(1).alias("hi"), part(9).alias("lo"))


def _times(a: Column, c: int) -> Column:
    """Low 32 bits of a 32-bit value times a 32-bit constant."""
    high = F.shiftrightunsigned(a, 16) * c
    return ((a.bitwiseAND(M16)) * c + F.shiftleft(high.bitwiseAND(M16), 16)).bitwiseAND(M32)


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * multiplier + 1, modulo 2 ** 64."""
    top = F.shiftrightunsigned(lo, 16) * LO
    low = lo.bitwiseAND(M16) * LO + F.shiftleft(top.bitwiseAND(M16), 16) + 1
    carry = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(top, 16)
    return (_times(hi, LO) + _times(lo, HI) + carry).bitwiseAND(M32), low.bitwiseAND(M32)


def jump_hash(halves: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a key given by :func:`key_halves`."""

    def step(s: Column, _: Column) -> Column:
        hi, lo = _advance(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1).cast("double") * (float(1 << 31) / (F.shiftrightunsigned(hi, 1) + 1).cast("double")))
        moved = F.struct(s["j"].alias("b"), jump.cast("long").alias("j"), hi.alias("hi"), lo.alias("lo"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    def run(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), halves["hi"].alias("hi"), halves["lo"].alias("lo"))
    few = min(shards, 8 + 3 * math.ceil(math.log2(shards + 1)))
    # nearly every key ends within few steps; no key needs more than one for each shard
    ended = F.transform(F.array(run(start, few)), lambda s: F.when(s["j"] < shards, run(s, shards)).otherwise(s))[0]
    return ended["b"].cast("int")


def assign(df: DataFrame, key: Column, shards: int, shard: str = "shard") -> DataFrame:
    """``df`` with the column ``shard``, which replaces one of that name."""
    if shards < 1:
        raise ValueError("shards must be positive")
    return df.withColumn(shard, jump_hash(key_halves(key), shards))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slot_buckets: int = 1024) -> DataFrame:
    """Assign every document and number the rows of each shard from 0.

    Rows in a (shard, bucket) are numbered by one task; ``slot_buckets`` is the
    number of buckets in a shard, so raise it with the row count.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    halves = key_halves(F.col("doc_id"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
        jump_hash(halves, shards).alias("shard"),
        jump_hash(halves, shards + 1).alias("grown_shard"),
    ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slot_buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("offset")).cast("long").alias("slot"), "grown_shard")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
