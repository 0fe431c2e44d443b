"""Operator 7: weighted rendezvous hashing of record keys over shards (built-in functions only).

Every (key, shard) pair has a hash u in (0, 1) and the score -weight / ln(u); a record goes to its
highest score. Adding a shard adds one candidate, so the only records that move are those that the
new shard wins. The law is therefore `key`: the record key and the shards decide, nothing else.

Slots number a shard's records without gaps. They come from two levels, so that no task ever holds
a shard: rows are counted in runs of at most 65,536 by their place in a staged table, a window over
those counts gives each run its first slot, and rows are numbered inside their run.

Edge cases: null text has no bytes (size 1, CRC of nothing); a null key hashes like the empty key;
equal keys share a shard and get slots of their own; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, staged

#: Rows numbered together, as a power of two.
RUN_BITS = 16


def unit_hash(key: Column, shard: int) -> Column:
    """A number inside (0, 1) from the key and the shard's name: 52 bits of a 64-bit hash."""
    mixed = F.xxhash64(F.lit(f"shard-{shard}"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.shiftrightunsigned(mixed, 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of the highest score; shards without weight take nothing."""
    scored = [
        F.struct((F.lit(-float(w)) / F.log(unit_hash(key, i))).alias("score"), F.lit(-i).alias("rank"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    if not scored:
        raise ValueError("no shard has a positive weight")
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["rank"]).cast("int")


def with_slots(placed: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without gaps; placed must be a staged table."""
    at = placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_run", F.shiftright("_at", RUN_BITS))
    runs = cut(at.groupBy(shard, "_run").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(shard).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    first = runs.select(shard, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(shard, "_run").orderBy("_at")
    numbered = at.withColumn("_in", F.row_number().over(inside) - 1)
    return numbered.join(first, [shard, "_run"]).withColumn(slot, (F.col("_first") + F.col("_in")).cast("long")).drop("_at", "_run", "_first", "_in")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard under grown_weights)."""
    key = F.col("doc_id").cast("long")
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    grown = rendezvous(key, grown_weights) if grown_weights else F.lit(None).cast("int")
    placed = docs.select(
        key.alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        grown.alias("grown_shard"),
    )
    return with_slots(staged(placed)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
