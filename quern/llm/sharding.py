"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions alone.

Each (key, shard) pair has a hash u in (0, 1) and the shard with the greatest weight / -ln(u) takes the record.
A record's shard depends on its key and the shards only; a new shard takes records into itself and moves no other.

Slots number a shard's records without gaps. Records are dealt by (shard, slice of the key's hash, salt of the
reading task), so neither a shard nor one repeated key meets in one task; the counts of these groups, a bounded
table, give each group's first slot.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import written

SLICES, SALTS = 256, 16


def score(key: Column, shard: int, weight: float) -> Column:
    """The record's score at a shard, from the upper 52 bits of a 64-bit hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12).cast("double") + 0.5) / float(1 << 52)
    return F.lit(float(weight)) / -F.log(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that takes a key; of equal scores the later shard's."""
    if not weights or not all(w > 0 and math.isfinite(w) for w in weights):
        raise ValueError("weights must be positive numbers")
    return F.array_max(F.array(*(F.struct(score(key, i, w).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights))))["i"]


def with_slots(rows: DataFrame, shard: str, key: str) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... within each shard, by key hash.

    The rows are written once: a task's number, which salts them, may be another when they are computed again.
    """
    groups = [shard, "_slice", "_salt"]
    dealt = written(rows.withColumns({"_hash": F.xxhash64(key), "_salt": F.spark_partition_id() % SALTS}).withColumn("_slice", F.shiftrightunsigned("_hash", 56).cast("int")), "dealt")
    counts = dealt.groupBy(*groups).agg(F.count("*").alias("_n"))  # at most shards * SLICES * SALTS rows
    before = Window.partitionBy(shard).orderBy("_slice", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rest = [c for c in rows.columns if c not in (shard, key)]
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy("_hash", key, *rest)) - 1)
    return ranked.join(F.broadcast(firsts), groups).withColumn("slot", (F.col("_first") + F.col("_rank")).cast("long")).drop("_hash", "_slice", "_salt", "_n", "_first", "_rank")


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, new_weight: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, and grown_shard,
    its shard with one more shard of ``new_weight``.

    A null text counts as empty. Rows with null keys share one shard, repeated keys go to the same shard and get
    slots of their own. An empty table gives no rows and other columns are not looked at. Texts are read once and
    never shuffled. Slots of rows equal in key, size and checksum may be swapped between runs that split the input
    in another way; shards never change.
    """
    raw = F.coalesce(F.encode(F.col(f"`{text}`"), "UTF-8"), F.lit(b""))
    k = F.col(f"`{key}`")
    rows = docs.select(
        k.alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(k, weights).alias("shard"),
        shard_of(k, [*weights, new_weight]).alias("grown_shard"),
    )
    return with_slots(rows, "shard", "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
