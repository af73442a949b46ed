"""Statistics of stripes: bounds, null counts, membership filters and checksums, as plain aggregates.

One row per stripe, a struct per leaf (see ``leaf_struct``). Bounds are conservative: texts are cut to ``TEXT_CUT``
characters, which keeps a lower bound and drops the upper one; floats' bounds are over finite values, with a flag if
others occur. What is not exact says so, and nothing that isn't exact answers a query by itself.

Membership filters keep 64-bit hashes of the values: all of them up to ``SET_LIMIT`` distinct ones, a Bloom filter
beyond. Both are built from distinct (stripe, leaf, hash) rows, combined before the shuffle. A leaf of so many distinct
values in each stripe that the largest filter would say nothing has none, and its values aren't shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.schema import Schema

TEXT_CUT = 256
SET_LIMIT = 256
BLOOM_RATE, BLOOM_MAX_BITS, BLOOM_MAX_PROBES = 0.01, 64 * 1024 * 8, 30
#: At four bits a value a filter lets one in seven pass.
BLOOM_MAX_VALUES = BLOOM_MAX_BITS // 4
_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted paths of the scalars that a row holds once (through structs), with their types."""
    out = []
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, f"{prefix}{f.name}.")
        elif isinstance(f.dataType, _PLAIN):
            out.append((f"{prefix}{f.name}", f.dataType))
    return out


def path_column(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def value_hash(c: Column, t: T.DataType) -> Column:
    """The hash by which a value is looked up in filters: -0.0 is 0.0, NaN is one value."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        c = c.cast("double") + F.lit(0.0)
    return F.xxhash64(c)


def _bounds(path: str, t: T.DataType) -> list[tuple[str, Column]]:
    c = path_column(path)
    if not isinstance(t, (T.FloatType, T.DoubleType)):
        return [("lo", F.min(c)), ("hi", F.max(c)), ("nonfinite", F.lit(False))]
    odd = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    finite = F.when(~odd, c)
    return [("lo", F.min(finite)), ("hi", F.max(finite)), ("nonfinite", F.coalesce(F.bool_or(odd), F.lit(False)))]


def stripe_bounds(data: DataFrame, schema: T.StructType, order: str, by: str = "stripe_id") -> DataFrame:
    """One row per stripe: n_rows and s<i> for leaf i: n (rows), nulls, lo, hi, lo_exact, hi_exact, nonfinite,
    checksum of the leaf's values with their places."""
    aggregates = [F.count("*").alias("n_rows")]
    found = leaves(schema)
    for i, (path, t) in enumerate(found):
        c = path_column(path)
        aggregates += [x.alias(f"s{i}_{name}") for name, x in _bounds(path, t)]
        aggregates += [F.count(F.when(c.isNull(), 1)).alias(f"s{i}_nulls"), F.bit_xor(F.xxhash64(F.col(order), value_hash(c, t))).alias(f"s{i}_checksum")]
    rows = data.groupBy(by).agg(*aggregates)
    structs = []
    for i, (_, t) in enumerate(found):
        lo, hi = F.col(f"s{i}_lo"), F.col(f"s{i}_hi")
        whole_lo = whole_hi = F.lit(True)
        if isinstance(t, (T.StringType, T.BinaryType)):
            whole_lo, whole_hi = F.coalesce(F.length(lo) <= TEXT_CUT, F.lit(True)), F.coalesce(F.length(hi) <= TEXT_CUT, F.lit(True))
            lo, hi = F.substring(lo, 1, TEXT_CUT), F.when(whole_hi, hi)
        exact = ~F.col(f"s{i}_nonfinite")
        structs.append(F.struct(F.col("n_rows").alias("n"), F.col(f"s{i}_nulls").alias("nulls"), lo.alias("lo"), hi.alias("hi"), (whole_lo & exact).alias("lo_exact"), (whole_hi & exact).alias("hi_exact"), F.col(f"s{i}_nonfinite").alias("nonfinite"), F.col(f"s{i}_checksum").alias("checksum")).alias(f"s{i}"))
    return rows.select(by, "n_rows", *structs)


def bloom_size(n: int) -> tuple[int, int]:
    """Bits (a multiple of 64) and probes for n values."""
    bits = min(BLOOM_MAX_BITS, max(64, -(-int(-n * math.log(BLOOM_RATE) / math.log(2) ** 2) // 64) * 64))
    return bits, min(BLOOM_MAX_PROBES, max(1, round(bits / max(n, 1) * math.log(2))))


def _bloom_bits(n: Column) -> Column:
    wanted = F.ceil(n * (-math.log(BLOOM_RATE) / math.log(2) ** 2) / 64) * 64
    return F.least(F.lit(BLOOM_MAX_BITS), F.greatest(F.lit(64), wanted)).cast("long")


def bloom_probes(bits: Column, n: Column) -> Column:
    return F.least(F.lit(BLOOM_MAX_PROBES), F.greatest(F.lit(1), F.round(bits / F.greatest(n, F.lit(1)) * math.log(2)))).cast("int")


def bloom_positions(h: Column, bits: Column, probes: Column) -> Column:
    """Bit places of a hash: double hashing from its halves."""
    a, b = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), probes - 1), lambda i: F.pmod(a + i * b, bits))


def stripe_filters(data: DataFrame, schema: T.StructType, by: str = "stripe_id") -> DataFrame:
    """(stripe, leaf, n, hashes, bits, probes, words): ``hashes`` of all values where there are at most SET_LIMIT
    distinct ones, else the Bloom filter's 64-bit words as (place, word). Decimals have filters like all scalars."""
    found = list(enumerate(leaves(schema)))
    if found:
        least = data.groupBy(by).agg(*(F.approx_count_distinct(path_column(p)).alias(f"n{i}") for i, (p, _) in found))
        least = least.agg(*(F.min(f"n{i}").alias(f"n{i}") for i, _ in found)).first()  # one number per leaf
        found = [(i, x) for i, x in found if (least[f"n{i}"] or 0) <= BLOOM_MAX_VALUES]
    pairs = F.array(*(F.struct(F.lit(i).alias("leaf"), F.when(path_column(p).isNotNull(), value_hash(path_column(p), t)).alias("h")) for i, (p, t) in found)) if found else F.array().cast("array<struct<leaf:int,h:bigint>>")
    distinct = data.select(by, F.explode(pairs).alias("x")).select(by, "x.leaf", "x.h").where("h is not null").distinct()
    counts = distinct.groupBy(by, "leaf").agg(F.count("*").alias("n"))
    # A set holds at most SET_LIMIT hashes, so only those are ever collected.
    small = counts.where(F.col("n") <= SET_LIMIT)
    sets = distinct.join(small, [by, "leaf"]).groupBy(by, "leaf").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("h")).alias("hashes"))
    large = counts.where(F.col("n") > SET_LIMIT).withColumn("bits", _bloom_bits(F.col("n"))).withColumn("probes", bloom_probes(F.col("bits"), F.col("n")))
    places = distinct.join(large, [by, "leaf"]).select(by, "leaf", "n", "bits", "probes", F.explode(bloom_positions(F.col("h"), F.col("bits"), F.col("probes"))).alias("at"))
    words = places.groupBy(by, "leaf", "n", "bits", "probes", (F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("v"))
    blooms = words.groupBy(by, "leaf", "n", "bits", "probes").agg(F.map_from_entries(F.collect_list(F.struct("word", "v"))).alias("words"))
    nothing = F.lit(None)
    return sets.select(by, "leaf", "n", "hashes", nothing.cast("long").alias("bits"), nothing.cast("int").alias("probes"), nothing.cast("map<int,bigint>").alias("words")).unionByName(
        blooms.select(by, "leaf", "n", nothing.cast("array<bigint>").alias("hashes"), "bits", "probes", "words")
    )


def might_contain(h: Column, f: Column) -> Column:
    """Whether a filter struct (hashes, bits, probes, words) may hold a hash; true where there is no filter."""
    word = lambda at: F.coalesce(F.try_element_at(f["words"], (at / 64).cast("int")), F.lit(0).cast("long"))
    bloom = F.forall(bloom_positions(h, f["bits"], f["probes"]), lambda at: F.getbit(word(at), (at % 64).cast("int")) == 1)
    return F.when(f.isNull(), True).when(f["hashes"].isNotNull(), F.array_contains(f["hashes"], h)).when(f["words"].isNotNull(), bloom).otherwise(True)


def with_filters(bounds: DataFrame, filters: DataFrame, n_leaves: int, by: str = "stripe_id") -> DataFrame:
    """The stripes' row with f<i>, the filter of leaf i, beside s<i>."""
    body = F.struct("n", "hashes", "bits", "probes", "words")
    if not n_leaves:
        return bounds
    per = filters.groupBy(by).agg(*(F.first(F.when(F.col("leaf") == i, body), ignorenulls=True).alias(f"f{i}") for i in range(n_leaves)))
    return bounds.join(per, by, "left")


def merged(stats: DataFrame, schema: T.StructType) -> DataFrame:
    """Statistics of the whole dataset, one row per leaf: n, nulls, lo, hi as text, and whether they are exact.

    All or nothing: one stripe without a bound leaves the whole without it. One pass over the manifest.
    """
    rows = []
    for i, (path, _) in enumerate(leaves(schema)):
        s = F.col(f"s{i}")
        bad_lo, bad_hi = F.max(~s["lo_exact"]), F.max(~s["hi_exact"])
        unknown = F.max((s["hi"].isNull() & (s["nulls"] < s["n"])).cast("int")) == 1
        rows.append(F.struct(F.lit(path).alias("leaf"), F.sum(s["n"]).alias("n"), F.sum(s["nulls"]).alias("nulls"), F.min(s["lo"]).cast("string").alias("lo"), F.when(unknown, None).otherwise(F.max(s["hi"])).cast("string").alias("hi"), (~F.coalesce(bad_lo, F.lit(True))).alias("lo_exact"), (~F.coalesce(bad_hi, F.lit(True))).alias("hi_exact")))
    return stats.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def logical_leaves(schema: Schema) -> list[str]:
    return [p for p, _ in leaves(schema.to_spark())]
