"""Shredding of logical values into physical leaves and back.

``decompose`` and ``compose`` work on the rows of one page in memory, which is what coders take. ``shredded`` and the
functions below it are the same on DataFrames, for columns of any size.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.coders.base import DTYPES
from quern.errors import ConversionError, FormatError
from quern.types import UNITS, LogicalType

_EPOCH = dt.datetime(1970, 1, 1)


def _ticks(v: Any, unit: str) -> int:
    if isinstance(v, (int, np.integer)):
        return int(v)
    if v.tzinfo is not None:
        v = v.astimezone(dt.UTC).replace(tzinfo=None)
    micros = (v - _EPOCH) // dt.timedelta(microseconds=1)
    return micros * (UNITS[unit] // 1_000_000) if unit == "ns" else micros // (1_000_000 // UNITS[unit])


def _offsets(sizes: list[int]) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    if out[-1] > 0xFFFFFFFF:
        raise FormatError("over 2^32 - 1 items in one page")
    return out.astype(np.uint32)


def decompose(t: LogicalType, rows: list) -> list[Any]:
    """Leaves of the rows in the order of ``t.leaves()``: numpy arrays, or bytes."""
    k = t.kind
    if k == "primitive":
        return [np.array([int(r) if isinstance(r, decimal.Decimal) else r for r in rows], DTYPES[t.arg("type")])]
    if k in ("utf8", "binary"):
        raw = [r.encode() if isinstance(r, str) else bytes(r) for r in rows]
        return [_offsets([len(r) for r in raw]), b"".join(raw)]
    if k == "struct":
        return [x for name, p in t.parts for x in decompose(p, [r[name] for r in rows])]
    if k == "list":
        return [_offsets([len(r) for r in rows]), *decompose(t.inner, [v for r in rows for v in r])]
    if k == "map":
        pairs = [list(r.items()) if isinstance(r, dict) else list(r) for r in rows]
        flat = [p for r in pairs for p in r]
        return [_offsets([len(p) for p in pairs]), *decompose(t.part("key"), [a for a, _ in flat]), *decompose(t.part("value"), [b for _, b in flat])]
    if k == "nullable":
        return [np.array([r is not None for r in rows], np.uint8), *decompose(t.inner, [r for r in rows if r is not None])]
    if k == "union":  # a row is (variant, value)
        names = [n for n, _ in t.parts]
        return [np.array([names.index(v) for v, _ in rows], np.uint8), *(x for n, p in t.parts for x in decompose(p, [w for v, w in rows if v == n]))]
    if k == "dictionary":
        index: dict[Any, int] = {}
        places = np.array([index.setdefault(r, len(index)) for r in rows], np.uint32)
        return [*decompose(t.inner, list(index)), places]
    if k == "decimal":
        scale = t.arg("scale")
        with decimal.localcontext(decimal.Context(prec=80)):
            whole = [int(decimal.Decimal(r).scaleb(scale).to_integral_exact()) for r in rows]
        mask = (1 << 64) - 1
        return [np.array([w >> 64 for w in whole], np.int64), np.array([w & mask for w in whole], np.uint64).view(np.int64)]
    if k == "date":
        if t.arg("unit") == "days":
            return [np.array([r if isinstance(r, int) else (r - dt.date(1970, 1, 1)).days for r in rows], np.int32)]
        return [np.array([_ticks(r, "ms") for r in rows], np.int64)]
    return [np.array([_ticks(r, t.arg("unit")) for r in rows], np.int64)]


def checked_offsets(offsets: np.ndarray, total: int) -> np.ndarray:
    """Offsets start at 0, never fall, and end at the number of items."""
    x = offsets.astype(np.int64)
    if not len(x) or x[0] or (np.diff(x) < 0).any() or x[-1] != total:
        raise FormatError("offsets must start at 0, never fall and end at the number of items")
    return x


def compose(t: LogicalType, leaves: list[Any]) -> list:
    """The rows of leaves; malformed leaves are errors."""
    it = iter(leaves)
    rows = _compose(t, it)
    if next(it, None) is not None:
        raise FormatError("too many leaves")
    return rows


def _compose(t: LogicalType, it: Iterator[Any]) -> list:
    k = t.kind
    if k == "primitive":
        return next(it).tolist()
    if k in ("utf8", "binary"):
        offsets, data = next(it), bytes(next(it))
        at = checked_offsets(offsets, len(data)).tolist()
        cut = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        return [c.decode() for c in cut] if k == "utf8" else cut
    if k == "struct":
        parts = [(n, _compose(p, it)) for n, p in t.parts]
        if len({len(v) for _, v in parts}) > 1:
            raise FormatError("fields of a struct have other numbers of rows")
        return [dict(zip([n for n, _ in parts], v, strict=True)) for v in zip(*(v for _, v in parts), strict=True)]
    if k in ("list", "map"):
        offsets = next(it)
        if k == "list":
            items = _compose(t.inner, it)
        else:
            items = list(zip(_compose(t.part("key"), it), _compose(t.part("value"), it), strict=True))
        at = checked_offsets(offsets, len(items)).tolist()
        cut = [items[a:b] for a, b in zip(at, at[1:], strict=False)]
        return cut if k == "list" else [c if len({x for x, _ in c}) < len(c) else dict(c) for c in cut]
    if k == "nullable":
        present, items = next(it), _compose(t.inner, it)
        if int(present.astype(bool).sum()) != len(items):
            raise FormatError("as many values as present flags are needed")
        rest = iter(items)
        return [next(rest) if p else None for p in present.tolist()]
    if k == "union":
        tags = next(it)
        parts = [(n, _compose(p, it)) for n, p in t.parts]
        if len(tags) and int(tags.max()) >= len(parts):
            raise FormatError("a tag names no variant")
        rest = [iter(v) for _, v in parts]
        try:
            return [(parts[g][0], next(rest[g])) for g in tags.tolist()]
        except StopIteration:
            raise FormatError("a variant has too few values") from None
    if k == "dictionary":
        values, places = _compose(t.inner, it), next(it)
        if len(places) and int(places.max()) >= len(values):
            raise FormatError("an index is beyond the dictionary")
        return [values[i] for i in places.tolist()]
    if k == "decimal":
        high, low, scale = next(it).tolist(), next(it).view(np.uint64).tolist(), t.arg("scale")
        with decimal.localcontext(decimal.Context(prec=80)):
            return [decimal.Decimal((h << 64) + w).scaleb(-scale) for h, w in zip(high, low, strict=True)]
    ticks = next(it).tolist()
    if k == "date" and t.arg("unit") == "days":
        return [dt.date(1970, 1, 1) + dt.timedelta(days=d) for d in ticks]
    unit = "ms" if k == "date" else t.arg("unit")
    if unit == "ns":
        return ticks
    utc = dt.UTC if k == "datetime" and t.arg("tz") else None
    return [_EPOCH.replace(tzinfo=utc) + dt.timedelta(microseconds=v * (1_000_000 // UNITS[unit])) for v in ticks]


# -- on DataFrames: ``order`` is the row position within ``by`` (the stripe)


def _window(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def compacted(df: DataFrame, column: str, by: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Nullable compaction: (by, order, present) of all rows and (by, item_pos, value) of the non-null ones."""
    present = F.col(column).isNotNull()
    flags = df.select(*by, order, present.cast("short").alias("present"))
    items = df.where(present).select(*by, (F.row_number().over(_window(by, order)) - 1).cast("long").alias("item_pos"), F.col(column).alias("value"))
    return flags, items


def expanded(flags: DataFrame, items: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    """Inverse of ``compacted``: the running number of present rows finds each row's item."""
    at = F.sum("present").over(_window(by, order).rowsBetween(Window.unboundedPreceding, 0)) - 1
    placed = flags.withColumn("item_pos", F.when(F.col("present") == 1, at))
    return placed.join(items, [*by, "item_pos"], "left").select(*by, order, F.col("value").alias(column))


def dictionary_encoded(df: DataFrame, column: str, by: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(by, index, value) in the order of first appearance, and (by, order, index) of all rows; nulls have none.

    First places are found by a combined aggregate, so a value with a third of all rows costs no task more.
    """
    kind = df.schema[column].dataType.simpleString()
    if kind in ("float", "double"):
        raise ConversionError(column, "floats aren't dictionary-encoded")
    first = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.min(order).alias("first"))
    table = first.select(*by, (F.row_number().over(_window(by, "first")) - 1).cast("long").alias("index"), F.col(column).alias("value"))
    rows = df.select(*by, order, F.col(column).alias("value")).join(table, [*by, "value"], "left").select(*by, order, "index")
    return table, rows


def dictionary_decoded(table: DataFrame, rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Inverse of ``dictionary_encoded``; an index beyond the dictionary is an error."""
    value = F.when(F.col("index").isNotNull() & ~F.col("_found"), F.raise_error(F.lit("an index is beyond the dictionary"))).otherwise(F.col("value"))
    joined = rows.join(table.withColumn("_found", F.lit(True)), [*by, "index"], "left").withColumn("_found", F.coalesce("_found", F.lit(False)))
    return joined.withColumn(column, value).drop("value", "index", "_found")


def offsets(df: DataFrame, column: str, by: list[str], order: str) -> DataFrame:
    """End offset of each row's list, map, text or bytes: the running sum of sizes (the leading 0 is implied)."""
    kind = df.schema[column].dataType.simpleString()
    size = F.size(column) if kind.startswith(("array", "map")) else F.octet_length(column)
    return df.select(*by, order, F.sum(F.coalesce(size, F.lit(0)).cast("long")).over(_window(by, order).rowsBetween(Window.unboundedPreceding, 0)).alias("offset"))


def items_of(df: DataFrame, column: str, by: list[str], order: str) -> DataFrame:
    """(by, order, item_pos, item) of a list column, or (…, key, value) of a map column."""
    is_map = df.schema[column].dataType.simpleString().startswith("map")
    return df.select(*by, order, F.posexplode(column).alias("item_pos", *(["key", "value"] if is_map else ["item"])))


def lists_from(items: DataFrame, rows: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    """Inverse of ``items_of`` for lists; rows without items get empty lists."""
    built = items.groupBy(*by, order).agg(F.array_sort(F.collect_list(F.struct("item_pos", "item"))).alias("x"))
    empty = F.filter(F.col("x.item"), lambda v: F.lit(False))
    joined = rows.select(*by, order).join(built, [*by, order], "left")
    return joined.select(*by, order, F.coalesce(F.col("x.item"), empty, F.array()).alias(column))


def union_variants(df: DataFrame, column: str, by: list[str], order: str) -> dict[str, DataFrame]:
    """For each variant of a union struct: (by, item_pos, value) of the rows that carry it, compacted."""
    names = [f.name for f in df.schema[column].dataType if f.name != "_tag"]
    out = {}
    for i, name in enumerate(names):
        mine = df.where(F.col(f"`{column}`._tag") == i)
        out[name] = mine.select(*by, (F.row_number().over(_window(by, order)) - 1).cast("long").alias("item_pos"), F.col(f"`{column}`.`{name}`").alias("value"))
    return out


def decimal_halves(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``<column>_high`` and ``<column>_low``, the signed 64-bit halves of the unscaled 128-bit number."""
    whole = F.replace(F.col(column).cast("string"), F.lit("."), F.lit("")).cast("decimal(38,0)")
    word = F.lit(decimal.Decimal(1 << 64))
    high = F.floor(whole / word)  # the quotient has scale enough to be exact below
    high = F.when(whole - high * word < 0, high - 1).when(whole - high * word >= word, high + 1).otherwise(high)
    low = whole - high * word
    signed = F.when(low >= F.lit(decimal.Decimal(1 << 63)), low - word).otherwise(low)
    return df.withColumns({f"{column}_high": high.cast("long"), f"{column}_low": signed.cast("long")})


def leaf_columns(t: LogicalType, column, role: str = "") -> list[tuple[str, Any]]:
    """(role, Column) of the leaves that a row holds once: through structs and nullables, down to scalars."""
    if t.kind == "struct":
        return [x for name, p in t.parts for x in leaf_columns(p, column.getField(name), f"{role}{name}.")]
    if t.kind == "nullable":
        return leaf_columns(t.inner, column, role)
    return [(role.rstrip("."), column)]


def slice_rows(df: DataFrame, start: int, length: int, order: str = "row_pos", total: int | None = None) -> DataFrame:
    """Rows ``start`` to ``start + length``; beyond ``total`` rows (counted where not given) is an error."""
    total = df.count() if total is None else total
    if start < 0 or length < 0 or start + length > total:
        raise FormatError(f"rows {start} to {start + length} of {total}")
    return df.where((F.col(order) >= start) & (F.col(order) < start + length))
