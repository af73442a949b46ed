"""Writers: CSV, lines of JSON, Parquet, Avro, and printed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import ConversionError, FormatError
from quern.schema import Schema
from quern.types import LogicalType


def _nested_hex(c: Column, t: T.DataType) -> Column:
    """A value with what JSON can't hold replaced: binary as lower-case hex, NaN and infinities as null, keys as text."""
    if isinstance(t, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
    if isinstance(t, T.StructType):
        if is_union(t):  # {"variant": value}
            maps = [F.when(c["_tag"] == i, F.concat(F.lit(f'{{"{f.name}":'), json_text(c[f.name], f.dataType), F.lit("}"))) for i, f in enumerate(t.fields[1:])]
            return F.parse_json(F.coalesce(*maps))
        return F.when(c.isNotNull(), F.struct(*(_nested_hex(c[f.name], f.dataType).alias(f.name) for f in t)))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _nested_hex(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(_nested_hex(e["key"], t.keyType).cast("string"), _nested_hex(e["value"], t.valueType))))
    return c


def is_union(t: T.StructType) -> bool:
    return bool(t.fields) and t.fields[0].name == "_tag" and isinstance(t.fields[0].dataType, T.ShortType)


def json_text(c: Column, t: T.DataType) -> Column:
    """The JSON text of a value, nulls written."""
    wrapped = F.to_json(F.struct(_nested_hex(c, t).alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, 6, 1 << 30).substr(F.lit(1), F.char_length(wrapped) - 6)


def _cells(c: Column, t: T.DataType, name: str, strict: bool) -> list[tuple[str, Column]]:
    if isinstance(t, T.StructType) and not is_union(t):
        return [x for f in t for x in _cells(c.getField(f.name), f.dataType, f"{name}.{f.name}", strict)]
    if isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
        if strict:
            raise ConversionError(name, f"{t.simpleString()} has no CSV cell")
        return [(name, F.when(c.isNotNull(), json_text(c, t)))]
    if isinstance(t, T.BinaryType):
        return [(name, F.lower(F.hex(c)))]
    return [(name, c.cast("string"))]


def to_csv(df: DataFrame, path: str, delimiter: str = ",", strict: bool = False) -> None:
    """Structs as dotted columns; lists, maps and unions as JSON text, or an error where ``strict``; null is an
    empty cell and an empty text a quoted one."""
    cells = [x for f in df.schema for x in _cells(F.col(f"`{f.name}`"), f.dataType, f.name, strict)]
    df.select(*(c.alias(n) for n, c in cells)).write.mode("overwrite").option("header", True).option("sep", delimiter).option("escape", '"').option("emptyValue", '""').csv(path)


def to_ndjson(df: DataFrame, path: str) -> None:
    """An object per line: nulls written, NaN and infinities null, binary hex, map keys as text, unions as
    {variant: value}."""
    row = F.struct(*(_nested_hex(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))
    df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def to_avro(df: DataFrame, path: str, schema: Schema | None = None) -> None:
    from quern.sources import avro

    avro.write(df, path, schema or Schema.from_spark(df.schema))


def export(df: DataFrame, path: str, fmt: str, schema: Schema | None = None, delimiter: str = ",", strict: bool = False) -> None:
    if fmt == "csv":
        to_csv(df, path, delimiter, strict)
    elif fmt in ("json", "ndjson"):
        to_ndjson(df, path)
    elif fmt == "parquet":
        to_parquet(df, path)
    elif fmt == "avro":
        to_avro(df, path, schema)
    else:
        raise FormatError(f"{fmt!r} is no target for rows")


def table_text(df: DataFrame, limit: int = 1000) -> str:
    """Rows as a ruled text table; ``limit`` bounds what reaches the driver."""
    rows = [["NULL" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]
    width = [max([len(n), *(len(r[i]) for r in rows)]) for i, n in enumerate(df.columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda cells: "|" + "|".join(f" {c:<{w}} " for c, w in zip(cells, width, strict=True)) + "|"
    return "\n".join([rule, line(df.columns), rule, *map(line, rows), rule])


def logical_of(df: DataFrame) -> LogicalType:
    return LogicalType("struct", (), tuple((c.name, c.type) for c in Schema.from_spark(df.schema).columns))
