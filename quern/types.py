"""Logical types, their physical leaves, and their Spark types.

A logical type is a small tree. ``leaves`` gives its physical columns in order, which is the order of a column's
encodings. Spark types are a projection of it: what Spark lacks (unsigned widths, unions, nanoseconds, time units,
dictionary encoding) is kept in the schema JSON and in field metadata.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from quern.errors import SchemaError

INTS = ("i8", "i16", "i32", "i64", "u8", "u16", "u32", "u64")
FLOATS = ("f32", "f64")
PHYSICAL = (*INTS, *FLOATS, "bytes")
MAX_DEPTH = 64
MAX_VARIANTS = 255
UNITS = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}

_SPARK = {"i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "f32": T.FloatType(), "f64": T.DoubleType()}


@dataclass(frozen=True)
class LogicalType:
    """``kind`` is primitive, utf8, binary, struct, list, map, nullable, union, dictionary, decimal, date or datetime;
    ``args`` are the kind's scalar settings and ``parts`` its named children."""

    kind: str
    args: tuple[tuple[str, Any], ...] = ()
    parts: tuple[tuple[str, LogicalType], ...] = ()

    def arg(self, name: str) -> Any:
        return dict(self.args).get(name)

    def part(self, name: str) -> LogicalType:
        return dict(self.parts)[name]

    @property
    def inner(self) -> LogicalType:
        return self.parts[0][1]

    # -- leaves

    def leaves(self) -> list[tuple[str, str]]:
        """(dotted role, physical type) of each physical column, in order."""
        k = self.kind
        if k == "primitive":
            return [("values", self.arg("type"))]
        if k in ("utf8", "binary"):
            return [("offsets", "u32"), ("data", "bytes")]
        if k == "struct":
            return [(f"{name}.{role}", p) for name, t in self.parts for role, p in t.leaves()]
        if k == "list":
            return [("offsets", "u32"), *_prefixed("item", self.inner)]
        if k == "map":
            return [("offsets", "u32"), *_prefixed("key", self.part("key")), *_prefixed("value", self.part("value"))]
        if k == "nullable":
            return [("present", "u8"), *_prefixed("item", self.inner)]
        if k == "union":
            return [("tag", "u8"), *(x for name, t in self.parts for x in _prefixed(f"v_{name}", t))]
        if k == "dictionary":
            return [*self.inner.leaves(), ("indices", "u32")]
        if k == "decimal":
            return [("high", "i64"), ("low", "i64")]
        if k == "date":
            return [("values", "i32" if self.arg("unit") == "days" else "i64")]
        return [("values", "i64")]  # datetime

    # -- checks

    def validate(self, column: str, depth: int = 0) -> None:
        """Raises SchemaError for shapes that no dataset may have."""
        if depth > MAX_DEPTH:
            raise SchemaError(f"nested deeper than {MAX_DEPTH}", column)
        k = self.kind
        if k == "primitive" and self.arg("type") not in (*INTS, *FLOATS):
            raise SchemaError(f"no primitive type {self.arg('type')!r}", column)
        if k in ("struct", "union"):
            names = [n for n, _ in self.parts]
            if not names or "" in names or len(set(names)) < len(names):
                raise SchemaError(f"a {k} needs distinct, non-empty names", column)
        if k == "union" and len(self.parts) > MAX_VARIANTS:
            raise SchemaError(f"over {MAX_VARIANTS} variants", column)
        if k == "map" and self.part("key").kind not in ("primitive", "utf8", "binary"):
            raise SchemaError("map keys must be primitive, utf8 or binary", column)
        if k == "decimal" and not (1 <= self.arg("precision") <= 38 and 0 <= self.arg("scale") <= self.arg("precision")):
            raise SchemaError("decimals need a precision of 1 to 38 and a scale of 0 to the precision", column)
        if k == "date" and self.arg("unit") not in ("days", "millis"):
            raise SchemaError("dates are in days or millis", column)
        if k == "datetime" and self.arg("unit") not in UNITS:
            raise SchemaError(f"datetimes are in {', '.join(UNITS)}", column)
        for _, t in self.parts:
            t.validate(column, depth + 1)

    # -- Spark

    def to_spark(self) -> T.DataType:
        k = self.kind
        if k == "primitive":
            return _SPARK[self.arg("type")]
        if k == "utf8":
            return T.StringType()
        if k == "binary":
            return T.BinaryType()
        if k == "struct":
            return T.StructType([T.StructField(n, t.to_spark(), t.kind == "nullable") for n, t in self.parts])
        if k == "list":
            return T.ArrayType(self.inner.to_spark(), self.inner.kind == "nullable")
        if k == "map":
            return T.MapType(self.part("key").to_spark(), self.part("value").to_spark(), self.part("value").kind == "nullable")
        if k in ("nullable", "dictionary"):
            return self.inner.to_spark()
        if k == "union":  # _tag is the variant's place; that variant's field alone is not null
            return T.StructType([T.StructField("_tag", T.ShortType(), True), *(T.StructField(n, t.to_spark(), True) for n, t in self.parts)])
        if k == "decimal":
            return T.DecimalType(self.arg("precision"), self.arg("scale"))
        if k == "date":
            return T.DateType() if self.arg("unit") == "days" else T.TimestampNTZType()
        if self.arg("unit") == "ns":
            return T.LongType()  # microseconds would lose three digits
        return T.TimestampType() if self.arg("tz") else T.TimestampNTZType()

    # -- JSON

    def to_json(self) -> Any:
        if self.kind in ("utf8", "binary"):
            return self.kind
        body: dict[str, Any] = dict(self.args)
        if self.kind in ("struct", "union"):
            body["fields"] = [{"name": n, "type": t.to_json()} for n, t in self.parts]
        else:
            body |= {n: t.to_json() for n, t in self.parts}
        return {self.kind: body}

    @staticmethod
    def from_json(x: Any) -> LogicalType:
        if isinstance(x, str):
            if x not in ("utf8", "binary"):
                raise SchemaError(f"no type {x!r}")
            return LogicalType(x)
        if not isinstance(x, dict) or len(x) != 1:
            raise SchemaError(f"a type is a name or an object of one kind, not {x!r}")
        (kind, body), = x.items()
        if kind in ("struct", "union"):
            return LogicalType(kind, (), tuple((f["name"], LogicalType.from_json(f["type"])) for f in body["fields"]))
        children = {"list": ("inner",), "nullable": ("inner",), "dictionary": ("inner",), "map": ("key", "value")}.get(kind, ())
        if kind not in ("primitive", "decimal", "date", "datetime", "list", "nullable", "dictionary", "map"):
            raise SchemaError(f"no type {kind!r}")
        return LogicalType(kind, tuple(sorted((k, v) for k, v in body.items() if k not in children)), tuple((c, LogicalType.from_json(body[c])) for c in children))


def _prefixed(name: str, t: LogicalType) -> list[tuple[str, str]]:
    return [(f"{name}.{role}", p) for role, p in t.leaves()]


def relaxed(t: T.DataType) -> T.DataType:
    """The type with every part nullable, as Parquet reads it back."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, relaxed(f.dataType), True) for f in t])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(relaxed(t.elementType), True)
    if isinstance(t, T.MapType):
        return T.MapType(relaxed(t.keyType), relaxed(t.valueType), True)
    return t


def primitive(name: str) -> LogicalType:
    return LogicalType("primitive", (("type", name),))


UTF8, BINARY = LogicalType("utf8"), LogicalType("binary")


def struct(**fields: LogicalType) -> LogicalType:
    return LogicalType("struct", (), tuple(fields.items()))


def list_of(inner: LogicalType) -> LogicalType:
    return LogicalType("list", (), (("inner", inner),))


def map_of(key: LogicalType, value: LogicalType) -> LogicalType:
    return LogicalType("map", (), (("key", key), ("value", value)))


def nullable(inner: LogicalType) -> LogicalType:
    return inner if inner.kind == "nullable" else LogicalType("nullable", (), (("inner", inner),))


def union(**variants: LogicalType) -> LogicalType:
    return LogicalType("union", (), tuple(variants.items()))


def dictionary(inner: LogicalType) -> LogicalType:
    return LogicalType("dictionary", (), (("inner", inner),))


def decimal(precision: int, scale: int) -> LogicalType:
    return LogicalType("decimal", (("precision", precision), ("scale", scale)))


def date(unit: str = "days") -> LogicalType:
    return LogicalType("date", (("unit", unit),))


def datetime(unit: str = "us", tz: str | None = None) -> LogicalType:
    return LogicalType("datetime", (("tz", tz), ("unit", unit)))


def from_spark(t: T.DataType, is_nullable: bool = False, metadata: dict | None = None) -> LogicalType:
    """The logical type of a Spark column; booleans become u8. ``metadata`` may carry the exact type."""
    if metadata and "logical" in metadata:
        import json

        return LogicalType.from_json(json.loads(metadata["logical"]))
    simple = {T.ByteType: "i8", T.ShortType: "i16", T.IntegerType: "i32", T.LongType: "i64", T.FloatType: "f32", T.DoubleType: "f64", T.BooleanType: "u8"}
    if type(t) in simple:
        out = primitive(simple[type(t)])
    elif isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        out = UTF8
    elif isinstance(t, T.BinaryType):
        out = BINARY
    elif isinstance(t, T.DateType):
        out = date()
    elif isinstance(t, T.TimestampType):
        out = datetime("us", "UTC")
    elif isinstance(t, T.TimestampNTZType):
        out = datetime("us")
    elif isinstance(t, T.DecimalType):
        out = decimal(t.precision, t.scale)
    elif isinstance(t, T.StructType):
        out = LogicalType("struct", (), tuple((f.name, from_spark(f.dataType, f.nullable, f.metadata)) for f in t))
    elif isinstance(t, T.ArrayType):
        out = list_of(from_spark(t.elementType, t.containsNull))
    elif isinstance(t, T.MapType):
        out = map_of(from_spark(t.keyType), from_spark(t.valueType, t.valueContainsNull))
    else:
        raise SchemaError(f"Spark's {t.simpleString()} has no logical type")
    return nullable(out) if is_nullable else out


@dataclass
class Stage:
    """A coder by id with its parameters."""

    id: str
    params: dict[str, Any] = field(default_factory=dict)

    def to_json(self) -> dict:
        return {"id": self.id, **({"params": self.params} if self.params else {})}

    @staticmethod
    def from_json(x: Any) -> Stage:
        return Stage(x) if isinstance(x, str) else Stage(x["id"], dict(x.get("params", {})))
