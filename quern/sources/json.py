"""JSON: an array of objects or an object per line, with unions for mixed kinds."""

from __future__ import annotations

import json as _json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import FormatError
from quern.schema import Column as Field
from quern.schema import Schema
from quern.types import UTF8, LogicalType, list_of, nullable, primitive, relaxed, union

SAMPLE_ROWS = 1000
MAX_DEPTH = 16
#: Names and order of a union's variants.
KINDS = ("bool", "int", "float", "string", "object", "array")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One text column of objects. A file that begins with [ is an array; else lines are objects, blank ones none."""
    lines = spark.read.text(path)
    first = lines.where(F.trim("value") != "").limit(1).collect()
    if first and first[0][0].lstrip().startswith("["):
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.explode(F.expr("cast(parse_json(value) AS array<variant>)")).alias("v")).select(F.to_json("v").alias("value"))
    return lines.where(F.trim("value") != "")


class _Seen:
    """What was seen of one place in the documents."""

    def __init__(self) -> None:
        self.kinds: set[str] = set()
        self.null = False
        self.count = 0
        self.fields: dict[str, _Seen] = {}
        self.items: _Seen | None = None
        self.present = 0

    def add(self, v: Any, depth: int = 0) -> None:
        if depth > MAX_DEPTH:
            raise FormatError(f"nested deeper than {MAX_DEPTH}")
        if v is None:
            self.null = True
            return
        kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) and -(1 << 63) <= v < 1 << 63 else "float" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array"
        self.kinds.add(kind)
        if kind == "object":
            self.count += 1
            for k, w in v.items():
                self.fields.setdefault(k, _Seen()).add(w, depth + 1)
                self.fields[k].present += 1
        elif kind == "array":
            self.items = self.items or _Seen()
            for w in v:
                self.items.add(w, depth + 1)

    def _kind(self, k: str) -> LogicalType:
        simple = {"bool": primitive("u8"), "int": primitive("i64"), "float": primitive("f64"), "string": UTF8}
        if k in simple:
            return simple[k]
        if k == "array":
            return list_of(self.items.type() if self.items.kinds or self.items.null else nullable(UTF8))
        return LogicalType("struct", (), tuple((n, nullable(t) if s.present < self.count else t) for n, s in self.fields.items() for t in [s.type()])) if self.fields else UTF8

    def type(self) -> LogicalType:
        ks = set(self.kinds)
        if {"int", "float"} <= ks:
            ks.discard("int")
        if "bool" in ks and "int" in ks:
            ks.discard("bool")
        if not ks:
            return nullable(UTF8)
        if len(ks) == 1:
            t = self._kind(*ks)
        elif len(ks) <= 3:
            t = union(**{k: self._kind(k) for k in KINDS if k in ks})
        else:
            t = UTF8
        return nullable(t) if self.null else t


def infer(spark: SparkSession, path: str, sample_rows: int = SAMPLE_ROWS, **_) -> Schema:
    """Types from the first ``sample_rows`` documents; a key that some lack, or that is null, is nullable."""
    root = _Seen()
    for r in documents(spark, path).limit(sample_rows).collect():
        try:
            v = _json.loads(r[0])
        except ValueError as e:
            raise FormatError(f"{path}: malformed document: {e}") from e
        if not isinstance(v, dict):
            raise FormatError(f"{path}: a document is no object")
        root.add(v)
    if not root.fields:
        raise FormatError(f"{path} has no columns")
    return Schema([Field(n, t) for n, t in root._kind("object").parts]).validate()


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, "$['" + key.replace("'", "\\'") + "']", "variant")


def _kind_of(v: Column) -> Column:
    """The kind of a variant's value, by KINDS; null for JSON null."""
    t = F.schema_of_variant(v)
    return F.when(t == "BOOLEAN", "bool").when(t == "BIGINT", "int").when(t.isin("DOUBLE", "FLOAT") | t.startswith("DECIMAL"), "float").when(t == "STRING", "string").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array")


def typed(v: Column, t: LogicalType, name: str) -> Column:
    """A variant in a logical type. A null where the type allows none, or a value it can't hold, is an error."""
    absent = v.isNull() | F.is_variant_null(v)
    if t.kind == "nullable":
        return F.when(~absent, typed(v, t.inner, name))
    if t.kind == "dictionary":
        return typed(v, t.inner, name)

    def held(x: Column) -> Column:
        return F.when(x.isNotNull(), x).otherwise(F.raise_error(F.concat(F.lit(f"column {name!r}: not {t.kind}: "), F.coalesce(F.to_json(v), F.lit("null")))).cast("void"))

    kind = t.to_spark()
    if t.kind == "primitive":
        number = F.when(_kind_of(v) == "bool", F.try_variant_get(v, "$", "boolean").cast("int").cast(kind)).otherwise(F.try_variant_get(v, "$", kind.simpleString()))
        return held(number)
    if t.kind == "utf8":
        return held(F.when(_kind_of(v) == "string", F.try_variant_get(v, "$", "string")).otherwise(F.when(~absent, F.to_json(v))))
    if t.kind == "binary":
        return held(F.unhex(F.try_variant_get(v, "$", "string")))
    if t.kind == "struct":
        parts = [typed(_at(v, n), p, f"{name}.{n}").alias(n) for n, p in t.parts]
        return held(F.when(_kind_of(v) == "object", F.struct(*parts)))
    if t.kind == "list":
        return held(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: typed(x, t.inner, name)))
    if t.kind == "map":
        from quern.sources.csv import typed as from_text

        pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        return held(F.map_from_entries(F.transform(pairs, lambda e: F.struct(from_text(e["key"], t.part("key"), name), typed(e["value"], t.part("value"), name)))))
    if t.kind == "union":
        fits = {"bool": ("primitive",), "int": ("primitive",), "float": ("primitive",), "string": ("utf8", "binary"), "object": ("struct", "map"), "array": ("list",)}
        exact = {"u8": ("bool",), "i64": ("int", "bool"), "f64": ("float", "int")}
        chosen = F.lit(None).cast("short")
        found = _kind_of(v)
        for loose in (True, False):  # the exact kind wins over any of the same shape
            for i in reversed(range(len(t.parts))):
                p = t.parts[i][1]
                kinds = [k for k in KINDS if p.kind in fits[k] and (loose or p.kind != "primitive" or k in exact.get(p.arg("type"), (k,))[:1])]
                chosen = F.when(found.isin(*kinds), F.lit(i).cast("short")).otherwise(chosen)
        return held(F.when(chosen.isNotNull(), F.struct(chosen.alias("_tag"), *(F.when(chosen == i, typed(v, p, f"{name}.{n}")).alias(n) for i, (n, p) in enumerate(t.parts)))))
    from quern.sources.csv import typed as from_text

    return held(from_text(F.try_variant_get(v, "$", "string"), t, name))


def read(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    parsed = documents(spark, path).select(F.parse_json("value").alias("v"))
    return parsed.select(*(typed(_at(F.col("v"), c.name), c.type, c.name).cast(relaxed(c.type.to_spark())).alias(c.name) for c in schema.columns))
