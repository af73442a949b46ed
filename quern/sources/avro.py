"""Avro object container files, read and written without Spark's Avro module.

A file's blocks end in its 16-byte sync marker. So Spark's text writer writes them, with the marker as its line
separator: any Hadoop file system and the commit protocol are served.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quern.errors import ConversionError, CorruptedError, FormatError, SchemaError
from quern.schema import Column, Schema
from quern.storage import Files
from quern.types import BINARY, UTF8, LogicalType, date, datetime, list_of, map_of, nullable, primitive, union
from quern.types import decimal as decimal_type

MAGIC = b"Obj\x01"
_DAY0, _EPOCH = dt.date(1970, 1, 1), dt.datetime(1970, 1, 1)

# -- schemas

#: Logical types of Avro's primitive and annotated types.
_SIMPLE = {"boolean": primitive("u8"), "int": primitive("i32"), "long": primitive("i64"), "float": primitive("f32"), "double": primitive("f64"), "string": UTF8, "bytes": BINARY}
_LOGICAL = {
    ("int", "date"): date(),
    ("int", "time-millis"): primitive("i32"),
    ("long", "time-micros"): primitive("i64"),
    ("long", "timestamp-millis"): datetime("ms", "UTC"),
    ("long", "timestamp-micros"): datetime("us", "UTC"),
    ("long", "timestamp-nanos"): datetime("ns", "UTC"),
    ("long", "local-timestamp-millis"): datetime("ms"),
    ("long", "local-timestamp-micros"): datetime("us"),
    ("long", "local-timestamp-nanos"): datetime("ns"),
}


def logical(x: Any, names: dict[str, Any] | None = None, space: str = "", inside: tuple[str, ...] = ()) -> LogicalType:
    """The logical type of an Avro type. Recursive records, unions in unions and error types have none."""
    names = {} if names is None else names
    if isinstance(x, list):
        rest = [y for y in x if y != "null"]
        if any(isinstance(y, list) for y in rest):
            raise SchemaError("a union in a union")
        if not rest:
            return nullable(UTF8)
        if len(rest) == 1:
            t = logical(rest[0], names, space, inside)
        else:
            t = union(**{_label(y, names, space): logical(y, names, space, inside) for y in rest})
        return nullable(t) if len(rest) < len(x) else t
    if isinstance(x, str):
        if x in _SIMPLE:
            return _SIMPLE[x]
        if x == "null":
            return nullable(UTF8)
        full = _full(x, space, names)
        if full in inside:
            raise SchemaError(f"{full} contains itself")
        if full not in names:
            raise SchemaError(f"no Avro type {x!r}")
        return logical(names[full], names, space, inside)
    kind = x.get("type")
    if isinstance(kind, (dict, list)):
        return logical(kind, names, space, inside)
    if kind in ("record", "enum", "fixed"):
        space = x.get("namespace", space)
        full = x["name"] if "." in x["name"] else f"{space}.{x['name']}".lstrip(".")
        names[full] = x
        if kind == "record":
            return LogicalType("struct", (), tuple((f["name"], logical(f["type"], names, space, (*inside, full))) for f in x["fields"]))
        if kind == "enum":
            return UTF8
    if x.get("logicalType") == "decimal" and kind in ("bytes", "fixed"):
        return decimal_type(x["precision"], x.get("scale", 0))
    if kind == "fixed":
        return BINARY
    if kind == "array":
        return list_of(logical(x["items"], names, space, inside))
    if kind == "map":
        return map_of(UTF8, logical(x["values"], names, space, inside))
    if kind in _SIMPLE:
        return _LOGICAL.get((kind, x.get("logicalType")), _SIMPLE[kind])
    if kind == "error":
        raise SchemaError("error types aren't data")
    return logical(kind, names, space, inside)


def _full(name: str, space: str, names: dict) -> str:
    return name if "." in name or f"{space}.{name}" not in names else f"{space}.{name}"


def _label(x: Any, names: dict, space: str) -> str:
    if isinstance(x, str):
        return x.rsplit(".", 1)[-1]
    return str(x.get("name", x["type"])).rsplit(".", 1)[-1]


def to_schema(x: Any) -> Schema:
    t = logical(x)
    if t.kind != "struct":
        raise SchemaError("the top type must be a record")
    return Schema([Column(n, p) for n, p in t.parts]).validate()


def avro_type(t: LogicalType, name: str) -> Any:
    """The Avro type that holds a logical type; records are named after their place."""
    k = t.kind
    if k == "primitive":
        return {"i8": "int", "i16": "int", "i32": "int", "u8": "int", "u16": "int", "i64": "long", "u32": "long", "f32": "float", "f64": "double"}.get(t.arg("type")) or {"type": "bytes", "logicalType": "decimal", "precision": 20, "scale": 0}
    if k in ("utf8", "binary"):
        return "string" if k == "utf8" else "bytes"
    if k == "dictionary":
        return avro_type(t.inner, name)
    if k == "nullable":
        inner = avro_type(t.inner, name)
        return ["null", *inner] if isinstance(inner, list) else ["null", inner]
    if k == "struct":
        return {"type": "record", "name": name, "fields": [{"name": n, "type": avro_type(p, f"{name}_{n}")} for n, p in t.parts]}
    if k == "list":
        return {"type": "array", "items": avro_type(t.inner, f"{name}_item")}
    if k == "map":
        if t.part("key").kind != "utf8":
            return {"type": "array", "items": {"type": "record", "name": f"{name}_entry", "fields": [{"name": "key", "type": avro_type(t.part("key"), f"{name}_key")}, {"name": "value", "type": avro_type(t.part("value"), f"{name}_value")}]}}
        return {"type": "map", "values": avro_type(t.part("value"), f"{name}_value")}
    if k == "union":  # variants of one Avro type can't be told apart, so each is a record of its own
        return [{"type": "record", "name": f"{name}_{n}", "fields": [{"name": "value", "type": avro_type(p, f"{name}_{n}_value")}]} for n, p in t.parts]
    if k == "decimal":
        return {"type": "bytes", "logicalType": "decimal", "precision": t.arg("precision"), "scale": t.arg("scale")}
    if k == "date":
        return {"type": "int", "logicalType": "date"} if t.arg("unit") == "days" else {"type": "long", "logicalType": "local-timestamp-millis"}
    unit = {"s": "millis", "ms": "millis", "us": "micros", "ns": "nanos"}[t.arg("unit")]
    return {"type": "long", "logicalType": f"{'' if t.arg('tz') else 'local-'}timestamp-{unit}"}


# -- values


def _long(b: io.BytesIO) -> int:
    shift = out = 0
    while True:
        c = b.read(1)
        if not c:
            raise CorruptedError("avro", "a number is cut off")
        out |= (c[0] & 0x7F) << shift
        if c[0] < 0x80:
            return (out >> 1) ^ -(out & 1)
        shift += 7


def _put_long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _take(b: io.BytesIO, n: int) -> bytes:
    out = b.read(n) if n >= 0 else b""
    if n < 0 or len(out) < n:
        raise CorruptedError("avro", "bytes are cut off")
    return out


def _blocks(b: io.BytesIO) -> Iterator[int]:
    while n := _long(b):
        if n < 0:
            _long(b)
            n = -n
        yield from range(n)


Reader = Callable[[io.BytesIO], Any]


def reader(x: Any, names: dict[str, Any], space: str = "") -> Reader:
    """Reads one value of an Avro type into what Spark's Arrow conversion takes."""
    if isinstance(x, list):
        parts = [reader(y, names, space) for y in x]
        others = [i for i, y in enumerate(x) if y != "null"]
        if len(others) <= 1:
            return lambda b: parts[_long(b)](b)
        labels = [_label(x[i], names, space) for i in others]

        def one(b: io.BytesIO) -> Any:
            i = _long(b)
            v = parts[i](b)
            return None if x[i] == "null" else {"_tag": others.index(i), **{n: v if j == others.index(i) else None for j, n in enumerate(labels)}}

        return one
    if isinstance(x, str):
        if x == "null":
            return lambda b: None
        if x == "boolean":
            return lambda b: _take(b, 1)[0]
        if x in ("int", "long"):
            return _long
        if x == "float":
            return lambda b: struct.unpack("<f", _take(b, 4))[0]
        if x == "double":
            return lambda b: struct.unpack("<d", _take(b, 8))[0]
        if x == "bytes":
            return lambda b: _take(b, _long(b))
        if x == "string":
            return lambda b: _take(b, _long(b)).decode()
        return reader(names[_full(x, space, names)], names, space)
    kind, note = x["type"], x.get("logicalType")
    if kind in ("record", "enum", "fixed"):
        space = x.get("namespace", space)
        names[x["name"] if "." in x["name"] else f"{space}.{x['name']}".lstrip(".")] = x
    if kind == "record":
        fields = [(f["name"], reader(f["type"], names, space)) for f in x["fields"]]
        return lambda b: {n: r(b) for n, r in fields}
    if kind == "enum":
        return lambda b: x["symbols"][_long(b)]
    if kind == "array":
        item = reader(x["items"], names, space)
        return lambda b: [item(b) for _ in _blocks(b)]
    if kind == "map":
        value = reader(x["values"], names, space)
        return lambda b: [(_take(b, _long(b)).decode(), value(b)) for _ in _blocks(b)]
    size = (lambda b: x["size"]) if kind == "fixed" else _long
    if note == "decimal" and kind in ("bytes", "fixed"):
        scale = x.get("scale", 0)
        context = decimal.Context(prec=80)
        return lambda b: decimal.Decimal(int.from_bytes(_take(b, size(b)), "big", signed=True)).scaleb(-scale, context)
    if kind == "fixed":
        return lambda b: _take(b, x["size"])
    if kind == "int" and note == "date":
        return lambda b: _DAY0 + dt.timedelta(days=_long(b))
    if kind == "long" and note and note.removeprefix("local-") in ("timestamp-millis", "timestamp-micros"):
        scale, zone = (1000 if note.endswith("millis") else 1), None if note.startswith("local-") else dt.UTC
        start = _EPOCH.replace(tzinfo=zone)
        return lambda b: start + dt.timedelta(microseconds=_long(b) * scale)
    return reader(kind, names, space)


def writer(t: LogicalType) -> Callable[[Any], bytes]:
    """Writes one Python value of a logical type."""
    k = t.kind
    if k == "dictionary":
        return writer(t.inner)
    if k == "nullable":
        inner = writer(t.inner)
        if t.inner.kind == "union":  # branches follow null's
            return lambda v: b"\0" if v is None else _put_long(v["_tag"] + 1) + inner(v)[len(_put_long(v["_tag"])) :]
        return lambda v: b"\0" if v is None else b"\x02" + inner(v)
    if k == "primitive":
        kind = t.arg("type")
        if kind == "f32":
            return lambda v: struct.pack("<f", v)
        if kind == "f64":
            return lambda v: struct.pack("<d", v)
        return _whole if kind == "u64" else lambda v: _put_long(int(v))
    if k == "utf8":
        return lambda v: _put_long(len(r := v.encode())) + r
    if k == "binary":
        return lambda v: _put_long(len(v)) + bytes(v)
    if k == "struct":
        parts = [(n, writer(p)) for n, p in t.parts]
        return lambda v: b"".join(w(v[n]) for n, w in parts)
    if k in ("list", "map"):
        if k == "list":
            item = writer(t.inner)
        else:
            key, value = writer(t.part("key")), writer(t.part("value"))
            item = lambda e: key(e[0]) + value(e[1])

        def many(v: Any) -> bytes:
            v = list(v.items()) if isinstance(v, dict) else v
            return (_put_long(len(v)) + b"".join(map(item, v)) if len(v) else b"") + b"\0"

        return many
    if k == "union":
        parts = [(n, writer(p)) for n, p in t.parts]
        return lambda v: _put_long(v["_tag"]) + parts[v["_tag"]][1](v[parts[v["_tag"]][0]])
    if k == "decimal":
        scale, context = t.arg("scale"), decimal.Context(prec=80)
        return lambda v: _whole(int(v.scaleb(scale, context)))
    if k == "date" and t.arg("unit") == "days":
        return lambda v: _put_long((v - _DAY0).days)
    unit = "ms" if k == "date" else t.arg("unit")
    if unit == "ns":
        return lambda v: _put_long(int(v))
    step = dt.timedelta(microseconds=1 if unit == "us" else 1000)
    return lambda v: _put_long(((v if v.tzinfo is None else v.astimezone(dt.UTC).replace(tzinfo=None)) - _EPOCH) // step)


def _whole(n: int) -> bytes:
    n = int(n)
    raw = n.to_bytes((n + (n < 0)).bit_length() // 8 + 1, "big", signed=True)
    return _put_long(len(raw)) + raw


# -- files


def head(data: bytes) -> tuple[dict[str, bytes], bytes, int]:
    """Metadata, sync marker and the place of the first block."""
    b = io.BytesIO(data)
    if b.read(4) != MAGIC:
        raise FormatError("no Avro container")
    meta = {}
    for _ in _blocks(b):
        key = _take(b, _long(b)).decode()
        meta[key] = _take(b, _long(b))
    return meta, _take(b, 16), b.tell()


def records(data: bytes) -> Iterator[Any]:
    meta, sync, at = head(data)
    codec = meta.get("avro.codec", b"null").decode()
    read_one = reader(json.loads(meta["avro.schema"]), {})
    b = io.BytesIO(data)
    b.seek(at)
    while b.tell() < len(data):
        count, size = _long(b), _long(b)
        body = _take(b, size)
        if _take(b, 16) != sync:
            raise CorruptedError("avro", "a block's sync marker differs")
        try:
            if codec == "deflate":
                body = zlib.decompress(body, -15)
            elif codec == "zstandard":
                import zstandard

                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            elif codec != "null":
                raise FormatError(f"no codec {codec!r}")
        except zlib.error as e:
            raise CorruptedError("avro", str(e)) from e
        inner = io.BytesIO(body)
        for _ in range(count):
            yield read_one(inner)


def infer(spark: SparkSession, path: str) -> Schema:
    """The schema in an .avsc file, or in the head of the first container file under ``path``."""
    if path.endswith(".avsc"):
        return to_schema(json.loads(Files(spark).read(path)))
    first = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    start = first.select(F.substring("content", 1, 1 << 20).alias("c")).limit(1).collect()
    if not start:
        raise FormatError(f"{path} has no Avro file")
    return to_schema(json.loads(head(bytes(start[0][0]))[0]["avro.schema"]))


def read(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """The records of the container files under ``path``, a file to a task at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    fields = schema.to_spark()
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list = []
                for r in records(content.as_py()):
                    rows.append(r)
                    if len(rows) == 1000:
                        yield _batch(rows, arrow)
                        rows = []
                if rows:
                    yield _batch(rows, arrow)

    return files.mapInArrow(run, fields)


def _batch(rows: list, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)


def write(df: DataFrame, path: str, schema: Schema, block_rows: int = 1000, codec: str = "deflate") -> None:
    """A container file per partition."""
    if codec not in ("null", "deflate"):
        raise FormatError(f"no codec {codec!r}")
    top = avro_type(LogicalType("struct", (), tuple((c.name, c.type) for c in schema.columns)), "row")
    text = json.dumps(top).encode()
    sync = hashlib.sha256(text).hexdigest()[:16]
    start = MAGIC + _put_long(2) + b"".join(_put_long(len(x)) + x for x in (b"avro.schema", text, b"avro.codec", codec.encode())) + b"\0"
    parts = [(c.name, writer(c.type)) for c in schema.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([start], pa.binary())], names=["block"])
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                rows = batch.slice(at, block_rows).to_pylist()
                body = bytearray()
                for r in rows:
                    for name, put in parts:
                        try:
                            body += put(r[name])
                        except (AttributeError, TypeError) as e:
                            raise ConversionError(name, f"{r[name]!r}: {e}") from e
                out = bytes(body)
                if codec == "deflate":
                    c = zlib.compressobj(6, zlib.DEFLATED, -15)
                    out = c.compress(out) + c.flush()
                yield pa.RecordBatch.from_arrays([pa.array([_put_long(len(rows)) + _put_long(len(out)) + out], pa.binary())], names=["block"])

    blocks = df.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.mode("overwrite").option("lineSep", sync).text(path)
