"""Conversion between datasets and CSV, JSON, Parquet and Avro, and measured encoding choice."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quern import picker, sinks, sources
from quern.catalog import Catalog
from quern.coders import compress_with
from quern.dataset import Dataset, write
from quern.errors import FormatError, QuernError
from quern.operators.shred import decompose
from quern.schema import Schema
from quern.types import LogicalType, Stage

DATASET = "quern"


def direction(source: str, target: str, from_: str | None = None, to: str | None = None) -> tuple[str, str]:
    """Formats of both sides by flag or extension; a name without a known extension is a dataset. Exactly one side
    must be one."""
    sides = [DATASET if f == DATASET else sources.format_of(p, f) or DATASET for p, f in ((source, from_), (target, to))]
    if sides.count(DATASET) != 1:
        raise FormatError(f"one side must be a dataset, not {sides[0]} to {sides[1]}")
    if sides[1] == "avsc":
        raise FormatError("a schema file is no target for rows")
    return sides[0], sides[1]


def convert(spark: SparkSession, source: str, target: str, from_: str | None = None, to: str | None = None, schema: Schema | None = None, catalog: Catalog | None = None, stripe_rows: int | None = None, strict: bool = False, delimiter: str = ",") -> int:
    """Converts and returns the number of rows. A given schema overrides inference on import and is not used on
    export. An empty source makes one empty stripe."""
    kind, other = direction(source, target, from_, to)
    if kind == DATASET:
        dataset = Dataset.open(spark, source, catalog)
        sinks.export(dataset.frame(), target, other, dataset.schema, delimiter, strict)
        return dataset.n_rows
    options = {"delimiter": delimiter} if kind == "csv" else {}
    found = schema or sources.infer(spark, source, kind, **options)
    df = sources.read(spark, source, kind, found, **options)
    return write(df, target, stripe_rows=stripe_rows, schema=found, catalog=catalog).n_rows


def sample(spark: SparkSession, path: str, fmt: str | None = None, rows: int = picker.SAMPLE_ROWS) -> tuple[Schema, dict[str, list], int]:
    """Schema, and the first ``rows`` rows (0: all) by column in the form that shredding takes."""
    kind = sources.format_of(path, fmt)
    if kind is None:
        dataset = Dataset.open(spark, path)
        schema, df = dataset.schema, dataset.frame()
        df = df.limit(rows) if rows else df
    else:
        schema = sources.infer(spark, path, kind)
        df = sources.read(spark, path, kind, schema, rows)
    got = df.collect()
    return schema, {c.name: [rowed(r[c.name], c.type) for r in got] for c in schema.columns}, len(got)


def rowed(v: object, t: LogicalType) -> object:
    """A collected value in the form that shredding takes: dicts for structs, (variant, value) for unions."""
    if v is None or t.kind in ("primitive", "utf8", "binary", "decimal", "date", "datetime"):
        return v
    if t.kind in ("nullable", "dictionary"):
        return rowed(v, t.inner)
    if t.kind == "struct":
        return {n: rowed(v[n], p) for n, p in t.parts}
    if t.kind == "list":
        return [rowed(x, t.inner) for x in v]
    if t.kind == "map":
        return {rowed(k, t.part("key")): rowed(x, t.part("value")) for k, x in v.items()}
    name, part = t.parts[v["_tag"]]
    return name, rowed(v[name], part)


def optimise_schema(spark: SparkSession, path: str, fmt: str | None = None, rows: int = picker.SAMPLE_ROWS, zstd_level: int = 3) -> tuple[Schema, dict[str, int]]:
    schema, values, _ = sample(spark, path, fmt, rows)
    return picker.optimise(schema, values, zstd_level)


def compare(spark: SparkSession, path: str, fmt: str | None = None, codecs: tuple[str, ...] = ("zstd", "lz4", "snappy"), rows: int = picker.SAMPLE_ROWS) -> str:
    """A markdown table of codec, bytes and ratio: each codec over the raw leaves, and the schema's own encodings."""
    schema, values, n = sample(spark, path, fmt, rows)
    leaves = [(physical, stages, leaf) for c in schema.columns for (_, physical), stages, leaf in zip(c.type.leaves(), c.encodings, decompose(c.type, values[c.name]), strict=True)]
    flat = [x if p == "bytes" else x.tobytes() for p, _, x in leaves]
    raw = sum(map(len, flat))
    found = [("raw", raw)]
    for codec in codecs:
        try:
            found.append((codec, sum(len(compress_with(x, [Stage(codec)], "bytes", bare=True)) for x in flat)))
        except QuernError as e:
            raise FormatError(f"codec {codec!r}: {e}") from e
    found.append(("schema", sum(len(compress_with(x, s, p, bare=True)) for p, s, x in leaves)))
    lines = ["| codec | bytes | ratio |", "|---|---:|---:|", *(f"| {c} | {b} | {raw / b if b else 0:.2f} |" for c, b in found)]
    return f"{n} rows\n\n" + "\n".join(lines)
