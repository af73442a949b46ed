"""Readers with schema inference: CSV, JSON, Parquet, Avro."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.errors import FormatError
from quern.schema import Schema

FORMATS = ("csv", "json", "ndjson", "parquet", "avro", "avsc")


def format_of(path: str, given: str | None = None) -> str | None:
    """The format named, or that of the extension; none for other names (datasets)."""
    if given:
        if given not in FORMATS:
            raise FormatError(f"no format {given!r}")
        return given
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return {"jsonl": "ndjson", "tsv": "csv"}.get(ext, ext if ext in FORMATS else None)


def infer(spark: SparkSession, path: str, fmt: str | None = None, **options) -> Schema:
    """The schema of a file, as its format's module finds it."""
    from quern.sources import avro, csv, json, parquet

    kind = format_of(path, fmt)
    if kind == "csv":
        return csv.infer(spark, path, **options)
    if kind in ("json", "ndjson"):
        return json.infer(spark, path, **options)
    if kind == "parquet":
        return parquet.infer(spark, path)
    if kind in ("avro", "avsc"):
        return avro.infer(spark, path)
    raise FormatError(f"{path}: unknown format")


def read(spark: SparkSession, path: str, fmt: str | None = None, schema: Schema | None = None, limit: int = 0, **options) -> DataFrame:
    """The rows of a file in the types of ``schema``, inferred where none is given; the first ``limit`` ones, 0 for
    all (in file order for a single file)."""
    from quern.sources import avro, csv, json, parquet

    kind = format_of(path, fmt)
    schema = schema or infer(spark, path, kind, **options)
    if kind == "csv":
        df = csv.read(spark, path, schema, **options)
    elif kind in ("json", "ndjson"):
        df = json.read(spark, path, schema)
    elif kind == "parquet":
        df = parquet.read(spark, path, schema)
    elif kind == "avro":
        df = avro.read(spark, path, schema)
    elif kind == "avsc":
        raise FormatError(f"{path} holds a schema and no rows")
    else:
        raise FormatError(f"{path}: unknown format")
    return df.limit(limit) if limit else df
