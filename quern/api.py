"""The six functions of the small Python surface."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.coders import compress, decompress
from quern.convert import rowed
from quern.dataset import Dataset, write
from quern.errors import FormatError
from quern.picker import SAMPLE_ROWS, optimise
from quern.schema import Schema

__all__ = ["compress", "decompress", "read_arrays", "read_table", "write_arrays", "write_table"]


def write_table(spark: SparkSession, path: str, table: Any, optimize: bool = True, stripe_rows: int | None = None, zstd_level: int = 3) -> Dataset:
    """Writes an Arrow table, a pandas frame or a DataFrame; an empty one makes one empty stripe. ``optimize`` measures
    encodings on a sample."""
    df = table if isinstance(table, DataFrame) else spark.createDataFrame(table)
    schema = Schema.from_spark(df.schema)
    if optimize:
        rows = df.limit(SAMPLE_ROWS).collect()
        if rows:
            schema, _ = optimise(schema, {c.name: [rowed(r[c.name], c.type) for r in rows] for c in schema.columns}, zstd_level)
    return write(df, path, stripe_rows=stripe_rows, schema=schema)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, stripe_range: tuple[int, int] | None = None) -> DataFrame:
    """Rows in order, of all stripes or of a half-open range; names and ranges are checked."""
    dataset = Dataset.open(spark, path)
    start, stop = stripe_range or (0, dataset.n_stripes)
    return dataset.stripes(start, stop, columns)


def write_arrays(spark: SparkSession, path: str, arrays: dict[str, Any]) -> Dataset:
    """Writes flat columns: numpy arrays, or lists of str or bytes."""
    kinds = {np.dtype(k): v for k, v in {"uint8": pa.int16(), "uint16": pa.int32(), "uint32": pa.int64(), "uint64": pa.decimal128(20, 0)}.items()}
    columns = {n: pa.array(a.tolist(), kinds[a.dtype]) if isinstance(a, np.ndarray) and a.dtype in kinds else pa.array(a) for n, a in arrays.items()}
    return write(spark.createDataFrame(pa.table(columns)), path)


def read_arrays(spark: SparkSession, path: str) -> dict[str, Any]:
    """Flat columns as numpy arrays or lists; nested ones are an error."""
    dataset = Dataset.open(spark, path)
    for c in dataset.schema.columns:
        if (c.type.inner if c.type.kind == "nullable" else c.type).kind in ("struct", "list", "map", "union"):
            raise FormatError(f"column {c.name!r} is nested; use read_table")
    table = read_table(spark, path).toArrow()
    plain = lambda t: pa.types.is_integer(t) or pa.types.is_floating(t)
    return {n: table.column(n).to_numpy() if plain(table.schema.field(n).type) and not table.column(n).null_count else table.column(n).to_pylist() for n in table.column_names}
