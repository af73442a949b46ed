"""Coders as dataflow: the number-to-number ones as window expressions, byte-producing ones per Arrow page.

``by`` is the stripe, whose size bounds every window; ``order`` the row position.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.coders import Pipeline
from quern.types import Stage

_WIDTHS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _window(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def wrapped(c: Column, bits: int, kind: str) -> Column:
    """A sum or difference reduced to a signed width, as machine integers wrap. ``c`` is a decimal that holds it."""
    whole, half = F.lit(Decimal(1 << bits)), F.lit(Decimal(1 << bits - 1))
    return (F.pmod(c + half, whole) - half).cast(kind)


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def delta(df: DataFrame, column: str, by: list[str], order: str) -> DataFrame:
    kind = df.schema[column].dataType.simpleString()
    before = F.coalesce(F.lag(column).over(_window(by, order)), F.lit(0))
    return df.withColumn(column, wrapped(_wide(F.col(column)) - _wide(before), _WIDTHS[kind], kind))


def undelta(df: DataFrame, column: str, by: list[str], order: str) -> DataFrame:
    kind = df.schema[column].dataType.simpleString()
    total = F.sum(_wide(F.col(column))).over(_window(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(column, wrapped(total, _WIDTHS[kind], kind))


def delta_of_delta(df: DataFrame, column: str, by: list[str], order: str) -> DataFrame:
    return delta(delta(df, column, by, order), column, by, order)


def undelta_of_delta(df: DataFrame, column: str, by: list[str], order: str) -> DataFrame:
    return undelta(undelta(df, column, by, order), column, by, order)


def deltamin(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Distance from the stripe's least value, found by a combined aggregate."""
    kind = df.schema[column].dataType.simpleString()
    least = df.groupBy(*by).agg(F.min(column).alias("_least"))
    return df.join(least, by).withColumn(column, wrapped(_wide(F.col(column)) - _wide(F.col("_least")), _WIDTHS[kind], kind)).drop("_least")


def rle(df: DataFrame, column: str, by: list[str], order: str) -> DataFrame:
    """(by, run, value, n): runs of equal neighbours, nulls equal."""
    w = _window(by, order)
    new = F.when(F.col(column).eqNullSafe(F.lag(column).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.select(*by, order, column, new.alias("_new")).select(*by, column, (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("run"))
    return runs.groupBy(*by, "run").agg(F.first(column).alias("value"), F.count("*").alias("n"))


def unrle(runs: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, run, item, value) with a row for each of a run's n."""
    return runs.select(*by, "run", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("item"), F.col("value").alias(column))


def bit_width(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Bits that hold every distance from the stripe's least value."""
    span = F.max(column) - F.min(column) + 1
    return df.groupBy(*by).agg(F.ceil(F.log2(span)).cast("int").alias("width"))


def encoded_pages(df: DataFrame, stages: dict[str, list[Stage]]) -> DataFrame:
    """(column, n, raw, data, same) for each column of each Arrow page: the encoded bytes, and whether decoding them
    gives the values back. Columns are whole numbers or floats without nulls."""
    kinds = {"tinyint": "i8", "smallint": "i16", "int": "i32", "bigint": "i64", "float": "f32", "double": "f64"}
    physical = {n: kinds[df.schema[n].dataType.simpleString()] for n in stages}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = {n: Pipeline.build(physical[n], s) for n, s in stages.items()}
        for batch in batches:
            rows = []
            for name, line in lines.items():
                x = np.ascontiguousarray(batch.column(name).to_numpy(zero_copy_only=False))
                data = line.encode(x)
                rows.append((name, len(x), x.nbytes, data, line.decode(data).tobytes() == x.tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["column", "n", "raw", "data", "same"])

    return df.select(*stages).mapInArrow(run, "column string, n long, raw long, data binary, same boolean")
