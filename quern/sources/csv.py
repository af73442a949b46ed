"""CSV: types from a sample, nullability from the whole file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import FormatError
from quern.schema import Schema
from quern.schema import Column as Field
from quern.types import UNITS, UTF8, LogicalType, nullable, primitive, relaxed

SAMPLE_ROWS = 1000
#: Texts that are null.
NULLS = ("", "NULL", "null", "NA")
_INT = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def _is_null(c: Column) -> Column:
    return c.isNull() | c.isin(*NULLS)


def _is_int(c: Column) -> Column:
    return F.regexp_like(c, F.lit(_INT)) & c.try_cast("bigint").isNotNull()


def _is_float(c: Column) -> Column:
    return F.regexp_like(c, F.lit(_FLOAT))


def raw(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",") -> DataFrame:
    """All columns as text; names of a file without header are col_0, col_1, ... Missing cells of ragged rows are null."""
    reader = spark.read.option("header", header).option("sep", delimiter).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("emptyValue", "")
    df = reader.csv(path)
    if not df.columns:
        raise FormatError(f"{path} has no columns")
    return df if header else df.toDF(*(f"col_{i}" for i in range(len(df.columns))))


def infer(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", full_scan: bool = False, blank_lines_null: bool = False) -> Schema:
    """Whole numbers, floats or text by column, tried in that order on the first SAMPLE_ROWS rows (all of them with
    ``full_scan``); null where any row of the file is. A column of nulls is nullable text. With ``blank_lines_null`` a
    blank line is a row of nulls, which makes every column nullable; otherwise it is no row."""
    df = raw(spark, path, header, delimiter)
    cells = {n: F.col(f"`{n}`") for n in df.columns}
    tests = []
    for i, c in enumerate(cells.values()):
        value = F.when(~_is_null(c), c)
        tests += [F.count(value).alias(f"n{i}"), F.count(F.when(value.isNotNull() & ~_is_int(value), 1)).alias(f"i{i}"), F.count(F.when(value.isNotNull() & ~_is_float(value), 1)).alias(f"f{i}")]
    sample = (df if full_scan else df.limit(SAMPLE_ROWS)).agg(*tests).first()
    nulls = df.agg(*(F.count(F.when(_is_null(c), 1)).alias(f"x{i}") for i, c in enumerate(cells.values()))).first()
    blank = blank_lines_null and spark.read.text(path).where(F.trim("value") == "").limit(1).count() > 0
    out = []
    for i, n in enumerate(df.columns):
        t = UTF8 if not sample[f"n{i}"] else primitive("i64") if not sample[f"i{i}"] else primitive("f64") if not sample[f"f{i}"] else UTF8
        out.append(Field(n, nullable(t) if nulls[f"x{i}"] or blank or not sample[f"n{i}"] else t))
    return Schema(out).validate()


def typed(c: Column, t: LogicalType, name: str) -> Column:
    """A text cell in a logical type; a cell that the type can't hold is an error naming the column."""
    if t.kind == "nullable":
        return F.when(~_is_null(c), typed(c, t.inner, name))
    if t.kind == "dictionary":
        return typed(c, t.inner, name)

    def held(x: Column) -> Column:
        return F.when(x.isNotNull(), x).otherwise(F.raise_error(F.concat(F.lit(f"column {name!r}: not {t.kind} {dict(t.args)}: "), F.coalesce(c, F.lit("null")))).cast("void"))

    kind = t.to_spark()
    if t.kind == "utf8":
        return F.coalesce(c, F.lit(""))
    if t.kind == "binary":
        return held(F.unhex(c))
    if t.kind == "primitive":
        text = F.when(F.regexp_like(c, F.lit(_FLOAT if t.arg("type")[0] == "f" else _INT)), c)
        return held(text.try_cast(kind))
    if t.kind == "date" and t.arg("unit") == "days":
        return held(F.coalesce(F.when(F.regexp_like(c, F.lit(_INT)), F.date_from_unix_date(c.try_cast("int"))), c.try_cast("date")))
    if t.kind == "datetime" and t.arg("unit") == "ns":
        whole = F.unix_micros(F.regexp_replace(c, r"(\.[0-9]{0,6})[0-9]*", "$1").try_cast("timestamp")) * 1000
        rest = F.rpad(F.regexp_extract(c, r"\.[0-9]{6}([0-9]{1,3})", 1), 3, "0").try_cast("bigint")
        return held(F.coalesce(c.try_cast("bigint"), whole + F.coalesce(rest, F.lit(0))))
    if t.kind in ("date", "datetime"):
        unit = 1000 if t.kind == "date" else UNITS[t.arg("unit")]
        ticks = F.timestamp_micros(c.try_cast("bigint") * (1_000_000 // unit))
        return held(F.coalesce(F.when(F.regexp_like(c, F.lit(_INT)), ticks.cast(kind)), c.try_cast("timestamp").cast(kind)))
    if t.kind == "decimal":
        return held(c.try_cast(kind))
    return held(F.from_json(c, kind))  # nested cells are JSON text


def read(spark: SparkSession, path: str, schema: Schema, header: bool = True, delimiter: str = ",", **_) -> DataFrame:
    df = raw(spark, path, header, delimiter)
    missing = [n for n in schema.names if n not in df.columns]
    cells = {n: F.lit("") if n in missing else F.col(f"`{n}`") for n in schema.names}
    return df.select(*(typed(cells[c.name], c.type, c.name).cast(relaxed(c.type.to_spark())).alias(c.name) for c in schema.columns))
