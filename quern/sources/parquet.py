"""Parquet: the schema is the footer's."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from quern.errors import FormatError
from quern.schema import Schema
from quern.types import LogicalType, datetime, nullable, primitive, relaxed

_NANOS = "spark.sql.legacy.parquet.nanosAsLong"
_FIELD = re.compile(r"^  (required|optional|repeated) (\S+) (\S+?)(?: \((.*)\))?(?: = \d+)?( \{|;)$", re.M)


def footer(spark: SparkSession, path: str) -> dict[str, tuple[str, str, str]]:
    """(repetition, physical type or group, annotation) of each top-level field in the first file under ``path``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(conf).listFiles(top, True)
    while files.hasNext():
        status = files.next()
        if status.getLen() and not status.getPath().getName().startswith(("_", ".")):
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, conf))
            try:
                text = reader.getFooter().getFileMetaData().getSchema().toString()
            finally:
                reader.close()
            return {m[3]: (m[1], m[2], m[4] or "") for m in _FIELD.finditer(text)}
    raise FormatError(f"{path} has no Parquet file")


def _open(spark: SparkSession, path: str, fields: dict[str, tuple[str, str, str]]) -> DataFrame:
    if any("NANOS" in note for _, _, note in fields.values()):
        spark.conf.set(_NANOS, "true")  # nanoseconds don't fit Spark's timestamps: they come as whole numbers
    return spark.read.option("mergeSchema", "false").parquet(path)


def infer(spark: SparkSession, path: str) -> Schema:
    """Types of the columns, with what Spark widens or drops taken from the footer: unsigned numbers, nanoseconds,
    and whether a column may be null."""
    fields = footer(spark, path)
    schema = Schema.from_spark(_open(spark, path, fields).schema)

    def exact(name: str, t: LogicalType) -> LogicalType:
        repetition, _, note = fields.get(name, ("optional", "", ""))
        inner = t.inner if t.kind == "nullable" else t
        if m := re.fullmatch(r"INTEGER\((8|16|32|64),false\)", note):
            inner = primitive(f"u{m[1]}")
        elif m := re.fullmatch(r"TIMESTAMP\(NANOS,(true|false)\)", note):
            inner = datetime("ns", "UTC" if m[1] == "true" else None)
        return inner if repetition == "required" else nullable(inner) if t.kind == "nullable" else inner

    return Schema([replace(c, type=exact(c.name, c.type), encodings=[]) for c in schema.columns]).validate()


def read(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """The schema's columns in its types. An empty text stays one."""
    df = _open(spark, path, footer(spark, path))
    return df.select(*(df[f"`{c.name}`"].cast(relaxed(c.type.to_spark())).alias(c.name) for c in schema.columns))
