"""Shared plumbing of the corpus operators: the shared work folder, written tables, tokenising."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not _FALLBACK:
            _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="quern-"))
        folder = _FALLBACK[0]
    return f"{folder.rstrip('/')}/quern"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes a query's shuffle files as it ends: what is written is never computed again from them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that no later plan reads."""
    for df in tables:
        delete_path(df.sparkSession, df._quern_path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def columns_for(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under internal names, so that no other column can clash."""
    return df.select(*(F.col(f"`{src}`").alias(dst) for dst, src in wanted.items()))


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: names with dots or repeated names can then be told apart."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def rows_mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df`` with its batches passed through ``run``, which keeps their columns and finds them by place."""
    plain = plain_names(df)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
