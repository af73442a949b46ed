"""A dataset as a table function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.catalog import Catalog
from quern.dataset import Dataset


def table_from(spark: SparkSession, path: str, columns: list[str] | None = None, catalog: str | None = None) -> DataFrame:
    """The rows of a dataset with the projection pushed into its scan; ``catalog`` is the folder of its schema."""
    dataset = Dataset.open(spark, path, Catalog(spark, catalog) if catalog else None)
    return dataset.frame().select(*(F.col(f"`{c}`") for c in (dataset.schema.project(columns) if columns else dataset.schema).names))
