"""Scans of the driver's Parquet tables, with explicit column lists so that the
scan carries a pruned ``ReadSchema`` and pushed filters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_schemas: dict[tuple[str, str], StructType] = {}      # by application and path


def scan(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan of one table, optionally restricted to ``columns``.

    Spark reads a footer, as a job, to learn a table's schema. It is kept for the application, as a metastore would, so
    that a query that scans a table for several roles, or again, builds its plan without a job; the files are listed
    each time. A table whose columns change meanwhile is read with the columns it had (``forget_schemas``).
    """
    path = table_path(sf_dir, name)
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    df = spark.read.schema(_schemas[key]).parquet(path)
    return df.select(*columns) if columns else df


def forget_schemas() -> None:
    """Learn the schemas of all tables again at their next scan."""
    _schemas.clear()


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views over every driver table (used by the parameterised SQL reads)."""
    for name in names:
        if os.path.exists(table_path(sf_dir, name)):
            scan(spark, sf_dir, name).createOrReplaceTempView(name)
