"""A category catalogue as a stored, versioned table: fitted once, read by the feature builders.

``{path}/version=<version>`` holds one row per categorical column: ``table, column, values``. A version is never
overwritten, so the schema of the features built with it is fixed; a category that it does not know encodes as all zeros and
is counted by ``unseen_categories``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.encode import fit_catalogue

SCHEMA = "`table` string, `column` string, `values` array<string>"


def store_catalogue(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], path: str, version: str) -> None:
    """Fit and write the catalogue of ``{table: (rows, categorical columns)}``; an existing version is an error.

    What passes through the driver is at most ``MAX_CATEGORIES`` values of each column, checked by ``fit_catalogue``.
    """
    rows = [(table, column, values) for table, (df, columns) in tables.items()
            for column, values in fit_catalogue(df, columns).items()]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_catalogue(spark: SparkSession, path: str, version: str) -> dict[str, dict[str, list[str]]]:
    """``{table: {column: sorted values}}`` of a stored version, for ``one_hot`` and the feature builders."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(f"{path}/version={version}").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"no catalogue of version {version!r} in {path}") from missing
    out: dict[str, dict[str, list[str]]] = {}
    for r in sorted(rows, key=lambda r: (r["table"], r["column"])):
        out.setdefault(r["table"], {})[r["column"]] = list(r["values"])
    return out


def unseen_categories(df: DataFrame, catalogue: dict[str, list[str]]) -> DataFrame:
    """``(column, n_rows, n_missing, n_unseen, n_unseen_values, first_unseen)``, one row per catalogued column, zeros for an empty
    table. ``n_unseen`` counts rows whose value the catalogue does not hold; ``first_unseen`` is the smallest such value.

    The columns are stacked once; the counts per value are combined map-side, so a value that a third of the rows have is one
    partial count per task. A NULL is missing, not unseen; an empty string is a value.
    """
    spark = df.sparkSession
    known = F.create_map(*[x for c, values in catalogue.items() for x in (
        F.lit(c), F.array(*[F.lit(v) for v in values]).cast("array<string>"))])
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in catalogue])))
    counts = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    unseen = F.col("value").isNotNull() & ~F.array_contains(known[F.col("column")], F.col("value"))
    found = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("n_missing"),
        F.sum(F.when(unseen, F.col("n"))).alias("n_unseen"), F.count_if(unseen).alias("n_unseen_values"),
        F.min(F.when(unseen, F.col("value"))).alias("first_unseen"))
    every = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in catalogue])).alias("column"))
    return every.join(found, "column", "left").fillna(0, ["n_rows", "n_missing", "n_unseen", "n_unseen_values"])
