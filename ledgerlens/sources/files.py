"""Small results as CSV and drift profiles as JSON lines, in a folder that all executors reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_MARK = "\\N"
PROFILE_SCHEMA = ("feature string, bounds array<double>, proportions array<double>, missing double, importance double")


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV part with a header; NULL is written as ``\\N``, which keeps it apart from an empty text."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", NULL_MARK).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Scan with an explicit schema; a header that names other columns is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option(
        "nullValue", NULL_MARK).csv(path)


def write_profile(profile: DataFrame, path: str) -> None:
    """A reference profile, one JSON object per feature; NULL fields are kept as null."""
    columns = [f.split()[0] for f in PROFILE_SCHEMA.split(", ")]
    profile.select(*columns).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_SCHEMA).json(path)


def first_record(df: DataFrame) -> dict | None:
    """The first row as ``{column: value}`` with None for NULL and NaN; None without rows. The order is the caller's."""
    clean = [F.nanvl(f"`{c}`", F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    row = df.select(*clean).first()
    return None if row is None else row.asDict()


def with_request_ids(df: DataFrame, column: str = "request_id") -> DataFrame:
    """``df`` with a random UUID in each row. Every evaluation draws new ones, so write the rows before using the ids twice."""
    return df.withColumn(column, F.uuid())
