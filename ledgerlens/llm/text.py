"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import materialised
from ledgerlens.sources.tables import table_path

BROADCAST_ROWS = 1_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one table of ``sf_dir``."""
    return spark.read.parquet(table_path(sf_dir, name)).select(*columns)


def ascii_lower(c: Column) -> Column:
    """``c`` with A-Z lower-cased and every other character kept."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def same_document(id_a: str, key_a: str, id_b: str, key_b: str) -> Column:
    """Whether two rows have equal ids and equal text keys, also NULL ones."""
    return F.col(id_a).eqNullSafe(F.col(id_b)) & F.col(key_a).eqNullSafe(F.col(key_b))


def packed(docs: DataFrame) -> DataFrame:
    """(_row, _md5): every row as one struct, so that its column names clash with none made beside it, and its text's md5."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.md5("text").alias("_md5"))


def unpacked(rows: DataFrame, columns: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    """The ``columns`` of ``_row`` and those ``made``, which replace columns of their names."""
    made = made or {}
    return rows.select(*[made.get(c, F.col("_row")[c]).alias(c) for c in columns],
                       *[v.alias(c) for c, v in made.items() if c not in columns])


def broadcast_if_few(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` (short rows), written once, with a broadcast hint if they are at most ``most``: a join with texts then shuffles
    no text. More keys are joined by a shuffle."""
    keys = materialised(keys, "keys")
    return F.broadcast(keys) if keys.count() <= most else keys
