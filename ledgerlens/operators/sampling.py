"""Seeded, hash-based sampling and splitting (reproducible across engines and runs).

The generators of the reference (numpy / scikit-learn) cannot be reproduced on
a cluster; every row instead gets an order key from ``md5(seed || id)`` and the
samples, halves, folds and hold-outs are defined on that key. Rank-based
splits use the distributed row numbers of ``ordered.row_numbers``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ordered import join_groups, row_numbers
from ledgerlens.session import materialised

SEED = 42
RANGES = 4096           # parts of the hash keys in which the rows of a class are numbered, a power of 2


def hash_key(id_col: str, seed: int = SEED) -> Column:
    """60-bit integer from the first 15 hex digits of ``md5(seed || id)``."""
    h = F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def sql_hash_key(id_expr: str, seed: int = SEED) -> str:
    return f"CAST(('0x' || substr(md5('{seed}' || CAST({id_expr} AS VARCHAR)), 1, 15)) AS BIGINT)"


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = SEED) -> DataFrame:
    """``n`` rows without replacement: the smallest hash keys (a distributed top-k)."""
    return df.withColumn("_h", hash_key(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")


def halves(df: DataFrame, id_col: str, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """A 50 % sample by hash parity and its complement (with the rows without an id)."""
    even = F.coalesce(hash_key(id_col, seed) % 2 == 0, F.lit(False))
    return df.filter(even), df.filter(~even)


def stratified_folds(df: DataFrame, label_col: str, id_col: str, k: int = 3, seed: int = SEED) -> DataFrame:
    """Fold = (rank of the hash key within the class - 1) mod k: classes spread evenly over folds.

    The keys are spread evenly, so their first bits cut a class into ``RANGES`` parts of about the same size. How many rows of
    the class come before a part is counted from labels and ids alone (a first, narrow pass over ``df``). The rows are shuffled once,
    to be numbered inside their part, and come out sorted by class, key and id in each partition; nothing else is written.
    """
    shift = 60 - int(math.log2(RANGES))
    keyed = df.withColumn("_h", hash_key(id_col, seed))
    keyed = keyed.withColumn("_range", F.coalesce(F.shiftright("_h", shift), F.lit(-1)))       # -1: no id, before all others
    counts = keyed.groupBy(label_col, "_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(label_col).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = materialised(counts.select(label_col, "_range", (F.sum("_n").over(upto) - F.col("_n")).alias("_before")), "folds")
    inside = Window.partitionBy(label_col, "_range").orderBy("_h", id_col)
    ranked = join_groups(keyed.withColumn("_in", F.row_number().over(inside)), before, [label_col, "_range"])
    fold = (F.col("_before") + F.col("_in") - 1) % k
    return ranked.withColumn("fold", fold.cast("int")).drop("_h", "_range", "_in", "_before")


def stratified_sample(df: DataFrame, label_col: str, id_col: str, size: int, seed: int = SEED) -> DataFrame:
    """Fixed-size sample with class shares kept: quota = floor(size * n_class / n + 0.5)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    total = counts.agg(F.sum("_nc")).scalar()
    quota = counts.select(label_col, F.floor(F.lit(size) * F.col("_nc") / total + 0.5).alias("_quota"))
    keyed = df.withColumn("_h", hash_key(id_col, seed))
    ranked = row_numbers(keyed, "_h", [label_col], tiebreak=[id_col])
    return (join_groups(ranked, quota, [label_col])
            .filter(F.col("row_number") <= F.col("_quota")).drop("_h", "row_number", "_quota"))


def holdout(df: DataFrame, id_col: str, train_share: float = 0.85, seed: int = SEED) -> DataFrame:
    """Random permutation by hash; the first ``floor(train_share * n)`` rows are ``train``."""
    keyed = df.withColumn("_h", hash_key(id_col, seed))
    n = keyed.agg(F.count(F.lit(1))).scalar()
    ranked = row_numbers(keyed, "_h", tiebreak=[id_col])
    part = F.when(F.col("row_number") <= F.floor(F.lit(train_share) * n), "train").otherwise("valid")
    return ranked.withColumn("part", part).drop("_h", "row_number")
