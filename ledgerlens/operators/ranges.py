"""Running totals and carried values over a whole sorted table, without one-task windows.

The rows are range-partitioned once by ``(groups, order)``, so a hot group is spread over as many
partitions as its rows need, and the index of the partition is kept as ``_bucket`` in a written
table (a rerun after a lost executor sees the same buckets). A window runs inside each
``(bucket, group)``; what earlier buckets of the group hold is a table of at most
groups + partitions rows. Spark sizes the partitions (``spark.sql.shuffle.partitions``, coalesced
at run time), so nothing here depends on the number of rows. Groups compare as one struct, which
keeps NULL groups. ``order`` must order the rows of a group totally for reruns to agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialised

KEYS = ["_bucket", "_group"]


def range_bucketed(df: DataFrame, order: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_bucket`` (range partition in ``(groups, order)`` order) and ``_group``, written once."""
    group = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    spread = df.repartitionByRange(*[F.col(c) for c in (*groups, *order)])
    return materialised(spread.withColumns({"_bucket": F.spark_partition_id(), "_group": group}), "ranges")


def windows(order: Sequence[str]):
    """(the rows up to the current one inside a bucket and group, the earlier buckets of a group)."""
    inside = (Window.partitionBy(*KEYS).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    earlier = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return inside, earlier


def running_totals(df: DataFrame, order: Sequence[str], sums: Sequence[str],
                   groups: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_<c>``: the inclusive running sum of each ``c`` in ``order`` within ``groups``."""
    rows = range_bucketed(df, order, groups)
    inside, earlier = windows(order)
    totals = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = totals.select(*KEYS, *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}")
                                     for c in sums])
    out = rows.join(before, KEYS).withColumns(
        {f"cum_{c}": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    return out.drop(*KEYS, *[f"_b_{c}" for c in sums])


def carried_forward(df: DataFrame, order: Sequence[str], values: dict[str, str],
                    groups: Sequence[str] = ()) -> DataFrame:
    """Add, for each ``out: value`` of ``values``, the last non-null ``value`` at or before each row in
    ``order`` within ``groups`` (the right-hand side of an as-of join, once both sides are in one table)."""
    rows = range_bucketed(df, order, groups)
    inside, earlier = windows(order)
    ends = rows.groupBy(*KEYS).agg(*[
        F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"_e_{out}") for out, v in values.items()])
    before = ends.select(*KEYS, *[F.last(f"_e_{out}", ignorenulls=True).over(earlier).alias(f"_b_{out}")
                                   for out in values])
    out = rows.join(before, KEYS).withColumns(
        {o: F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"_b_{o}")) for o, v in values.items()})
    return out.drop(*KEYS, *[f"_b_{o}" for o in values])


def with_previous(df: DataFrame, order: Sequence[str], value: str, out: str, groups: Sequence[str] = ()) -> DataFrame:
    """Add ``out``: ``value`` (never NULL) of the row before in ``order`` within ``groups``, NULL for the first."""
    rows = range_bucketed(df, order, groups)
    ends = rows.groupBy(*KEYS).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    earlier = Window.partitionBy("_group").orderBy("_bucket")
    before = ends.select(*KEYS, F.lag("_end").over(earlier).alias("_before"))
    here = F.lag(value).over(Window.partitionBy(*KEYS).orderBy(*order))
    return rows.join(before, KEYS).withColumn(out, F.coalesce(here, F.col("_before"))).drop(*KEYS, "_before")
