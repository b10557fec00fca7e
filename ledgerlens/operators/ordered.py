"""Exact order statistics without a single-partition window.

A window ``ORDER BY x`` without ``PARTITION BY`` sends every row to one task. Here the rows are
range-partitioned once (``ranges.py``): as many partitions as Spark gives the shuffle, a hot group or
value spread over several of them by the tie-break columns. Percentiles first collapse rows to
distinct ``(group, value)`` with counts, write that aggregate once, and open only the partitions that
hold a wanted rank. Percentiles of few, large groups count the rows in narrow cells of the value first,
so that only the cells of wanted ranks are sorted. NULL is a group like any other.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ranges import KEYS, range_bucketed, running_totals, windows
from ledgerlens.session import materialised


def scalar_fields(one_row: DataFrame) -> dict[str, Column]:
    """The columns of a one-row DataFrame as scalar-subquery expressions.

    Catalyst runs the subquery once (identical ones are merged and reused) and
    inlines the value into the outer projection or filter: no join, no
    broadcast of a table. An empty input gives NULLs; more than one row is an error.
    """
    s = one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns]).alias("_s")).scalar()
    return {c: s.getField(c) for c in one_row.columns}


def ordered_cumsum(df: DataFrame, order_col: str, sum_cols: list[str], group_cols: list[str] | tuple = (),
                   tiebreak: list[str] | tuple = ()) -> DataFrame:
    """Add ``cum_<c>`` = inclusive running sum of ``c`` in ``order_col`` order within groups.

    Rows with equal ``(group, order_col)`` must be pre-aggregated, or ``tiebreak``
    columns must make the order total.
    """
    return running_totals(df, [order_col, *tiebreak], sum_cols, group_cols)


def row_numbers(df: DataFrame, order_col: str, group_cols: list[str] | tuple = (),
                tiebreak: list[str] | tuple = ()) -> DataFrame:
    """1-based ``row_number`` in ``(order_col, tiebreak)`` order within groups, without one-task windows."""
    x = ordered_cumsum(df.withColumn("_one", F.lit(1).cast("bigint")), order_col, ["_one"], group_cols, tiebreak)
    return x.withColumnRenamed("cum__one", "row_number").drop("_one")


def values_at_ranks(df: DataFrame, value_col: str, ranks: Column, group_cols: list[str] | tuple = (),
                    few_groups: bool = False) -> DataFrame:
    """For each group, the values at 0-based ranks of the sorted non-missing values.

    ``ranks`` is an expression over the column ``n`` (group size) giving an
    array of ranks. Returns ``(group..., n, rank, value)``. With ``few_groups`` (each of many rows, the values
    numbers) the rows are counted by ``_cell`` first and only the cells that hold a wanted rank are sorted.
    """
    g = list(group_cols)
    present = df.filter(F.col(value_col).isNotNull())
    if few_groups:
        return _values_in_cells(present, value_col, ranks, g)
    found = _values_at(present, value_col, lambda sizes: sizes.withColumn("rank", F.explode(F.array_distinct(ranks))), g)
    return found.select(*g, "n", "rank", F.col(value_col).alias("value"))


def _cell(value: Column) -> Column:
    """Number of the cell that a value falls into, 256 cells between x and 2x: never smaller for a greater value.

    The logarithm is Java's ``StrictMath.log``, the same on every machine and never falling; NaN is the greatest value.
    """
    x = value.cast("double")
    size = F.floor(F.least(F.log(F.abs(x)), F.lit(710.0)) * (256 / math.log(2))) + 300_000       # 1 to 600,000
    return (F.when(x == 0, 0).when(F.isnan(x), 1_000_000).when(x < 0, -size).otherwise(size)).cast("int")


def _values_in_cells(present: DataFrame, value_col: str, ranks: Column, g: list[str]) -> DataFrame:
    group = F.struct(*g) if g else F.struct(F.lit(0).alias("all"))
    rows = present.select(group.alias("_g"), _cell(F.col(value_col)).alias("_c"), value_col)
    cells = rows.groupBy("_g", "_c").agg(F.count(F.lit(1)).alias("_in"))
    of_group = Window.partitionBy("_g")
    upto = of_group.orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select("_g", "_c", F.sum("_in").over(of_group).alias("n"), "_in", (F.sum("_in").over(upto) - F.col("_in")).alias("_below"))
    here = F.filter(F.array_distinct(ranks), lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_in")))
    # at most one row per group and wanted rank
    hit = materialised(cells.withColumn("_ranks", here).filter(F.size("_ranks") > 0), "cells")
    keys = F.broadcast(hit.select(F.col("_g").alias("_hg"), F.col("_c").alias("_hc")))
    near = rows.join(keys, F.col("_g").eqNullSafe(F.col("_hg")) & (F.col("_c") == F.col("_hc")), "left_semi")
    wanted = hit.select(F.struct("_g", "_c").alias("_of"), "n", "_below", F.explode("_ranks").alias("_rank"))
    wanted = wanted.select("_of", "n", "_below", (F.col("_rank") - F.col("_below")).alias("rank"))
    found = _values_at(near, value_col, lambda _: wanted, ["_g", "_c"], ["_below"])
    return found.select(*[F.col("_g").getField(c).alias(c) for c in g], "n", (F.col("rank") + F.col("_below")).alias("rank"),
                        F.col(value_col).alias("value"))


def _values_at(present: DataFrame, value_col: str, to_ranks, g: list[str], keep: list[str] | tuple = ()) -> DataFrame:
    """``(group..., value, n, rank, keep...)``: the values at the ranks of ``to_ranks((_of, n))``, a table ``(_of, n, rank, keep...)``."""
    vals = present.groupBy(*g, value_col).agg(F.count(F.lit(1)).alias("_cnt"))
    rows = range_bucketed(vals, [value_col], g)
    inside, earlier = windows([value_col])
    parts = rows.groupBy(*KEYS).agg(F.sum("_cnt").alias("_in"))
    parts = parts.select(*KEYS, "_in", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    wanted = to_ranks(rows.groupBy(F.col("_group").alias("_of")).agg(F.sum("_cnt").alias("n")))
    # a partition takes part only if a wanted rank falls into it
    hit = parts.join(wanted, (F.col("_group") == F.col("_of")) & (F.col("rank") >= F.col("_before"))
                     & (F.col("rank") < F.col("_before") + F.col("_in")))
    hit = hit.groupBy(*KEYS, "n", "_before", *keep).agg(F.collect_list("rank").alias("_ranks"))
    found = rows.join(hit, KEYS).withColumn("_hi", F.col("_before") + F.sum("_cnt").over(inside))
    here = F.filter("_ranks", lambda r: (r >= F.col("_hi") - F.col("_cnt")) & (r < F.col("_hi")))
    return found.select(*g, value_col, "n", *keep, F.explode(here).alias("rank"))


def percentile_cont(df: DataFrame, value_col: str, qs: list[float], group_cols: list[str] | tuple = (),
                    prefix: str = "p", few_groups: bool = False) -> DataFrame:
    """Exact linearly interpolated percentiles (SQL ``percentile_cont``), one row per group,
    columns ``{prefix}{int(q*100)}``. ``few_groups``: see ``values_at_ranks``."""
    g = list(group_cols)
    at = [(F.col("n") - 1) * F.lit(float(q)) for q in qs]
    ranks = F.array(*[f(pos) for pos in at for f in (F.floor, F.ceil)]).cast("array<bigint>")
    found = values_at_ranks(df, value_col, ranks, g, few_groups).groupBy(*g).agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"))
    cols = []
    for q, pos in zip(qs, at):
        low, high = F.element_at("_m", F.floor(pos)), F.element_at("_m", F.ceil(pos))
        cols.append((low + (high - low) * (pos - F.floor(pos))).alias(f"{prefix}{round(q * 100)}"))
    return found.select(*g, *cols)


def ordered_running_min(df: DataFrame, order_col: str, value_col: str, group_cols: list[str] | tuple = (),
                        tiebreak: list[str] | tuple = ()) -> DataFrame:
    """Add ``best_<value_col>`` = running minimum ("best so far") in ``order_col`` order."""
    order = [order_col, *tiebreak]
    rows = range_bucketed(df, order, group_cols)
    inside, earlier = windows(order)
    least = rows.groupBy(*KEYS).agg(F.min(value_col).alias("_least"))
    least = least.select(*KEYS, F.min("_least").over(earlier).alias("_before"))
    best = F.least("_before", F.min(value_col).over(inside))       # least() skips NULLs
    return rows.join(least, KEYS).withColumn(f"best_{value_col}", best).drop(*KEYS, "_before")


def join_groups(left: DataFrame, right: DataFrame, keys: list[str] | tuple, how: str = "inner") -> DataFrame:
    """Equality join on ``keys`` where NULL keys match; the keys of ``left`` are kept."""
    renamed = right.select(*[F.col(f"`{c}`").alias(f"_k_{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_k_{k}`")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])


def attach(left: DataFrame, right: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    """Left join on ``keys`` (NULL keys match); with no keys, attach the columns of a one-row ``right``
    to every row as scalar subqueries (NULLs if empty)."""
    if keys:
        return join_groups(left, right, list(keys), "left")
    return left.select("*", *[v.alias(c) for c, v in scalar_fields(right).items()])


def exact_percentiles(df: DataFrame, value_col: str, named_qs: dict[str, float],
                      group_cols: list[str] | tuple = ()) -> DataFrame:
    """Exact ``percentile_cont`` values per group under chosen names, e.g. ``{"p95_ms": 0.95}``.
    Groups without any non-missing value are absent (attach them with a left join)."""
    qs = list(named_qs.values())
    out = percentile_cont(df, value_col, qs, group_cols, prefix="_q")
    return out.select(*group_cols, *[F.col(f"_q{round(q * 100)}").alias(name) for name, q in named_qs.items()])
