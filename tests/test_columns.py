"""Missing-value traps: float ratio semantics, NULL-keeping clips and filters, aggregate rules."""

import math

from pyspark.sql import functions as F

from ledgerlens.functions.columns import (clip_low, inf_to_null, ne_null_safe, safe_ratio, sentinel_to_null,
                                          shift_clip, status_class)
from ledgerlens.operators.aggregate import agg_columns


def test_safe_ratio_follows_float_semantics(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-2.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 1.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in df.select(safe_ratio("a", "b")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf
    assert got[2] is None and got[3] == 1.5 and got[4] is None and got[5] is None


def test_inf_to_null_and_sentinel(spark):
    df = spark.createDataFrame([(float("inf"), 365243), (float("-inf"), 5), (2.0, None)], "x double, d long")
    rows = df.select(inf_to_null("x").alias("x"), sentinel_to_null("d").alias("d")).collect()
    assert [r.x for r in rows] == [None, None, 2.0]
    assert [r.d for r in rows] == [None, 5, None]


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(-3.0,), (None,), (4.0,)], "x double")
    assert [r[0] for r in df.select(clip_low("x")).collect()] == [0.0, None, 4.0]
    assert [r[0] for r in df.select(shift_clip(F.col("x") / 10, 0.2)).collect()] == [0.0, None, 0.2]


def test_null_safe_filter_keeps_missing(spark):
    df = spark.createDataFrame([("XNA",), (None,), ("F",)], "g string")
    assert sorted(df.filter(ne_null_safe("g", "XNA")).collect(), key=str) == sorted(
        spark.createDataFrame([(None,), ("F",)], "g string").collect(), key=str)


def test_status_class(spark):
    df = spark.createDataFrame([(200,), (422,), (500,)], "c int")
    assert [r[0] for r in df.select(status_class("c")).collect()] == ["2xx", "4xx", "5xx"]


def test_aggregate_rules(spark):
    """sum of an all-missing group is 0, var of one row is NULL, a key without rows in the
    sub-population gets NULL everywhere."""
    df = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (2, 5.0, "a")], "k int, x double, s string")
    spec = {"x": ["sum", "var", "mean", "size", "nunique"]}
    out = {r.k: r for r in df.groupBy("k").agg(*agg_columns(spec, "P_")).collect()}
    assert out[1].P_x_SUM == 0.0 and out[1].P_x_MEAN is None and out[1].P_x_SIZE == 2 and out[1].P_x_NUNIQUE == 0
    assert out[2].P_x_VAR is None
    sub = {r.k: r for r in df.groupBy("k").agg(*agg_columns(spec, "B_", where=F.col("s") == "b")).collect()}
    assert sub[2].B_x_SUM is None and sub[2].B_x_SIZE is None
    assert sub[1].B_x_SUM == 0.0 and sub[1].B_x_SIZE == 1
