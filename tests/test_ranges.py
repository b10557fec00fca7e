"""Running totals and carried values against a direct window, with a hot group, NULL groups and no rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.ranges import carried_forward, running_totals, with_previous


def _rows(spark):
    rnd = random.Random(3)
    rows = [(i, None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", rnd.randint(0, 9),
             rnd.choice([None, i])) for i in range(2000)]
    return spark.createDataFrame(rows, "id long, g string, n long, v long").repartition(7)


def test_running_totals_equal_a_window(spark):
    df = _rows(spark)
    got = {r.id: r.cum_n for r in running_totals(df, ["id"], ["n"], ["g"]).collect()}
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.c for r in df.select("id", F.sum("n").over(w).alias("c")).collect()}
    assert got == want and len(got) == 2000


def test_carried_forward_equals_a_window(spark):
    df = _rows(spark)
    got = {r.id: r.last_v for r in carried_forward(df, ["id"], {"last_v": "v"}, ["g"]).collect()}
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.c for r in df.select("id", F.last("v", ignorenulls=True).over(w).alias("c")).collect()}
    assert got == want


def test_no_rows_and_no_groups(spark):
    empty = spark.createDataFrame([], "id long, n long")
    assert running_totals(empty, ["id"], ["n"]).count() == 0
    one = running_totals(spark.range(1, 101).withColumn("n", F.lit(2)), ["id"], ["n"])
    assert [r.cum_n for r in one.orderBy("id").collect()] == [2 * i for i in range(1, 101)]


def test_previous_row_equals_lag(spark):
    df = _rows(spark)
    got = {r.id: r.p for r in with_previous(df, ["id"], "n", "p", ["g"]).collect()}
    w = Window.partitionBy("g").orderBy("id")
    want = {r.id: r.p for r in df.select("id", F.lag("n").over(w).alias("p")).collect()}
    assert got == want
