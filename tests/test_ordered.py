"""Distributed order statistics against direct computation, including a skewed value."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.ordered import (attach, ordered_cumsum, ordered_running_min, percentile_cont, row_numbers,
                                          values_at_ranks)


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    rows = [(i, "g1" if i % 3 else "g2", 5.0 if i % 3 == 0 else round(rnd.random() * 100, 2)) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g string, v double"), rows


def test_row_numbers_are_a_permutation(data):
    df, rows = data
    got = sorted(r.row_number for r in row_numbers(df, "v", tiebreak=["id"]).collect())
    assert got == list(range(1, len(rows) + 1))
    direct = {r.id: r.rn for r in df.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("rn")).collect()}
    mine = {r.id: r.row_number for r in row_numbers(df, "v", tiebreak=["id"]).collect()}
    assert mine == direct


def test_cumsum_grouped(data):
    df, _ = data
    mine = {r.id: r.cum_v for r in ordered_cumsum(df, "v", ["v"], ["g"], tiebreak=["id"]).collect()}
    w = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    direct = {r.id: r.c for r in df.select("id", F.sum("v").over(w).alias("c")).collect()}
    assert all(abs(mine[k] - direct[k]) < 1e-6 for k in direct)


def test_percentile_cont_matches_numpy(data):
    df, rows = data
    got = {r.g: r for r in percentile_cont(df, "v", [0.1, 0.5, 0.95], ["g"]).collect()}
    for g in ("g1", "g2"):
        vals = np.array([v for _, gg, v in rows if gg == g])
        for q, name in ((0.1, "p10"), (0.5, "p50"), (0.95, "p95")):
            assert getattr(got[g], name) == pytest.approx(np.quantile(vals, q))


def test_nearest_rank(data):
    df, rows = data
    vals = sorted(v for _, _, v in rows)
    n = len(vals)
    idx = min(n - 1, int(0.95 * n))
    got = values_at_ranks(df, "v", F.array(F.lit(idx).cast("bigint"))).first()
    assert got.value == vals[idx]


def test_running_min(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5.0, None, 3.0, 4.0, 1.0, 2.0])], "n long, v double")
    got = [r.best_v for r in ordered_running_min(df, "n", "v").orderBy("n").collect()]
    assert got == [5.0, 5.0, 3.0, 3.0, 1.0, 1.0]


def test_null_groups_and_one_hot_value_match_duckdb(spark):
    import duckdb
    rows = [(None if i % 4 == 0 else "a" if i % 4 < 3 else "b", 1.5 if i % 3 else float(i % 50)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(8)
    got = {r["g"]: r.asDict() for r in percentile_cont(df, "x", [0.1, 0.25, 0.5, 0.9], ["g"]).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g VARCHAR, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows[:1000])
    con.executemany("INSERT INTO t VALUES (?, ?)", rows[1000:])
    want = con.execute("SELECT g, quantile_cont(x, 0.1), quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.9) "
                       "FROM t GROUP BY g").fetchall()
    assert {w[0] for w in want} == set(got) == {None, "a", "b"}
    for g, *qs in want:
        assert [got[g][f"p{q}"] for q in (10, 25, 50, 90)] == pytest.approx(qs)
    ranked = row_numbers(df.withColumn("id", F.monotonically_increasing_id()), "x", ["g"], tiebreak=["id"])
    assert ranked.groupBy("g").agg(F.max("row_number").alias("m"), F.count("x").alias("n")).filter("m <> n").count() == 0
    attached = attach(df.groupBy("g").count(), percentile_cont(df, "x", [0.5], ["g"]), ["g"])
    assert attached.filter("p50 IS NULL").count() == 0


def test_ungrouped_percentiles_of_empty_and_tied_input(spark):
    from ledgerlens.operators.ordered import exact_percentiles
    empty = spark.createDataFrame([], "x double")
    rows = exact_percentiles(empty, "x", {"p50": 0.5}).collect()
    assert [r["p50"] for r in rows] in ([], [None])
    tied = spark.createDataFrame([(1.0,)] * 5 + [(3.0,)], "x double")
    r = exact_percentiles(tied, "x", {"p50": 0.5, "p90": 0.9}).collect()[0]
    assert r["p50"] == 1.0 and abs(r["p90"] - 2.0) < 1e-12
