"""Missingness as a feature of its own: the indicator vectors and models that need them."""

import random

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlens.operators import evaluate as E
from ledgerlens.operators import ml as M


def test_indicator_vector(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, None, nan), (2, None, 2.0, 3.0), (3, 0.0, None, None)], "id int, a double, `b c` double, d double")
    assert M.columns_with_missing(df, ["a", "b c", "d"]) == ["a", "b c", "d"]
    assert M.columns_with_missing(df.filter("id = 2"), ["a", "b c", "d"]) == ["a"] and M.columns_with_missing(df, []) == []
    got = M.missing_vector(df, ["b c", "d", "a"]).select("id", vector_to_array("missing").alias("m"))
    assert {r.id: r.m for r in got.collect()} == {1: [1.0, 1.0, 0.0], 2: [0.0, 0.0, 1.0], 3: [1.0, 1.0, 0.0]}
    wide = spark.createDataFrame([(1, None, *[1.0] * 9)], "id int, " + ", ".join(f"c{i} double" for i in range(10)))
    vector = M.missing_vector(wide, [f"c{i}" for i in range(10)]).first()["missing"]
    assert type(vector).__name__ == "SparseVector" and list(vector.indices) == [0]


def test_a_model_learns_from_missingness(spark):
    """The label is whether ``a`` is missing; its values, and so its median, say nothing."""
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        y = rnd.random() < 0.5
        rows.append((i, float(y), 1.0, None if y else rnd.choice([-1.0, 0.0, 1.0]), rnd.random()))
    train = spark.createDataFrame(rows, f"id int, {M.LABEL} double, {M.WEIGHT} double, a double, b double")
    aucs = []
    for indicators in ([], M.columns_with_missing(train, ["a", "b"])):
        for estimator, scale in ((M.logistic(), True), (M.boosted(3, 2), False)):
            model = M.pipeline(["a", "b"], estimator, scale, indicators).fit(train)
            scored = M.positive_probability(model.transform(train)).select(F.col(M.LABEL).cast("int").alias("y"), "p")
            aucs.append(E.auc_rank(scored).first()["auc"])
    assert aucs[0] < 0.75 and aucs[2] > 0.999 and aucs[3] > 0.999
