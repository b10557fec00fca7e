"""The node table against the fitted model, and its operators against plain counting."""

import math
import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerlens.operators import ml as M
from ledgerlens.operators import search as S
from ledgerlens.operators import trees as T

NAMES = ["a", "b", "c d", "unused"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    out = []
    for k in range(900):
        a, b, c = rnd.random(), rnd.gauss(0, 1), float(rnd.randrange(5))
        out.append((k, int(rnd.random() < 1 / (1 + math.exp(-(3 * a + b - 0.6 * c)))), a, b, c, 1.0))
    return spark.createDataFrame(out, "id long, y int, a double, b double, `c d` double, unused double").repartition(4).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    model = GBTClassifier(labelCol="y", maxIter=12, maxDepth=3, stepSize=0.2, seed=1).fit(vectors)
    nodes = T.node_table(model, NAMES)
    return vectors, model, nodes, T.Forest.of(nodes)


def auc(pairs):
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_last_stage_is_the_model(rows, fitted):
    vectors, model, _, forest = fitted
    assert len(forest.trees) == 12 and forest.features() == ["a", "b", "c d"]
    got = {r.id: r for r in T.staged_margins(rows, forest, ["id"]).withColumn("p", T.probability(F.get("margins", F.lit(11)))).collect()}
    for r in M.positive_probability(model.transform(vectors)).select("id", "p", "rawPrediction").collect():
        assert len(got[r.id].margins) == 12
        assert got[r.id].p == pytest.approx(r.p, abs=1e-9) and got[r.id].margins[-1] == pytest.approx(r.rawPrediction[1], abs=1e-9)


def test_learning_curve(rows, fitted):
    vectors, model, _, forest = fitted
    parts = rows.withColumn("part", F.when(F.col("id") % 3 == 0, "valid").otherwise("train"))
    curve = {(r.part, r.iteration): r for r in T.learning_curve(parts, forest).collect()}
    assert len(curve) == 24
    for part, condition in (("valid", "id % 3 = 0"), ("train", "id % 3 <> 0")):
        # the model's own loss is twice the log loss of the probability
        for k, loss in enumerate(model.evaluateEachIteration(vectors.filter(condition)), start=1):
            assert 2 * curve[part, k].log_loss == pytest.approx(loss, abs=1e-9)
    staged = T.staged_margins(rows.filter("id % 3 = 0"), forest, ["y"]).collect()
    for k in (1, 5, 12):
        assert curve["valid", k].auc == pytest.approx(auc([(r.y, r.margins[k - 1]) for r in staged]))
    assert curve["train", 12].auc > curve["train", 1].auc


def test_permutation_drops_equal_full_rescoring(rows, fitted):
    vectors, model, _, forest = fitted
    drops = {(r.feature, r["repeat"]): r.auc_drop for r in T.permutation_drops(rows, forest, NAMES, [7, 8]).collect()}
    assert len(drops) == 2 * len(NAMES) and drops["unused", 1] == drops["unused", 2] == 0.0
    data = {r.id: r.asDict() for r in rows.collect()}

    def score(records):
        df = rows.sparkSession.createDataFrame([(r["id"], r["y"], *(r[n] for n in NAMES)) for r in records],
                                               "id long, y int, a double, b double, `c d` double, unused double")
        out = model.transform(VectorAssembler(inputCols=NAMES, outputCol="features").transform(df))
        return auc([(r.y, r.rawPrediction[1]) for r in out.select("y", "rawPrediction").collect()])
    base = score(data.values())
    for repeat, seed in ((1, 7), (2, 8)):
        partner = {r.id: r.partner for r in M.permutation_partners(rows, seed).collect()}
        for f in NAMES[:3]:
            moved = [dict(r, **{f: data[partner[k]][f]}) for k, r in data.items()]
            assert drops[f, repeat] == pytest.approx(base - score(moved), abs=1e-9)


def test_gain_equals_the_models_importances(fitted):
    _, model, nodes, _ = fitted
    found = {r.feature: r for r in T.gain_importance(nodes).collect()}
    assert sum(r.share for r in found.values()) == pytest.approx(1) and max(r.cum_share for r in found.values()) == pytest.approx(1)
    # one tree: the model divides by each tree's sum before it adds the trees up
    first = nodes.filter("tree = 0")
    one = {r.feature: r.share for r in T.gain_importance(first).collect()}
    want = model.trees[0].featureImportances
    assert one == pytest.approx({NAMES[i]: want[i] for i in map(int, want.indices) if want[i] > 0})


def test_missing_goes_right_and_one_leaf(spark):
    nodes = spark.createDataFrame([(0, 0, "x", 1.0, 1, 2, None, 3.0), (0, 1, None, None, None, None, 0.5, None),
                                   (0, 2, None, None, None, None, -0.5, None), (1, 0, None, None, None, None, 0.25, None)], T.NODES)
    rows = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "id int, x double")
    got = {r.id: r.m for r in rows.select("id", T.Forest.of(nodes).margin().alias("m")).collect()}
    assert got == {1: 0.75, 2: -0.25, 3: -0.25}


def test_halving(spark, rows):
    train = rows.select("id", F.col("y").cast("double").alias(M.LABEL), F.lit(1.0).alias(M.WEIGHT), (F.col("id") % 2).cast("int").alias("fold"),
                        "a", "b", F.col("`c d`").alias("c"))
    space = [dict(depth=d, step=0.3, rows=1.0, least=5) for d in (1, 2, 3)]
    trials, scores = S.halving_search(train, ["a", "b", "c"], space, [(1, 1), (3, 2)])
    trials = trials.collect()
    assert [len([t for t in trials if t.rung == k]) for k in (1, 2)] == [3, 2]
    assert [t.state for t in trials if t.rung == 2].count("best") == 1 and {t.state for t in trials if t.rung == 1} == {"kept", "dropped"}
    # the cost of every rung, from its written scores, in another engine
    import duckdb
    scored = scores.toPandas()  # noqa: F841 (read by duckdb)
    grid = ", ".join(f"({t})" for t in S.E.SWEEP)
    costs = duckdb.sql(f"""
        SELECT candidate, rung, avg(cost) AS cost FROM (
          SELECT candidate, rung, fold, min(cost) AS cost FROM (
            SELECT candidate, rung, fold, t, sum(CASE WHEN y = 1 AND p < t THEN 10 WHEN y = 0 AND p >= t THEN 1 ELSE 0 END) AS cost
            FROM scored, (VALUES {grid}) g(t) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""").fetchall()
    assert {(c, r): v for c, r, v in costs} == {(t.candidate, t.rung): t.cost for t in trials}
    best = [t for t in trials if t.state == "best"][0]
    assert best.cost == min(t.cost for t in trials if t.rung == 2)
