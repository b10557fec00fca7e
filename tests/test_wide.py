"""Wide feature aggregates and the queries on the feature table: what is shuffled, and how often the table is built."""

import hashlib
import os
import re
import statistics

from pyspark.sql import functions as F

from ledgerlens.operators import ml as M
from ledgerlens.operators import search
from ledgerlens.plans import features as FT
from ledgerlens.plans import ml_queries, quality_queries


def order_key(i):
    """The hash key of an id; a missing id comes first."""
    return -1 if i is None else int(hashlib.md5(f"42{i}".encode()).hexdigest()[:15], 16)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_shuffled_and_not_the_buffers_of_the_statistics(spark):
    card = spark.createDataFrame([(1, 10, 1.5, "A"), (1, 11, 2.5, None), (None, 12, 4.0, "N"), (2, 10, None, "A")],
                                 "SK_ID_PREV int, SK_ID_CURR int, AMT_BALANCE double, NAME_CONTRACT_STATUS string")
    card = card.withColumn("SK_ID_CURR", F.when(F.col("SK_ID_CURR") != 12, F.col("SK_ID_CURR")))
    out = FT.card_features(card)
    plan = physical(out)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("REPARTITION_BY_COL") == 1
    got = {r.SK_ID_CURR: r for r in out.collect()}
    assert set(got) == {10, 11, None} and got[10].CC_COUNT == 2 and got[10].CC_AMT_BALANCE_MEAN == 1.5
    assert got[10].CC_NAME_CONTRACT_STATUS_A_SUM == 2.0 and got[11].CC_NAME_CONTRACT_STATUS_nan_MEAN == 1.0


def test_gaps_are_written_once(spark, monkeypatch):
    rows = [(k, None if k % 2 else 1.0, None if k % 3 else 2.0, 5.0) for k in range(12)]
    table = spark.createDataFrame(rows, "SK_ID_CURR int, a double, b double, c double")
    monkeypatch.setattr(quality_queries, "build_feature_table", lambda spark, d: table)
    out = quality_queries.missing_correlation(spark, "nowhere")
    assert out.inputFiles() and all("/gaps-" in f for f in out.inputFiles())
    assert [(r.col_a, r.col_b, r["corr"]) for r in out.collect()] == [("a", "b", 0.0)]


def test_score_batch_builds_the_features_once(spark, monkeypatch):
    rows = [(k, k % 2 if k < 16 else None, float(k), None if k % 5 == 0 else float(k % 2)) for k in range(20)]
    table = spark.createDataFrame(rows, "SK_ID_CURR int, TARGET int, a double, b double")
    monkeypatch.setattr(ml_queries, "build_feature_table", lambda spark, d: table)
    out = ml_queries.score_batch(spark, "nowhere")
    assert out.inputFiles() and all("/features-" in f for f in out.inputFiles())
    assert sorted(r.id for r in out.collect()) == list(range(20))


def test_medians_serve_several_fits(spark):
    rows = [(k, float(k % 2), 1.0, None if k % 5 == 0 else float(k % 7)) for k in range(20)]
    train = spark.createDataFrame(rows, f"id int, {M.LABEL} double, {M.WEIGHT} double, a double")
    scores = lambda p: [r.p for r in M.positive_probability(p.fit(train).transform(train)).orderBy("id").collect()]
    medians = M.imputer(["a"]).fit(train)
    assert scores(M.pipeline(["a"], M.logistic(), True, ["a"], medians)) == scores(M.pipeline(["a"], M.logistic(), True, ["a"]))


def test_medians_of_many_columns_are_not_sorted(spark):
    """above this many columns at once Spark sorts and spills every value."""
    limit = int(spark.conf.get("spark.sql.objectHashAggregate.sortBased.fallbackThreshold"))
    names = [f"c{i}" for i in range(limit + 10)]
    rows = [(k, *[None if k == 3 else float("nan") if k == 4 else float(k * (i + 1)) for i in range(len(names))]) for k in range(6)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in names))
    model = M.imputer(names).fit(df)
    assert all(len(stage.getInputCols()) <= limit for stage in getattr(model, "stages", [model]))
    got = {r.id: r for r in model.transform(df).collect()}
    assert [got[3][f"{c}__imp"] for c in names] == [float(i + 1) for i in range(len(names))]        # of 0, 1, 2 and 5 times i + 1
    assert [got[4][f"{c}__imp"] for c in names] == [got[3][f"{c}__imp"] for c in names]
    assert [got[5][f"{c}__imp"] for c in names] == [5.0 * (i + 1) for i in range(len(names))]


def test_stored_features_are_not_written_again(spark, monkeypatch):
    """F2: score_batch has written the features itself; the training table writes only its weighted, dealt rows."""
    calls = []
    keep = M.checkpointed
    monkeypatch.setattr(M, "checkpointed", lambda df: calls.append(df.columns) or keep(df))
    rows = [(k, k % 2 if k < 16 else None, float(k), None if k % 5 == 0 else float(k % 2)) for k in range(20)]
    table = spark.createDataFrame(rows, "SK_ID_CURR int, TARGET int, a double, b double")
    monkeypatch.setattr(ml_queries, "build_feature_table", lambda spark, d: table)
    assert ml_queries.score_batch(spark, "nowhere").count() == 20
    assert len(calls) == 1 and "fold" in calls[0]


def test_gaps_of_all_columns_are_correlated(spark, monkeypatch):
    """every pair of columns with some gaps, not only of the 30 most missing; words of 64 flags, partitions that end inside one."""
    names, n = [f"c{i:02d}" for i in range(34)], 150
    gap = lambda k, i: (k * (i + 3) + i) % 37 < 5 + i % 9 if i < 32 else k < 70 if i == 32 else k >= 70
    rows = [(k // 2, *[None if gap(k, i) else 1.0 for i in range(34)], 1.0, None) for k in range(n)]
    table = spark.createDataFrame(rows, "SK_ID_CURR int, " + ", ".join(f"{c} double" for c in names) + ", whole double, empty double")
    monkeypatch.setattr(quality_queries, "build_feature_table", lambda spark, d: table.repartition(3))
    got = {(r.col_a, r.col_b): r["corr"] for r in quality_queries.missing_correlation(spark, "nowhere").collect()}
    assert set(got) == {(a, b) for a in names for b in names if a < b}
    for (a, b), corr in got.items():
        x, y = ([float(gap(k, int(c[1:]))) for k in range(n)] for c in (a, b))
        assert abs(corr - statistics.correlation(x, y)) < 1e-6
    assert got["c32", "c33"] == -1.0


def test_gaps_of_one_column_have_no_pair(spark, monkeypatch):
    table = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "SK_ID_CURR int, a double, b double")
    monkeypatch.setattr(quality_queries, "build_feature_table", lambda spark, d: table)
    assert quality_queries.missing_correlation(spark, "nowhere").count() == 0


def test_training_rows_are_written_and_shuffled_once(spark, monkeypatch):
    """weights and folds come from keys and labels; only one copy of the features is written."""
    wide = []
    keep = M.checkpointed
    monkeypatch.setattr(M, "checkpointed", lambda df: wide.append(df) or keep(df))
    rows = [(k // 4 if k > 2 else None, None if k % 7 == 3 else k % 2, float(k), None if k % 5 == 0 else float(k % 2)) for k in range(40)]
    table = spark.createDataFrame(rows, "SK_ID_CURR int, TARGET int, a double, b double")
    folder = spark.conf.get("spark.checkpoint.dir")
    there = set(os.listdir(folder))
    train, cols = M.training_table(table, "SK_ID_CURR", "TARGET")
    assert cols == ["a", "b"] and len(wide) == 1
    plan = physical(wide[0])
    assert "rangepartitioning" not in plan and len(set(re.findall(r"Exchange hashpartitioning\(.*_range#", plan))) == 1
    tables = [t for t in set(os.listdir(folder)) - there if any(f.endswith(".parquet") for f in os.listdir(f"{folder}/{t}"))]
    assert tables and not any("a" in spark.read.parquet(f"{folder}/{t}").columns for t in tables)
    got = sorted((r.label, order_key(r.id), r.a, r.fold, r.weight) for r in train.collect())
    want = []
    for y in (0, 1):
        some = sorted((order_key(i), a) for i, t, a, _ in rows if t == y)
        want += [(float(y), h, a, n % 3, 34 / 2 / len(some)) for n, (h, a) in enumerate(some)]
    assert [(y, h, w) for y, h, _, _, w in got] == [(y, h, w) for y, h, _, _, w in want]
    assert sorted((y, h, f) for y, h, _, f, _ in got) == sorted((y, h, f) for y, h, _, f, _ in want)


def _train_rows(spark):
    rows = [(k, float(k % 2), 1.0, k // 2 % 3, float(k % 5), None if k % 4 == 0 else float(k % 2 + k % 3)) for k in range(60)]
    return spark.createDataFrame(rows, f"id int, {M.LABEL} double, {M.WEIGHT} double, fold int, a double, b double")


def test_searches_write_no_vectors(spark, monkeypatch):
    """the vectors of a fold are assembled from the checkpointed rows in each pass, not written for each fold."""
    train = _train_rows(spark)

    def refuse(*_, **__):
        raise AssertionError("a copy of the features is written")

    monkeypatch.setattr(type(train), "checkpoint", refuse)
    found = M.param_search(train, ["a", "b"], (0.01, 10.0)).collect()
    assert [r.reg_param for r in found] == [0.01, 10.0] and sum(r.best for r in found) == 1
    space = [dict(depth=2, step=0.1, rows=1.0, least=1), dict(depth=2, step=0.3, rows=1.0, least=5)]
    trials, scores = search.halving_search(train, ["a", "b"], space, [(1, 1), (2, 3)])
    assert sorted((r.rung, r.state) for r in trials.collect()) == [(1, "dropped"), (1, "kept"), (2, "best")]
    assert scores.filter("rung = 2").count() == 60 and "features" not in scores.columns


def test_trees_are_grown_on_a_few_partitions_for_each_core(spark, monkeypatch):
    """what the levels of the trees shuffle grows with the partitions, so these do not grow with the rows."""
    most = search.PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism
    train, seen = _train_rows(spark).repartition(most + 5), []
    grown = M.boosted

    def boosted(**params):
        model = grown(**params)
        fit = model.fit
        monkeypatch.setattr(model, "fit", lambda rows: seen.append(rows.rdd.getNumPartitions()) or fit(rows))
        return model

    monkeypatch.setattr(M, "boosted", boosted)
    _, scores = search.halving_search(train, ["a", "b"], [dict(depth=2, step=0.1, rows=1.0, least=1)], [(1, 1)])
    assert seen == [most] and scores.count() == 20
