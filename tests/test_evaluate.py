"""Golden vectors of the evaluation operators (hand-computable)."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import evaluate as E

Y = [1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
P = [.9, .2, .05, .3, .15, .08, .02, .01, .5, .04]


@pytest.fixture
def scores(spark):
    return spark.createDataFrame(list(zip(range(10), Y, P)), "id long, y int, p double")


def test_confusion_metrics_at_010(scores):
    m = E.metrics_at_threshold(scores, 0.10).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 3, 1, 4)
    assert m.accuracy == pytest.approx(0.6) and m.precision == pytest.approx(0.4)
    assert m.recall == pytest.approx(2 / 3) and m.f1 == pytest.approx(0.5)
    assert m.refusal_rate == pytest.approx(0.5) and m.cost == 13


def test_cost_at_050_and_zero_denominators(scores):
    assert E.business_cost(scores, 0.5).first().cost == 21
    m = E.metrics_at_threshold(scores, 0.99).first()
    assert (m.precision, m.recall, m.f1, m.refusal_rate) == (0.0, 0.0, 0.0, 0.0)


def test_rank_auc(scores, spark):
    assert E.auc_rank(scores).first().auc == pytest.approx(15 / 21)
    tie = spark.createDataFrame([(1, .3), (0, .3)], "y int, p double")
    assert E.auc_rank(tie).first().auc == pytest.approx(0.5)


def test_threshold_sweep_matches_direct_counts(scores):
    sweep = {r.threshold: r for r in E.threshold_sweep(scores).collect()}
    for t in (0.05, 0.1, 0.15, 0.5, 0.95):
        direct = E.business_cost(scores, t).first()
        assert sweep[t].cost == direct.cost and sweep[t].fn == direct.fn
    best = E.best_threshold(E.threshold_sweep(scores)).first()
    assert best.cost == min(r.cost for r in sweep.values())


def test_compare_scores(spark):
    a = spark.createDataFrame([(1, .10), (2, .50), (3, .09)], "id long, p double")
    b = spark.createDataFrame([(1, .10), (2, .5001), (3, .11)], "id long, q double")
    r = E.compare_scores(a, b, "id", "p", "q").first()
    assert r.max_gap == pytest.approx(0.02) and r.n_gap_above_tol == 1 and r.decision_flips == 1


def test_auc_grouped_uses_each_group(spark):
    rows = [(g, y, p) for g in ("a", "b") for y, p in zip(Y, P)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r.g: r.auc for r in E.auc_rank(df, group_cols=["g"]).collect()}
    assert got["a"] == pytest.approx(15 / 21) and got["b"] == pytest.approx(15 / 21)
    assert F is not None


def test_rows_without_a_score_count_nowhere(spark):
    from ledgerlens.operators import evaluate as E
    rows = [(1, 0.9), (0, 0.1), (1, None), (0, float("nan")), (None, 0.5)]
    df = spark.createDataFrame(rows, "y int, p double")
    m = E.metrics_at_threshold(df, 0.5).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (1, 0, 0, 1)
    a = E.auc_rank(df).first()
    assert (a.auc, a.n_pos, a.n_neg) == (1.0, 1, 1)


def test_auc_of_more_pairs_than_a_bigint_holds(spark):
    from pyspark.sql import functions as F
    from ledgerlens.operators import evaluate as E
    sizes = spark.createDataFrame([(4_000_000_000, 4_000_000_000)], "n_pos bigint, n_neg bigint")
    assert sizes.select(E.pairs(F.col("n_pos"), F.col("n_neg"))).first()[0] == 1.6e19
