"""Hash-based samples and splits: sizes, balance, complements."""

from pyspark.sql import functions as F

from ledgerlens.operators import sampling as S


def _labelled(spark, n=1000):
    return spark.createDataFrame([(i, 1 if i % 5 == 0 else 0) for i in range(n)], "id long, y int")


def test_sample_n_is_deterministic(spark):
    df = _labelled(spark)
    a = sorted(r.id for r in S.sample_n(df, 100, "id").collect())
    b = sorted(r.id for r in S.sample_n(df, 100, "id").collect())
    assert len(a) == 100 and a == b


def test_halves_partition_the_rows(spark):
    df = _labelled(spark)
    first, rest = S.halves(df, "id")
    f, r = {x.id for x in first.collect()}, {x.id for x in rest.collect()}
    assert not (f & r) and len(f | r) == 1000 and 400 < len(f) < 600


def test_stratified_folds_are_balanced(spark):
    folds = S.stratified_folds(_labelled(spark), "y", "id", 3)
    counts = {(r.y, r.fold): r.n for r in folds.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    for y in (0, 1):
        sizes = [counts[(y, k)] for k in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_stratified_sample_keeps_shares(spark):
    s = S.stratified_sample(_labelled(spark), "y", "id", 300)
    got = {r.y: r.n for r in s.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {0: 240, 1: 60}


def test_holdout_share(spark):
    h = S.holdout(_labelled(spark), "id", 0.85)
    got = {r.part: r.n for r in h.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"train": 850, "valid": 150}
