"""Drift operators: class shares, PSI, bands, profile and seeded property checks."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import drift as D
from ledgerlens.operators.logs import Period, series_step


def _obs(spark, values, feature="f"):
    return spark.createDataFrame([(i, feature, v) for i, v in enumerate(values)], "id long, feature string, value double")


def test_class_shares_ignore_missing(spark):
    obs = _obs(spark, [None, 1.0, 2.0, 3.0, None])
    bounds = spark.createDataFrame([("f", [2.0])], "feature string, bounds array<double>")
    got = {r["class"]: r.share for r in D.class_shares(obs, bounds).collect()}
    assert got == {0: pytest.approx(1 / 3), 1: pytest.approx(2 / 3)}


def test_class_shares_of_empty_series(spark):
    obs = _obs(spark, [None])
    bounds = spark.createDataFrame([("f", [2.0])], "feature string, bounds array<double>")
    assert sorted(r.share for r in D.class_shares(obs, bounds).collect()) == [0.0, 0.0]


def test_psi_of_identical_distributions_is_zero(spark):
    obs = _obs(spark, [float(x) for x in range(100)])
    prof = D.reference_profile(obs)
    assert D.psi(obs, prof).first().psi == 0.0


def test_bands(spark):
    df = spark.createDataFrame([(0.05,), (0.10,), (0.2,), (0.25,)], "psi double")
    from ledgerlens.functions.columns import psi_band
    assert [r[0] for r in df.select(psi_band("psi")).collect()] == ["stable", "moderate", "moderate", "significant"]


def test_series_step_and_period():
    assert [series_step(timedelta(hours=1)), series_step(timedelta(days=1)), series_step(timedelta(days=7)),
            series_step(None)] == ["minute", "hour", "day", "day"]
    now = datetime(2024, 1, 31, tzinfo=timezone.utc)
    period = Period.between("2024-01-05T00:00:00", now)
    assert period.start.tzinfo is not None and period.end == now and period.step == "day"
    with pytest.raises(ValueError):
        Period.between("2024-01-05", "2024-01-01")


def test_seeded_properties(spark):
    rng = np.random.default_rng(42)
    ref = rng.normal(0, 1, 4000)
    same = rng.normal(0, 1, 4000)
    shifted = rng.normal(1.0, 1, 4000)
    ref_missing = [None if i % 4 == 0 else float(v) for i, v in enumerate(ref)]
    prof = D.reference_profile(_obs(spark, ref_missing))
    assert prof.first().missing == pytest.approx(0.25)
    assert D.psi(_obs(spark, [float(v) for v in same]), prof).first().band == "stable"
    assert D.psi(_obs(spark, [float(v) for v in shifted]), prof).first().band == "significant"


def test_absent_feature_still_gets_psi(spark):
    ref = _obs(spark, [float(x) for x in range(50)], "present")
    prof = D.reference_profile(ref)
    prod = _obs(spark, [1.0, 2.0], "other")
    row = D.drift_table(prod, prof).first()
    assert row.feature == "present" and row.psi > 0 and row.missing_production is None


def test_shifted_psi_equals_shifting_every_row(spark):
    import random
    rnd = random.Random(2)
    rows = [(k, f, None if rnd.random() < 0.1 else rnd.choice([rnd.random(), rnd.randrange(0, 21) / 20, -0.3, 1.4]))
            for k in range(400) for f in ("a", "b")]
    obs = spark.createDataFrame([*rows, (1, "empty", None)], "id int, feature string, value double")
    ref = spark.createDataFrame([(k, f, rnd.randrange(0, 21) / 20) for k in range(300) for f in ("a", "b", "empty")],
                                "id int, feature string, value double")
    profile = D.reference_profile(ref)
    shifts = [0.0, 0.05, 0.1, 0.3]
    got = {(r["shift"], r.feature): r.psi for r in D.shifted_psi(obs, profile, shifts, ["a"]).collect()}
    assert len(got) == 12
    for s in shifts:
        moved = obs.withColumn("value", F.when((F.col("feature") == "a") & F.col("value").isNotNull(), F.least(F.greatest(F.col("value") - s, F.lit(0.0)), F.lit(1.0)))
                               .otherwise(F.col("value")))
        want = {r.feature: r.psi for r in D.drift_table(moved, profile).collect()}
        assert {f: got[s, f] for f in ("a", "b", "empty")} == want


def test_only_the_cells_of_the_deciles_are_sorted(spark, monkeypatch):
    """the values that no decile can fall on are counted, not sorted."""
    from ledgerlens.operators import ordered as O
    sorted_rows = []
    bucketed = O.range_bucketed

    def watch(df, *args):
        out = bucketed(df, *args)
        sorted_rows.append(out.count())
        return out
    monkeypatch.setattr(O, "range_bucketed", watch)
    rng = np.random.default_rng(5)
    values = [float(v) for v in rng.normal(0, 1, 3000)]
    odd = [None, 0.0, -0.0, float("nan"), float("inf"), float("-inf"), 5e-324, -5e-324, 1.7e308, -1.7e308, 2.0, 2.0]
    rows = [("a", v) for v in values] + [("b", v) for v in odd] + [("c", None), (None, 1.0), (None, 2.0)]
    obs = spark.createDataFrame(rows, "feature string, value double")
    got = {r.feature: r.bounds for r in D.decile_bounds(obs).collect()}
    assert sum(sorted_rows) < 700
    assert got["a"] == pytest.approx(np.quantile(values, D.DECILES), abs=1e-12)
    want = O.percentile_cont(obs, "value", D.DECILES, ["feature"], prefix="q").collect()      # every value sorted
    want = {r.feature: sorted({r[f"q{round(q * 100)}"] for q in D.DECILES}) for r in want if r.feature != "b"}
    assert set(got) == {"a", "b", None} and {k: v for k, v in got.items() if k != "b"} == want
    ranks = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i.cast("bigint"))
    whole, cells = ({r["rank"]: str(r["value"]) for r in O.values_at_ranks(obs.filter("feature = 'b'"), "value", ranks, ["feature"], few).collect()}
                    for few in (False, True))
    assert cells == whole and len(cells) == 11


def test_cells_never_fall(spark):
    from ledgerlens.operators import ordered as O
    rng = np.random.default_rng(6)
    values = sorted([float(s * 10.0 ** e) for s, e in zip(rng.normal(0, 1, 2000), rng.uniform(-300, 300, 2000))]
                    + [1.0, float(np.nextafter(1.0, 2)), float(np.nextafter(1.0, 0)), 2.0, float(np.nextafter(2.0, 0)), 0.0])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    cells = [r.c for r in df.orderBy("i").select(O._cell(F.col("v")).alias("c")).collect()]
    assert cells == sorted(cells)


def test_classes_and_gaps_are_counted_in_one_pass(spark, monkeypatch):
    """shares and missing rates are made from one count of the observations, production and reference each."""
    passes = []
    counted = D.class_counts

    def watch(obs, *args):
        passes.append(obs)
        return counted(obs, *args)
    monkeypatch.setattr(D, "class_counts", watch)
    ref = spark.createDataFrame([("a", float(v)) for v in range(40)] + [("a", None)] * 10 + [("b", 1.0), ("b", float("nan"))],
                                "feature string, value double")
    prod = spark.createDataFrame([("a", 3.0), ("a", None), ("b", float("nan")), ("c", 1.0)], "feature string, value double")
    profile = D.reference_profile(ref)
    assert {r.feature: r.missing for r in profile.collect()} == {"a": 0.2, "b": 0.0}
    got = {r.feature: r for r in D.drift_table(prod, profile).collect()}
    assert len(passes) == 2 and set(got) == {"a", "b"}
    assert got["a"].missing_production == 0.5 and got["b"].missing_production == 0.0
    bounds = spark.createDataFrame([("a", [2.0, 3.0]), ("b", [float("nan")])], "feature string, bounds array<double>")
    classes = {(r.feature, r["class"]): r["_cnt"] for r in counted(prod, bounds).collect()}
    assert classes == {("a", 2): 1, ("a", None): 1, ("b", 1): 1}
