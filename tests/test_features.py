"""Feature builders on the smoke data: catalogue, key uniqueness, schema rules."""

import pytest

from ledgerlens.operators.encode import fit_catalogue
from ledgerlens.plans import features as FT
from ledgerlens.plans.feature_queries import build_feature_table
from ledgerlens.sources import roles


def test_catalogue_matches_data(spark, smoke_dir):
    b = roles.bureau(spark, smoke_dir)
    fitted = fit_catalogue(b, list(FT.CATALOGUE["bureau"]))
    for col, values in fitted.items():
        assert set(values) <= set(FT.CATALOGUE["bureau"][col])


def test_feature_table_one_row_per_application(spark, smoke_dir):
    ft = build_feature_table(spark, smoke_dir)
    app = roles.application(spark, smoke_dir).filter("CODE_GENDER IS DISTINCT FROM 'XNA'")
    assert ft.count() == app.count() == ft.select("SK_ID_CURR").distinct().count()
    assert all(" " not in c and "," not in c and ":" not in c for c in ft.columns)


def test_family_sizes():
    sizes = FT.feature_family_sizes()
    assert sizes["ACTIVE_"] == sizes["CLOSED_"] == 27 and sizes["APPROVED_"] == sizes["REFUSED_"] == 30


def test_sanitise_rejects_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "`a b` int, `a_b` int")
    with pytest.raises(ValueError):
        FT.sanitise_columns(df)
