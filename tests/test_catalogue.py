"""The stored catalogue of categories: versions, fixed schema, unseen values."""

import pytest

from ledgerlens.operators.catalogue import read_catalogue, store_catalogue, unseen_categories
from ledgerlens.operators.encode import one_hot

SCHEMA = "id int, colour string, `odd name` string, n int"
EARLY = [(1, "red", "a", 1), (2, "blue", None, 2), (3, "red", "", 3), (4, None, None, 4)]
LATER = [(5, "green", "a", 1), (6, "green", "b", 1), (7, "amber", None, 2), (8, None, "", 3), (9, "red", "c", 4)]


def _stored(spark, tmp_path, rows=EARLY):
    early = spark.createDataFrame(rows, SCHEMA)
    store_catalogue(spark, {"t": (early, ["colour", "odd name"]), "u": (early, ["colour"])}, str(tmp_path / "c"), "v1")
    return read_catalogue(spark, str(tmp_path / "c"), "v1")


def test_round_trip_and_versions(spark, tmp_path):
    found = _stored(spark, tmp_path)
    assert found == {"t": {"colour": ["blue", "red"], "odd name": ["", "a"]}, "u": {"colour": ["blue", "red"]}}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        _stored(spark, tmp_path, LATER)
    assert read_catalogue(spark, str(tmp_path / "c"), "v1") == found
    with pytest.raises(ValueError, match="v2"):
        read_catalogue(spark, str(tmp_path / "c"), "v2")


def test_a_new_category_is_reported_and_the_schema_stays(spark, tmp_path):
    catalogue = _stored(spark, tmp_path)["t"]
    later = spark.createDataFrame(LATER, SCHEMA)
    got = {r["column"]: tuple(r)[1:] for r in unseen_categories(later, catalogue).collect()}
    assert got == {"colour": (5, 1, 3, 2, "amber"), "odd name": (5, 1, 2, 2, "b")}
    before, after = (one_hot(df, catalogue)[0] for df in (spark.createDataFrame(EARLY, SCHEMA), later))
    assert before.columns == after.columns
    assert [tuple(r) for r in after.select("colour_blue", "colour_red", "colour_nan").orderBy("id").collect()] == [
        (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 1), (0, 1, 0)]


def test_columns_without_values_and_empty_tables(spark, tmp_path):
    catalogue = _stored(spark, tmp_path, [(1, None, None, 1)])["t"]
    assert catalogue == {"colour": [], "odd name": []}
    got = {r["column"]: tuple(r)[1:] for r in unseen_categories(spark.createDataFrame(LATER, SCHEMA), catalogue).collect()}
    assert got == {"colour": (5, 1, 4, 3, "amber"), "odd name": (5, 1, 4, 4, "")}
    none = unseen_categories(spark.createDataFrame([], SCHEMA), catalogue).collect()
    assert sorted(tuple(r) for r in none) == [("colour", 0, 0, 0, 0, None), ("odd name", 0, 0, 0, 0, None)]


def test_stored_and_literal_catalogue_give_the_same_features(spark, smoke_dir, tmp_path):
    from ledgerlens.plans import features as FT
    from ledgerlens.sources import roles
    prev = roles.previous_application(spark, smoke_dir)
    columns = list(FT.CATALOGUE["previous_application"])
    store_catalogue(spark, {"previous_application": (prev, columns)}, str(tmp_path / "c"), "v1")
    fitted = FT.previous_features(prev, read_catalogue(spark, str(tmp_path / "c"), "v1"))
    literal = FT.previous_features(prev)
    assert fitted.columns == literal.columns and fitted.count() == literal.count()
