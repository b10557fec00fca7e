"""Sources and sinks: CSV with a first-N slice, JSON profile round trip, first row as a record, ids."""

from pyspark.sql import functions as F

from ledgerlens.session import shared_path
from ledgerlens.sources.files import first_record, with_request_ids
from ledgerlens.sources.tables import forget_schemas, scan


def test_csv_scan_first_n(spark, smoke_dir, tmp_path):
    path = str(tmp_path / "customer_csv")
    scan(spark, smoke_dir, "customer").write.mode("overwrite").option("header", True).csv(path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    df = spark.read.schema(schema).option("header", True).csv(path)
    first = df.orderBy("c_custkey").limit(10)
    assert [r.c_custkey for r in first.collect()] == list(range(10))


def test_json_profile_round_trip(spark, tmp_path):
    schema = "feature string, bounds array<double>, proportions array<double>, missing double, importance double"
    prof = spark.createDataFrame([("k", [1.0, 2.0], [0.25, 0.5, 0.25], 0.0, 0.1)], schema)
    path = str(tmp_path / "profile")
    prof.write.mode("overwrite").json(path)
    assert spark.read.schema(schema).json(path).collect() == prof.collect()


def test_first_record_has_none_for_null_and_nan(spark):
    df = spark.createDataFrame([(2, None, float("nan")), (1, float("nan"), 0.5)], "a int, `b c` double, d double")
    assert first_record(df.orderBy("a")) == {"a": 1, "b c": None, "d": 0.5}
    assert first_record(df.orderBy(F.desc("a"))) == {"a": 2, "b c": None, "d": None}
    assert first_record(df.filter("a > 2")) is None


def test_uuid_per_request(spark):
    ids = [r.request_id for r in with_request_ids(spark.range(100)).collect()]
    assert len(set(ids)) == 100 and all(len(i) == 36 for i in ids)


def test_shared_path_is_under_checkpoint_dir(spark):
    assert shared_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))


def test_small_result_and_profile_files(spark):
    import pytest

    from ledgerlens.operators import drift as D
    from ledgerlens.session import shared_path
    from ledgerlens.sources import files
    rows = [("a,b", None, 1.5), ("", "x\"y", None)]
    df = spark.createDataFrame(rows, "name string, note string, value double")
    path = shared_path(spark, "small-csv")
    files.write_csv(df, path)
    got = files.read_csv(spark, path, "name string, note string, value double").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)
    with pytest.raises(Exception):
        files.read_csv(spark, path, "other string, note string, value double").collect()
    obs = spark.createDataFrame([(i, "f", float(i)) for i in range(40)], "id int, feature string, value double")
    profile = D.reference_profile(obs)
    path = shared_path(spark, "profile-json")
    files.write_profile(profile, path)
    assert files.read_profile(spark, path).collect() == profile.collect()


def test_scratch_tables_are_deleted(spark):
    import os

    from ledgerlens.session import materialised, scratch_tables
    base = spark.conf.get("spark.checkpoint.dir")
    with scratch_tables(spark):
        gone = materialised(spark.range(3), "gone-test")
        kept = materialised(gone.filter("id > 0"), "kept-test", scratch=False)
    names = os.listdir(base)
    assert not any(n.startswith("gone-test") for n in names) and kept.count() == 2


def test_a_second_scan_builds_its_plan_without_a_job(spark, smoke_dir):
    forget_schemas()
    first = scan(spark, smoke_dir, "orders")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("second-scan", "second scan")
    second = scan(spark, smoke_dir, "orders", ["o_orderkey"])
    assert not tracker.getJobIdsForGroup("second-scan")
    assert second.schema == first.select("o_orderkey").schema
    forget_schemas()
    scan(spark, smoke_dir, "orders")
    assert tracker.getJobIdsForGroup("second-scan")          # the footer is read again
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert scan(spark, smoke_dir, "orders").collect() == first.collect()
