"""Contract rules, record validation and the batch gate."""

from ledgerlens.operators import contract as C

NAMES = ["EXT_SOURCE_2", "AMT_CREDIT", "CNT_CHILDREN", "FLAG_OWN_CAR", "DAYS_BIRTH", "DAYS_EMPLOYED_PERC",
         "BURO_DAYS_CREDIT_MEAN", "POS_COUNT"]


def _records(spark, rows):
    return spark.createDataFrame(rows, "request_id string, position int, features map<string,double>")


def test_contract_rules(spark):
    c = {r.name: r for r in C.contract_table(spark, NAMES).collect()}
    assert c["EXT_SOURCE_2"].low == 0.0 and c["EXT_SOURCE_2"].high == 1.0
    assert c["DAYS_BIRTH"].low is None and c["DAYS_BIRTH"].high == 0.0
    assert c["DAYS_EMPLOYED_PERC"].reason is None
    assert c["BURO_DAYS_CREDIT_MEAN"].origin == "history" and c["AMT_CREDIT"].origin == "application"


def test_out_of_range_flags(spark):
    contract = C.contract_table(spark, NAMES)
    rows = [("r", i, {name: value}) for i, (name, value) in enumerate([
        ("EXT_SOURCE_2", 1.5), ("EXT_SOURCE_2", -0.1), ("AMT_CREDIT", -1.0), ("CNT_CHILDREN", -3.0),
        ("FLAG_OWN_CAR", 2.0), ("DAYS_BIRTH", 100.0), ("DAYS_EMPLOYED_PERC", 0.67)])]
    got = {r.position: r.problems for r in C.out_of_range(C.entries(_records(spark, rows)), contract).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5}
    assert got[0] == ["EXT_SOURCE_2=1.5 (normalised external score, expected between 0 and 1)"]


def test_unknown_coverage_and_verdict(spark):
    contract = C.contract_table(spark, NAMES)
    recs = _records(spark, [
        ("a", 0, {"ZZZ": 1.0, "AAA": None, "AMT_CREDIT": 5.0}),
        ("a", 1, {"AMT_CREDIT": 5.0, "DAYS_BIRTH": -10.0, "EXT_SOURCE_2": 0.5, "FLAG_OWN_CAR": 1.0,
                  "CNT_CHILDREN": None, "POS_COUNT": 3.0}),
        ("b", 0, {"AMT_CREDIT": 5.0}),
    ])
    v = {(r.request_id, r.position): r for r in C.validate(recs, contract).collect()}
    assert v[("a", 0)].reject_reason == "unknown" and v[("a", 0)].message == "2 unknown feature(s): AAA, ZZZ"
    assert v[("a", 1)].reject_reason is None
    assert v[("a", 1)].provided == 5 and v[("a", 1)].application_ratio == 4 / 6 and v[("a", 1)].history_ratio == 0.5
    assert v[("b", 0)].reject_reason == "coverage"
    assert v[("b", 0)].message.startswith("application coverage 16.7%, at least ")
    batches = {r.request_id: r for r in C.validate_batches(C.validate(recs, contract)).collect()}
    assert batches["a"].status == "rejected" and batches["a"].first_invalid_position == 0
    assert batches["a"].first_reason == "unknown" and batches["b"].n_items == 1


def test_range_message_counts_and_separates_problems(spark):
    recs = _records(spark, [("r", 0, {"AMT_CREDIT": -1.0, "CNT_CHILDREN": -3.0, "EXT_SOURCE_2": 0.5})])
    message = C.validate(recs, C.contract_table(spark, NAMES)).first().message
    assert message.startswith("2 value(s) out of range: AMT_CREDIT=-1.0 (") and "; CNT_CHILDREN=-3.0 (" in message


def test_bounded_list(spark):
    df = spark.createDataFrame([([f"n{i:02d}" for i in range(13)],)], "names array<string>")
    assert df.select(C.bounded_list(df.names)).first()[0].endswith("n09 (+3 others)")
