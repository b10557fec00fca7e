"""Strict payload types, verdicts and the full prediction record."""

import math

from pyspark.sql import functions as F

from ledgerlens.operators import contract as C
from ledgerlens.operators import payload as P
from ledgerlens.operators import trees as T

NAMES = ["AMT_CREDIT", "DAYS_BIRTH", "FLAG_OWN_CAR", "BURO_A"]


def requests(spark, payloads):
    rows = [(f"r{k}", 0, p) for k, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "request_id string, position int, payload string")


def test_every_kind(spark):
    texts = ['{"AMT_CREDIT": 1, "DAYS_BIRTH": -2.5, "FLAG_OWN_CAR": null}', '{"AMT_CREDIT": "0.5"}', '{"AMT_CREDIT": true}',
             '{"AMT_CREDIT": [1]}', '{"AMT_CREDIT": {"a": 1}}', '{"AMT_CREDIT": 1e999}', '{"AMT_CREDIT": NaN}', '{"AMT_CREDIT": 1, "AMT_CREDIT": 2}',
             "not json", None, "", "[1]", "{}", '{"AMT_CREDIT": 123456789012345678901234567890}']
    rows = P.typed_entries(requests(spark, texts)).collect()
    got = {}
    for r in rows:
        got.setdefault(int(r.request_id[1:]), {})[r.name] = (r.kind, r.value)
    assert got[0] == {"AMT_CREDIT": ("number", 1.0), "DAYS_BIRTH": ("number", -2.5), "FLAG_OWN_CAR": ("null", None)}
    assert [got[k]["AMT_CREDIT"] for k in (1, 2, 3, 4)] == [("string", None), ("boolean", None), ("array", None), ("object", None)]
    assert got[5]["AMT_CREDIT"] == ("number", math.inf) and got[13]["AMT_CREDIT"][1] == 1.2345678901234568e29
    assert all(got[k] == {None: ("unreadable", None)} for k in (6, 7, 8, 9, 10, 11)) and got[12] == {None: ("null", None)}


def test_verdicts_and_messages(spark):
    texts = ['{"AMT_CREDIT": "x", "OTHER": true, "DAYS_BIRTH": 5}', '{"AMT_CREDIT": 1e999, "OTHER": 1}', '{"OTHER": 1, "DAYS_BIRTH": 5}',
             '{"DAYS_BIRTH": 5}', '{"DAYS_BIRTH": -5}', '{"DAYS_BIRTH": -5, "AMT_CREDIT": 3}', "nothing", "{}"]
    got = {r.request_id: r for r in P.payload_verdicts(requests(spark, texts), C.contract_table(spark, NAMES), ("payload",)).collect()}
    assert [got[f"r{k}"].reject_reason for k in range(8)] == [
        "type", "non_finite", "unknown", "range", "coverage", None, "unreadable", "coverage"]
    assert got["r0"].message == "2 value(s) not a number or null: AMT_CREDIT is string; OTHER is boolean"
    assert all(got[f"r{k}"].payload == t for k, t in enumerate(texts))


def test_prediction_records(spark):
    nodes = [(0, 0, "AMT_CREDIT", 10.0, 1, 2, None, 1.0), (0, 1, None, None, None, None, 1.0, None), (0, 2, None, None, None, None, -1.0, None)]
    rows = [("one", 0, '{"AMT_CREDIT": 5, "DAYS_BIRTH": -1}'), ("two", 0, '{"AMT_CREDIT": 50, "DAYS_BIRTH": -1, "BURO_A": 2}'),
            ("two", 1, '{"DAYS_BIRTH": -1,   "FLAG_OWN_CAR": 1}'), ("bad", 0, '{"AMT_CREDIT": 5, "DAYS_BIRTH": -1}'), ("bad", 1, "{}")]
    df = spark.createDataFrame(rows, "request_id string, position int, payload string").withColumns({
        "occurred_at": F.lit("2024-05-01 10:00:00").cast("timestamp_ntz"), "endpoint": F.lit("/predict/batch"), "duration_ms": F.lit(30.0)})
    out = P.prediction_records(df, C.contract_table(spark, NAMES), T.Forest.of(spark.createDataFrame(nodes, T.NODES)), "v9", 0.5)
    got = {(r.request_id, r.position): r for r in out.collect()}
    assert set(got) == {("one", 0), ("two", 0), ("two", 1)}
    r = got["two", 1]
    assert r.features == '{"DAYS_BIRTH": -1,   "FLAG_OWN_CAR": 1}' and r.latency_ms == 15.0 and r.model_version == "v9"
    assert (r.features_provided, r.features_missing, r.application_ratio, r.history_ratio) == (2, 2, 2 / 3, 0.0)
    assert got["one", 0].probability == 1 / (1 + math.exp(-2)) and got["one", 0].decision == "rejected"
    assert got["two", 1].probability == 1 / (1 + math.exp(2)) and got["two", 1].decision == "accepted"     # missing goes right
    # the score of a record equals that of the row of its values
    assert got["two", 0].history_ratio == 1.0 and got["one", 0].latency_ms == 30.0


def test_texts_do_not_go_with_the_entries(spark):
    """The reason depends on counts: no list of entries and no payload passes the aggregate of the entries."""
    out = P.payload_verdicts(requests(spark, ['{"DAYS_BIRTH": 5}', "{}"]), C.contract_table(spark, NAMES), ("payload",))
    plan = out.select("request_id", "reject_reason", "payload")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    above = plan[:plan.index("Generate variant_explode")].splitlines()
    assert "payload" not in [line for line in above if "Aggregate" in line][-1]
    twice = requests(spark, ['{"AMT_CREDIT": 1, "DAYS_BIRTH": -1}']).unionByName(requests(spark, ['{"AMT_CREDIT": 1, "DAYS_BIRTH": -1}']))
    twice = twice.unionByName(twice.withColumn("request_id", F.lit(None).cast("string")))
    rows = P.payload_verdicts(twice, C.contract_table(spark, NAMES), ("payload",)).collect()
    assert sorted((str(r.request_id), r.payload) for r in rows) == [(k, '{"AMT_CREDIT": 1, "DAYS_BIRTH": -1}') for k in ("None", "r0")]
