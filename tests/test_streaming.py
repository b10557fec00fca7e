"""Streaming jobs on small files: de-duplication and closed windows."""

import json

from pyspark.sql import functions as F

from ledgerlens.streaming import streams as S


def _write(path, rows):
    path.mkdir(parents=True, exist_ok=True)
    with open(path / "part-0.json", "w") as fh:
        for r in rows:
            fh.write(json.dumps(r) + "\n")


def test_ingest_drops_duplicates(spark, tmp_path):
    base = {"id": 1, "request_id": "r1", "position": 0, "occurred_at": "2024-01-01T00:00:00.000000",
            "endpoint": "/predict", "model_version": "v1", "threshold": 0.1, "probability": 0.2, "decision": "rejected",
            "features_provided": 1, "features_missing": 2, "application_ratio": 0.5, "history_ratio": 0.1,
            "latency_ms": 1.0, "features": "{}"}
    other = dict(base, id=2, request_id="r2", occurred_at="2024-01-01T01:00:00.000000")
    _write(tmp_path / "in", [base, base, other, dict(other)])
    stream = S.read_json_stream(spark, str(tmp_path / "in"), S.PREDICTION_SCHEMA)
    S.run_to_parquet(S.ingest_predictions(stream), str(tmp_path / "out"), str(tmp_path / "ck"), ["dt"])
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.request_id for r in out.collect()) == ["r1", "r2"]


def test_closed_windows_only(spark, tmp_path):
    rows = [{"id": i, "request_id": f"r{i}", "occurred_at": f"2024-01-01T{h:02d}:30:00.000000", "method": "POST",
             "path": "/predict", "status_code": 200, "duration_ms": 1.0} for i, h in enumerate([0, 0, 1, 5])]
    _write(tmp_path / "in", rows)
    stream = S.read_json_stream(spark, str(tmp_path / "in"), S.REQUEST_SCHEMA)
    S.run_to_parquet(S.request_series(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    out = spark.read.parquet(str(tmp_path / "out")).select(F.hour("window_start").alias("h"), "calls").collect()
    # watermark = 05:30 - 1 hour: the 05:00 window is still open and not emitted
    assert sorted((r.h, r.calls) for r in out) == [(0, 2), (1, 1)]


def test_escalation_of_closed_days(spark, tmp_path):
    """Days with gaps, a feature without values on a day, and enough rows to move the rate, against a plain computation."""
    from datetime import datetime, timedelta
    import math
    import random
    from ledgerlens.operators.drift import EPSILON
    rnd = random.Random(3)
    start = datetime(2024, 1, 1)
    rows, plain = [], {}
    for day in [0, 1, 2, 4, 5, 6, 7, 8, 9, 17, 18, 20, 21]:
        for i in range(30):
            at = start + timedelta(days=day, minutes=rnd.randrange(1440))
            ratio = None if day == 5 else rnd.random() * (0.3 if day == 8 else 1.0)
            rows.append({"id": len(rows), "request_id": f"r{len(rows)}", "occurred_at": at.strftime("%Y-%m-%dT%H:%M:%S.000000"),
                         "decision": "rejected" if rnd.random() < (0.8 if day in (6, 18) else 0.4) else "accepted",
                         "application_ratio": ratio, "latency_ms": rnd.random() * (0.2 if day in (2, 8) else 1.0)})
            plain.setdefault(day, []).append(rows[-1])
    bounds, shares = [0.25, 0.5, 0.75], [0.25] * 4
    for part in range(3):
        _write(tmp_path / "in" / str(part), rows[part::3])
    profile = spark.createDataFrame([(f, bounds, shares) for f in ("application_ratio", "latency_ms")],
                                    "feature string, bounds array<double>, proportions array<double>")
    stream = S.read_json_stream(spark, str(tmp_path / "in" / "*"), S.PREDICTION_SCHEMA)
    features = {f: F.col(f) for f in ("application_ratio", "latency_ms", "history_ratio")}      # one without a profile
    S.run_to_parquet(S.escalation_stream(stream, features, profile), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.day.date() - start.date()).days: (r.n_significant, r.refusal_rate, r.trailing_rate, r.refusal_alert, r.alert)
           for r in spark.read.parquet(str(tmp_path / "out")).withColumn("day", F.col("day").cast("timestamp_ntz")).collect()}

    rates = {d: sum(r["decision"] == "rejected" for r in day) / len(day) for d, day in plain.items()}
    want = {}
    for d, day in plain.items():
        if d >= 20:                                     # open: the watermark is a day behind the last row
            continue
        significant = 0
        for f in ("application_ratio", "latency_ms"):
            values = [r[f] for r in day if r[f] is not None]
            n = [sum(sum(b <= v for b in bounds) == c for v in values) for c in range(4)]
            p = [max(c / len(values) if values else 0.0, EPSILON) for c in n]
            significant += round(sum((x - 0.25) * math.log(x / 0.25) for x in p), 4) >= 0.25
        before = [rates[x] for x in range(d - 7, d) if x in rates]
        mean = sum(before) / len(before) if before else None
        gap = mean is not None and abs(rates[d] - mean) / mean > 0.2
        want[d] = (significant, rates[d], mean, gap, significant >= 2 or gap)
    assert set(got) == set(want)
    for d, w in want.items():
        assert got[d][0] == w[0] and got[d][3:] == w[3:] and abs(got[d][1] - w[1]) < 1e-12
        assert (got[d][2] is None) == (w[2] is None) and (w[2] is None or abs(got[d][2] - w[2]) < 1e-12)
    assert {w[4] for w in want.values()} == {True, False} and any(w[0] == 2 for w in want.values())
