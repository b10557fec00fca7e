"""Registered streaming jobs: log ingestion with de-duplication, tumbling and
sliding event-time windows (closed windows only), and validated scoring of a
record stream into two sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.functions.rounding import round_sig, sql_round_dec, sql_round_sig, stable_doubles
from ledgerlens.operators import evaluate as E
from ledgerlens.operators import logs as L
from ledgerlens.operators import ml as M
from ledgerlens.plans import contract_queries as CQ
from ledgerlens.plans import drift_queries as DQ
from ledgerlens.plans.feature_queries import build_feature_table
from ledgerlens.plans.registry import register
from ledgerlens.session import shared_path
from ledgerlens.sources import roles
from ledgerlens.sources.roles import with_roles
from ledgerlens.streaming import streams as S

R = sql_round_sig


def _base(spark, name):
    return shared_path(spark, f"ledgerlens-stream-{name}-{uuid.uuid4().hex}")


def _ntz(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


@register("stream_ingest", with_roles("predictions") + f"""
SELECT request_id, position, occurred_at, {R('probability')} AS probability, decision FROM predictions""")
def stream_ingest(spark, d):
    """The prediction log, each line delivered twice, ingested by a file stream with
    watermark de-duplication into a date-partitioned Parquet table."""
    base = _base(spark, "ingest")
    pred = roles.predictions(spark, d)
    S.write_json_log(pred.unionByName(pred), f"{base}/in")
    stream = S.read_json_stream(spark, f"{base}/in", S.PREDICTION_SCHEMA)
    S.run_to_parquet(S.ingest_predictions(stream), f"{base}/out", f"{base}/checkpoint", ["dt"])
    back = spark.read.parquet(f"{base}/out")
    return back.select("request_id", "position", _ntz("occurred_at"), round_sig("probability").alias("probability"),
                       "decision")


# every line whose id leaves 7 modulo 97 is cut short, 8: an id that is no number, 9: of no known log
_LINES = """
SELECT 'requests' AS log, CAST(occurred_at AS DATE) AS day, id FROM requests
UNION ALL SELECT 'predictions', CAST(occurred_at AS DATE), id FROM predictions"""


@register("stream_both_logs", with_roles("requests", "predictions") + f"""
SELECT CASE WHEN id % 97 BETWEEN 7 AND 9 THEN 'unreadable' ELSE log END AS log,
       CAST(CASE WHEN id % 97 BETWEEN 7 AND 9 THEN NULL ELSE day END AS VARCHAR) AS dt, count(*) AS n,
       CAST(sum(CASE WHEN id % 97 BETWEEN 7 AND 9 THEN 0 ELSE id END) AS BIGINT) AS ids
FROM ({_LINES}) GROUP BY 1, 2""")
def stream_both_logs(spark, d):
    """One stream of JSON lines into the request and the prediction log, each batch as one unit, unreadable lines
    kept; all of it is delivered twice."""
    base = _base(spark, "both")
    at = F.date_format("occurred_at", S.TS_FORMAT).alias("occurred_at")
    for name, log in (("requests", "request"), ("predictions", "prediction")):
        rows = getattr(roles, name)(spark, d)
        line = F.to_json(F.struct(F.when(F.col("id") % 97 == 9, "other").otherwise(log).alias("log"),
                                  *[at if c == "occurred_at" else F.col(c) for c in rows.columns]))
        sent = (F.when(F.col("id") % 97 == 7, F.expr("left(line, length(line) - 5)"))
                .when(F.col("id") % 97 == 8, F.regexp_replace("line", r'"id":(\d+)', r'"id":"x$1"')).otherwise(F.col("line")))
        rows.withColumn("line", line).select(sent.alias("value")).write.text(f"{base}/in/{name}")
    # everything is delivered twice; the same batches overwrite their own rows
    for delivery in (1, 2):
        lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(f"{base}/in/*")
        S.ingest_lines(lines, f"{base}/out", f"{base}/checkpoint-{delivery}")
    out = None
    for name in ("requests", "predictions"):
        rows = L.read_log(spark, f"{base}/out", name).select(F.lit(name).alias("log"), F.col("dt").cast("string").alias("dt"), "id")
        out = rows if out is None else out.unionByName(rows)
    bad = spark.read.parquet(f"{base}/out/unreadable").select(
        F.lit("unreadable").alias("log"), F.lit(None).cast("string").alias("dt"), F.lit(0).cast("long").alias("id"))
    return out.unionByName(bad).groupBy("log", "dt").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


_CLASS = "CASE WHEN status_code >= 500 THEN '5xx' WHEN status_code >= 400 THEN '4xx' ELSE '2xx' END"


@register("stream_request_series", with_roles("requests") + f"""
SELECT * FROM (
  SELECT CAST(date_trunc('hour', occurred_at) AS TIMESTAMP) AS window_start,
         CAST(date_trunc('hour', occurred_at) AS TIMESTAMP) + INTERVAL 1 HOUR AS window_end,
         {_CLASS} AS status_class, count(*) AS calls
  FROM requests GROUP BY 1, 2, 3)
WHERE window_end <= (SELECT max(occurred_at) FROM requests) - INTERVAL 1 HOUR""")
def stream_request_series(spark, d):
    """R2: hourly tumbling windows of calls per status class; append mode, closed windows only."""
    base = _base(spark, "series")
    S.write_json_log(roles.requests(spark, d), f"{base}/in")
    stream = S.read_json_stream(spark, f"{base}/in", S.REQUEST_SCHEMA)
    S.run_to_parquet(S.request_series(stream), f"{base}/out", f"{base}/checkpoint")
    back = spark.read.parquet(f"{base}/out")
    return back.select(_ntz("window_start"), _ntz("window_end"), "status_class", "calls")


@register("stream_drift_sliding", with_roles("predictions") + """
SELECT * FROM (
  SELECT ws AS window_start, ws + INTERVAL 7 DAY AS window_end, count(*) AS n,
         count(*) FILTER (WHERE decision = 'rejected') AS rejected
  FROM (SELECT decision, CAST(date_trunc('day', occurred_at) AS TIMESTAMP) - to_days(CAST(k AS INTEGER)) AS ws
        FROM predictions, range(7) t(k))
  GROUP BY ws)
WHERE window_end <= (SELECT max(occurred_at) FROM predictions) - INTERVAL 1 DAY""")
def stream_drift_sliding(spark, d):
    """Sliding 7-day windows with a 1-day slide: volume and rejected count per closed window."""
    base = _base(spark, "sliding")
    S.write_json_log(roles.predictions(spark, d), f"{base}/in")
    stream = S.read_json_stream(spark, f"{base}/in", S.PREDICTION_SCHEMA)
    S.run_to_parquet(S.drift_sliding(stream), f"{base}/out", f"{base}/checkpoint")
    back = spark.read.parquet(f"{base}/out")
    return back.select(_ntz("window_start"), _ntz("window_end"), "n", "rejected")


# each observation is classed once; a window's counts are the sums of its seven days
_DAILY = [
    "days AS (SELECT CAST(date_trunc('day', o.occurred_at) AS TIMESTAMP) AS day, o.feature, "
    "len(list_filter(p.bounds, lambda x: x <= o.value)) AS class, count(*) AS n "
    "FROM obs o JOIN profile p ON o.feature = p.feature WHERE o.value IS NOT NULL GROUP BY ALL)",
    "wins AS (SELECT day - to_days(CAST(k AS INTEGER)) AS ws, feature, class, sum(n) AS n FROM days, range(7) t(k) GROUP BY ALL)",
    "sums AS (SELECT ws, feature, sum(n) AS n FROM wins GROUP BY ALL)",
    "classes AS (SELECT feature, unnest(proportions) AS r, unnest(range(0, len(proportions))) AS class FROM profile)",
    "parts AS (SELECT s.ws, s.feature, greatest(coalesce(w.n, 0) / s.n, 0.0001) AS p, greatest(c.r, 0.0001) AS r "
    "FROM sums s JOIN classes c ON s.feature = c.feature "
    "LEFT JOIN wins w ON w.ws = s.ws AND w.feature = s.feature AND w.class = c.class)",
    f"w AS (SELECT ws, feature, {sql_round_dec('sum((p - r) * ln(p / r))', 4)} AS psi FROM parts GROUP BY ws, feature)",
]


@register("stream_drift_psi", "WITH " + ",\n".join([*DQ.base_ctes(), *_DAILY]) + f"""
SELECT ws AS window_start, ws + INTERVAL 7 DAY AS window_end, feature, psi, {DQ.BAND} AS band FROM w
WHERE ws + INTERVAL 7 DAY <= (SELECT max(occurred_at) FROM pred) - INTERVAL 1 DAY""")
def stream_drift_psi(spark, d):
    """PSI per feature of every closed 7-day window (slide 1 day) against the profile of window A."""
    base = _base(spark, "psi")
    S.write_json_log(roles.predictions(spark, d), f"{base}/in")
    stream = S.read_json_stream(spark, f"{base}/in", S.PREDICTION_SCHEMA)
    S.psi_stream(stream, DQ.feature_columns(), DQ.log_profile(spark, d), f"{base}/out", f"{base}/checkpoint")
    back = spark.read.parquet(f"{base}/out")
    return back.select(_ntz("window_start"), _ntz("window_end"), "feature", "psi", "band")


@register("stream_escalation", f"""SELECT * FROM ({DQ.ESCALATION_SQL})
WHERE day + INTERVAL 1 DAY <= (SELECT max(occurred_at) FROM ({roles.SQL['predictions']})) - INTERVAL 1 DAY""")
def stream_escalation(spark, d):
    """The daily escalation as chained stateful operators; its closed production days are those of ``escalation_alerts``."""
    base = _base(spark, "escalation")
    S.write_json_log(roles.predictions(spark, d), f"{base}/in")
    stream = S.read_json_stream(spark, f"{base}/in", S.PREDICTION_SCHEMA)
    S.run_to_parquet(S.escalation_stream(stream, DQ.feature_columns(), DQ.log_profile(spark, d)), f"{base}/out", f"{base}/checkpoint")
    back = spark.read.parquet(f"{base}/out").filter(F.col("day") >= F.lit(roles.WINDOW_CUT).cast("timestamp"))
    return stable_doubles(back.select(_ntz("day"), "n_significant", "refusal_rate", "trailing_rate", "refusal_alert", "alert"))


@register("stream_score")
def stream_score(spark, d):
    """A stream of application records validated and scored per micro-batch; rejects and
    predictions land in two sinks."""
    base = _base(spark, "score")
    ft = build_feature_table(spark, d)
    train, cols = M.training_table(ft, "SK_ID_CURR", "TARGET")
    model = M.pipeline(cols, M.logistic(), scale=True).fit(train)
    S.write_json_log(CQ.records(spark, d), f"{base}/in")
    stream = S.read_json_stream(spark, f"{base}/in", S.RECORD_SCHEMA)
    S.score_stream(stream, CQ.contract(spark), model, cols, f"{base}/out", f"{base}/checkpoint", E.THRESHOLD)
    preds = spark.read.parquet(f"{base}/out/predictions").select(
        F.lit("prediction").alias("log"), "request_id", "position", F.col("decision").alias("outcome"))
    rejects = spark.read.parquet(f"{base}/out/rejects").select(
        F.lit("reject").alias("log"), "request_id", "position", F.col("reject_reason").alias("outcome"))
    return preds.unionByName(rejects)
