"""Registered queries over scoring requests as JSON text.

The oracles do not parse JSON: they take each value, and each broken payload, from the definition of the requests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.rounding import sql_round_sig, stable_doubles
from ledgerlens.operators import payload as P
from ledgerlens.operators import trees as T
from ledgerlens.plans.contract_queries import _contract_sql, contract
from ledgerlens.plans.registry import register
from ledgerlens.plans.tree_queries import _sql_value, _stand_in_rows, _walk, stand_in_nodes
from ledgerlens.sources import roles
from ledgerlens.sources.roles import THRESHOLD

R = sql_round_sig
VERSION = "v1"


def _requests(spark, d):
    return roles.payloads(spark, d).withColumn("occurred_at", F.timestamp_seconds("occurred_s").cast("timestamp_ntz"))


_NAMES = list(roles._PAYLOAD)
_ONLY = "(k % 41 = 0 OR k % 43 = 0 OR k % 47 = 0 OR k % 53 = 0 OR k % 59 = 0)"       # payloads without the usual fields
_UNREADABLE = "(k % 41 = 0 OR k % 43 = 0 OR (k % 59 = 0 AND k % 47 <> 0 AND k % 53 <> 0))"
_FIELDS = " UNION ALL ".join(
    f"SELECT k, '{name}' AS name, {roles._PAYLOAD[name].format(text='VARCHAR')} AS sent FROM src WHERE NOT {_ONLY}" for name in _NAMES)
_CTES = [
    f"req AS ({roles.SQL['payloads']})",
    "src AS (SELECT *, c_custkey AS k FROM customer)",
    f"""sent AS ({_FIELDS}
      UNION ALL SELECT k, 'UNKNOWN_SCORE', '1' FROM src WHERE NOT {_ONLY} AND k % 13 = 0
      UNION ALL SELECT k, 'AMT_CREDIT', '5000' FROM src WHERE k % 47 = 0 AND NOT {_UNREADABLE})""",
    """typed AS (SELECT k, name, CASE WHEN starts_with(sent, '"') THEN 'string' WHEN sent = 'true' THEN 'boolean'
        WHEN starts_with(sent, '{') THEN 'object' WHEN sent = 'null' THEN 'null' ELSE 'number' END AS kind, sent FROM sent)""",
    """vals AS (SELECT k, name, kind, CASE WHEN kind <> 'number' THEN NULL WHEN sent = '1e999' THEN CAST('inf' AS DOUBLE)
        ELSE CAST(sent AS DOUBLE) END AS value FROM typed)""",
    f"contract AS ({_contract_sql()})",
    """counts AS (SELECT r.k, count(*) FILTER (v.kind NOT IN ('number', 'null')) AS mistyped, count(*) FILTER (isinf(v.value)) AS infinite,
        count(*) FILTER (v.name IS NOT NULL AND c.name IS NULL) AS unknown,
        count(*) FILTER (v.value < c.low OR v.value > c.high) AS outside,
        count(*) FILTER (v.value IS NOT NULL AND c.origin = 'application') AS app,
        count(*) FILTER (v.value IS NOT NULL AND c.origin = 'history') AS hist
        FROM req r LEFT JOIN vals v ON r.k = v.k LEFT JOIN contract c ON v.name = c.name GROUP BY r.k)""",
    "sizes AS (SELECT count(*) FILTER (origin = 'application') AS na, count(*) FILTER (origin = 'history') AS nh FROM contract)",
    f"""verdict AS (SELECT r.*, app, hist, na, nh, CASE WHEN {_UNREADABLE.replace('k %', 'r.k %')} THEN 'unreadable' WHEN mistyped > 0 THEN 'type'
        WHEN infinite > 0 THEN 'non_finite' WHEN unknown > 0 THEN 'unknown' WHEN outside > 0 THEN 'range'
        WHEN app / na < 0.5 THEN 'coverage' END AS reject_reason FROM req r JOIN counts ON r.k = counts.k, sizes)""",
]


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


@register("payload_kinds", _with(*_CTES) + f"""
SELECT kind, name, count(*) AS n, {R('sum(CASE WHEN isinf(value) THEN NULL ELSE value END)')} AS total,
       count(*) FILTER (isinf(value)) AS n_infinite
FROM (SELECT kind, name, value FROM vals UNION ALL SELECT 'unreadable', NULL, NULL FROM req WHERE {_UNREADABLE}
      UNION ALL SELECT 'null', NULL, NULL FROM req WHERE k % 53 = 0 AND k % 41 <> 0 AND k % 43 <> 0 AND k % 47 <> 0) GROUP BY kind, name""")
def payload_kinds(spark, d):
    """the JSON type of every entry of every payload, with the sum of its finite numbers."""
    entries = P.typed_entries(_requests(spark, d).select("k", "payload"))
    infinite = F.abs("value") == F.lit(float("inf"))
    return stable_doubles(entries.groupBy("kind", "name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(~infinite, F.col("value"))).alias("total"), F.count_if(infinite).alias("n_infinite")))


@register("payload_verdicts", _with(*_CTES) + "SELECT request_id, position, reject_reason FROM verdict")
def payload_verdicts(spark, d):
    """Verdict of every payload: unreadable, type, non-finite, unknown, range, coverage, in this order."""
    return P.payload_verdicts(_requests(spark, d), contract(spark)).select("request_id", "position", "reject_reason")


_SCORED = [
    f"nodes(tree, node, feature, split, low, high, value, gain) AS (VALUES {', '.join(f'({chr(44).join(_sql_value(v) for v in row)})' for row in _stand_in_rows())})",
    "cells AS (SELECT k, name AS feature, value FROM vals)",
    "roots AS (SELECT k, tree, 0 AS node FROM req, (SELECT DISTINCT tree FROM nodes))",
    *_walk("roots", "cells", "leaf", "k"),
    "scores AS (SELECT k, 1 / (1 + exp(-2 * sum(value))) AS p FROM leaf GROUP BY k)",
    """gate AS (SELECT request_id, count(*) AS n FROM verdict GROUP BY request_id HAVING count(reject_reason) = 0 AND count(*) <= 1000)""",
]


@register("prediction_log", _with(*_CTES, *_SCORED) + f"""
SELECT v.request_id, v.position, make_timestamp(v.occurred_s * 1000000) AS occurred_at, v.endpoint, '{VERSION}' AS model_version,
       CAST({THRESHOLD} AS DOUBLE) AS threshold, {R('s.p')} AS probability,
       CASE WHEN s.p >= {THRESHOLD} THEN 'rejected' ELSE 'accepted' END AS decision,
       CAST(app + hist AS INTEGER) AS features_provided, CAST(na + nh - app - hist AS INTEGER) AS features_missing,
       {R('app / na')} AS application_ratio, {R('hist / nh')} AS history_ratio, {R('v.duration_ms / g.n')} AS latency_ms,
       v.payload AS features
FROM verdict v JOIN gate g ON v.request_id = g.request_id JOIN scores s ON v.k = s.k""")
def prediction_log(spark, d):
    """The full log record of every record of an accepted request, scored by the stated ensemble."""
    out = P.prediction_records(_requests(spark, d), contract(spark), T.Forest.of(stand_in_nodes(spark)), VERSION, THRESHOLD)
    return stable_doubles(out).withColumn("threshold", F.lit(THRESHOLD))
