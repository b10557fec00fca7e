"""Registered contract-validation queries over sparse application records.

Records are built from the customer feature rows (application block and the
POS aggregates): one record per customer, batches of up to 7 records per
request, a few injected defects (an unknown name, out-of-range values, an
explicit null) so every rule has rows to act on.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions.rounding import sql_round_sig, stable_doubles
from ledgerlens.operators import contract as C
from ledgerlens.operators.aggregate import _q
from ledgerlens.plans import feature_sql as FS
from ledgerlens.plans import features as FT
from ledgerlens.plans.registry import register
from ledgerlens.sources import roles

R = sql_round_sig
BATCH = 7
UNKNOWN_NAME = "UNKNOWN_SCORE"
COST_PER_VALUE_MS = 0.05


def feature_names() -> list[str]:
    """Ordered model feature list: every feature-table column except the key and the label."""
    blocks = [FS.application_block(), FS.bureau_block(), FS.previous_block(), FS.pos_block(),
              FS.instalment_block(), FS.card_block()]
    names = [FT.sanitise_name(n) for _, cols, _ in blocks for n, _ in cols]
    return [n for n in names if n not in ("SK_ID_CURR", "TARGET")]


def _record_columns() -> list[str]:
    cols = [n for n, _ in FS.application_block()[1]] + [n for n, _ in FS.pos_block()[1]]
    return [c for c in cols if c not in ("SK_ID_CURR", "TARGET")]


# ---------------------------------------------------------------- Spark side
def records(spark, d):
    app = FT.application_features(roles.application(spark, d))
    pos = FT.pos_features(roles.pos_cash(spark, d))
    src = app.join(pos, FT.KEY, "left")
    k = F.col(FT.KEY)

    def value(c):
        x = F.col(f"`{c}`").cast("double")
        if c == "AMT_ANNUITY":
            x = F.when(k % 19 == 0, F.lit(None).cast("double")).when(k % 11 == 0, F.lit(-1.0)).otherwise(x)
        if c == "DAYS_BIRTH":
            x = F.when(k % 17 == 0, F.lit(100.0)).otherwise(x)
        return x

    items = [F.struct(F.lit(c).alias("name"), value(c).alias("value")) for c in _record_columns()]
    items.append(F.when(k % 13 == 0, F.struct(F.lit(UNKNOWN_NAME).alias("name"), F.lit(1.0).alias("value"))))
    keep = lambda e: e.isNotNull() & (e.getField("value").isNotNull() |
                                      ((e.getField("name") == "AMT_ANNUITY") & (k % 19 == 0)))
    return src.select(F.concat(F.lit("q"), F.expr(f"{FT.KEY} div {BATCH}").cast("string")).alias("request_id"),
                      (k % BATCH).cast("int").alias("position"),
                      F.map_from_entries(F.filter(F.array(*items), keep)).alias("features"))


def contract(spark):
    return C.contract_table(spark, feature_names())


# ---------------------------------------------------------------- SQL side
def _contract_sql() -> str:
    values = ", ".join(f"({i}, '{n}')" for i, n in enumerate(feature_names()))
    hist = " OR ".join(f"starts_with(name, '{p}')" for p in C.HISTORY_PREFIXES)

    def rule(i):
        cases = " ".join(f"WHEN starts_with(name, '{p}') THEN {_lit((lo, hi, rs)[i])}" for p, lo, hi, rs in C.RANGE_RULES)
        return f"CASE WHEN ends_with(name, '{C.EXEMPT_SUFFIX}') THEN NULL {cases} END"

    return (f"SELECT CAST(pos AS INTEGER) AS pos, name, CASE WHEN {hist} THEN 'history' ELSE 'application' END AS origin, "
            f"CAST({rule(0)} AS DOUBLE) AS low, CAST({rule(1)} AS DOUBLE) AS high, CAST({rule(2)} AS VARCHAR) AS reason "
            f"FROM (VALUES {values}) v(pos, name)")


def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(float(v))


def _records_ctes() -> list[str]:
    app_ctes, _, _ = FS.application_block()
    pos_ctes, _, _ = FS.pos_block()
    cols = _record_columns()

    def value(c):
        x = f"CAST({_q(c)} AS DOUBLE)"
        if c == "AMT_ANNUITY":
            x = f"CASE WHEN SK_ID_CURR % 19 = 0 THEN NULL WHEN SK_ID_CURR % 11 = 0 THEN -1.0 ELSE {x} END"
        if c == "DAYS_BIRTH":
            x = f"CASE WHEN SK_ID_CURR % 17 = 0 THEN 100.0 ELSE {x} END"
        return f"CAST({x} AS DOUBLE) AS {_q(c)}"

    key = f"'q' || CAST(SK_ID_CURR // {BATCH} AS VARCHAR) AS request_id, CAST(SK_ID_CURR % {BATCH} AS INTEGER) AS position"
    return app_ctes + pos_ctes + [
        "src AS (SELECT app_x.*, posf.* EXCLUDE (SK_ID_CURR) FROM app_x LEFT JOIN posf USING (SK_ID_CURR))",
        f"ov AS (SELECT SK_ID_CURR, {', '.join(value(c) for c in cols)} FROM src)",
        f"ent0 AS (SELECT * FROM ov UNPIVOT INCLUDE NULLS (value FOR name IN ({', '.join(_q(c) for c in cols)})))",
        f"ent AS (SELECT {key}, name, value FROM ent0 "
        "WHERE value IS NOT NULL OR (name = 'AMT_ANNUITY' AND SK_ID_CURR % 19 = 0) "
        f"UNION ALL SELECT {key}, '{UNKNOWN_NAME}' AS name, 1.0 AS value FROM src WHERE SK_ID_CURR % 13 = 0)",
        f"recs AS (SELECT {key} FROM src)",
        f"contract AS ({_contract_sql()})",
    ]


def _with(*extra: str) -> str:
    return "WITH " + ",\n".join(_records_ctes() + list(extra)) + "\n"


_UNKNOWN = "unk AS (SELECT request_id, position, list(name ORDER BY name) AS unknown FROM ent WHERE name NOT IN (SELECT name FROM contract) GROUP BY 1, 2)"
_RANGE = ("rng AS (SELECT request_id, position, list(e.name || '=' || CAST(e.value AS VARCHAR) || ' (' || c.reason || ')' "
          "ORDER BY e.name) AS problems FROM ent e JOIN contract c USING (name) WHERE e.value IS NOT NULL AND c.reason IS NOT NULL "
          "AND ((c.low IS NOT NULL AND e.value < c.low) OR (c.high IS NOT NULL AND e.value > c.high)) GROUP BY 1, 2)")
_COV = ("cov AS (SELECT r.request_id, r.position, CAST(coalesce(h.a, 0) + coalesce(h.h, 0) AS INTEGER) AS provided, "
        "CAST(s.na + s.nh - coalesce(h.a, 0) - coalesce(h.h, 0) AS INTEGER) AS missing, "
        "coalesce(h.a, 0) / s.na AS application_ratio, coalesce(h.h, 0) / s.nh AS history_ratio "
        "FROM recs r LEFT JOIN (SELECT request_id, position, count(*) FILTER (WHERE origin = 'application') AS a, "
        "count(*) FILTER (WHERE origin = 'history') AS h FROM ent JOIN contract USING (name) WHERE value IS NOT NULL GROUP BY 1, 2) h "
        "USING (request_id, position), (SELECT count(*) FILTER (WHERE origin = 'application') AS na, "
        "count(*) FILTER (WHERE origin = 'history') AS nh FROM contract) s)")
_FIN = ("fin AS (SELECT request_id, position, count(*) AS n_values, "
        "count(*) FILTER (WHERE isnan(value) OR isinf(value)) AS n_non_finite FROM ent GROUP BY 1, 2)")


def _bounded_sql(lst: str, between: str = ", ") -> str:
    return (f"CASE WHEN len({lst}) > {C.MAX_LISTED} THEN array_to_string(list_slice({lst}, 1, {C.MAX_LISTED}), '{between}') "
            f"|| ' (+' || CAST(len({lst}) - {C.MAX_LISTED} AS VARCHAR) || ' others)' ELSE array_to_string({lst}, '{between}') END")


_VERDICT = f"""verdict AS (SELECT cov.*,
  CASE WHEN coalesce(fin.n_non_finite, 0) > 0 THEN 'non_finite' WHEN unk.unknown IS NOT NULL THEN 'unknown'
       WHEN rng.problems IS NOT NULL THEN 'range' WHEN cov.application_ratio < {C.MIN_APPLICATION_COVERAGE} THEN 'coverage' END AS reject_reason,
  CASE WHEN coalesce(fin.n_non_finite, 0) > 0 THEN 'non-finite values'
       WHEN unk.unknown IS NOT NULL THEN len(unk.unknown) || ' unknown feature(s): ' || {_bounded_sql('unk.unknown')}
       WHEN rng.problems IS NOT NULL THEN len(rng.problems) || ' value(s) out of range: ' || {_bounded_sql('rng.problems', '; ')}
       WHEN cov.application_ratio < {C.MIN_APPLICATION_COVERAGE} THEN 'application coverage '
            || CAST(CAST(floor(cov.application_ratio * 1000 + 0.5) / 10 AS DECIMAL(4, 1)) AS VARCHAR) || '%, at least {C.MIN_APPLICATION_COVERAGE:.0%} needed' END AS message
FROM cov LEFT JOIN unk USING (request_id, position) LEFT JOIN rng USING (request_id, position)
LEFT JOIN fin USING (request_id, position))"""


def _verdicts(spark, d):
    return C.validate(records(spark, d), contract(spark))


# ---------------------------------------------------------------- keys
@register("contract_rules", _with() + """
SELECT c.*, coalesce(n.n_provided, 0) AS n_provided FROM contract c
LEFT JOIN (SELECT name, count(*) FILTER (WHERE value IS NOT NULL) AS n_provided FROM ent GROUP BY name) n USING (name)""")
def contract_rules(spark, d):
    """Contract table (origin by prefix, first matching range rule, _PERC exempt) and how
    many records provide each feature."""
    ent = C.entries(records(spark, d))
    n = ent.groupBy("name").agg(F.count_if(F.col("value").isNotNull()).alias("n_provided"))
    return contract(spark).join(n, "name", "left").fillna(0, ["n_provided"]).select(
        "pos", "name", "origin", "low", "high", "reason", "n_provided")


@register("contract_unknown", _with(_UNKNOWN) + "SELECT * FROM unk")
def contract_unknown(spark, d):
    """Per record, sorted names absent from the contract (anti-join with the broadcast contract)."""
    return C.unknown_names(C.entries(records(spark, d)), contract(spark))


@register("contract_out_of_range", _with(_RANGE) + "SELECT * FROM rng")
def contract_out_of_range(spark, d):
    """V3: per record, out-of-range values sorted by name; NULL and unknown ignored."""
    return C.out_of_range(C.entries(records(spark, d)), contract(spark))


@register("contract_coverage", _with(_COV) + f"""
SELECT request_id, position, provided, missing, {R('application_ratio')} AS application_ratio,
       {R('history_ratio')} AS history_ratio FROM cov""")
def contract_coverage(spark, d):
    """Provided and missing counts, application and history coverage."""
    rec = records(spark, d)
    return stable_doubles(C.coverage(C.entries(rec), contract(spark), rec))


@register("contract_finite", _with(_FIN) + """
SELECT request_id, position, n_values, n_non_finite, n_non_finite = 0 AS finite FROM fin""")
def contract_finite(spark, d):
    """values must be finite (NaN and infinities rejected, NULL allowed)."""
    f = C.non_finite(C.entries(records(spark, d)))
    return f.withColumn("finite", F.col("n_non_finite") == 0)


@register("validate_records", _with(_UNKNOWN, _RANGE, _COV, _FIN, _VERDICT) + """
SELECT request_id, position, reject_reason, message FROM verdict""")
def validate_records(spark, d):
    """V5: verdict with precedence non-finite -> unknown -> range -> coverage, bounded message."""
    return _verdicts(spark, d).select("request_id", "position", "reject_reason", "message")


_BATCHES = """batches AS (SELECT request_id, count(*) AS n_items,
  CASE WHEN count(*) < 1 OR count(*) > 1000 OR count(reject_reason) > 0 THEN 'rejected' ELSE 'accepted' END AS status,
  min(position) FILTER (WHERE reject_reason IS NOT NULL) AS first_invalid_position,
  arg_min(reject_reason, position) FILTER (WHERE reject_reason IS NOT NULL) AS first_reason
FROM verdict GROUP BY request_id)"""


@register("validate_batches", _with(_UNKNOWN, _RANGE, _COV, _FIN, _VERDICT, _BATCHES) + "SELECT * FROM batches")
def validate_batches(spark, d):
    """V6: all-or-nothing batches; the first invalid record by position rejects the request."""
    return C.validate_batches(_verdicts(spark, d))


@register("prediction_records", _with(_UNKNOWN, _RANGE, _COV, _FIN, _VERDICT, _BATCHES) + f"""
SELECT v.request_id, v.position, 'v1' AS model_version, CAST(0.1 AS DOUBLE) AS threshold, v.provided, v.missing,
       {R('v.application_ratio')} AS application_ratio, {R('v.history_ratio')} AS history_ratio,
       {R(f'{COST_PER_VALUE_MS} * sum(v.provided) OVER (PARTITION BY v.request_id) / count(*) OVER (PARTITION BY v.request_id)')} AS latency_ms
FROM verdict v JOIN batches b USING (request_id) WHERE b.status = 'accepted'""")
def prediction_records(spark, d):
    """V7: one log record per file of an accepted request: version, threshold, coverage and the
    request's latency divided by the batch size (window over the request's few rows)."""
    v = _verdicts(spark, d)
    ok = C.validate_batches(v).filter(F.col("status") == "accepted").select("request_id")
    w = Window.partitionBy("request_id")
    out = v.join(ok, "request_id").select(
        "request_id", "position", F.lit("v1").alias("model_version"), F.lit(0.1).alias("threshold"),
        "provided", "missing", "application_ratio", "history_ratio",
        (COST_PER_VALUE_MS * F.sum("provided").over(w) / F.count(F.lit(1)).over(w)).alias("latency_ms"))
    return stable_doubles(out).withColumn("threshold", F.lit(0.1))


@register("name_set_ops", _with() + """
SELECT name, 'known' AS status FROM (SELECT DISTINCT name FROM ent INTERSECT SELECT name FROM contract)
UNION ALL
SELECT name, 'unknown' FROM (SELECT DISTINCT name FROM ent EXCEPT SELECT name FROM contract)""")
def name_set_ops(spark, d):
    """Names seen in records intersected with / minus the contract names (set operations)."""
    seen = C.entries(records(spark, d)).select("name")
    names = contract(spark).select("name")
    known = seen.intersect(names).withColumn("status", F.lit("known"))
    unknown = seen.subtract(names).withColumn("status", F.lit("unknown"))
    return known.unionByName(unknown)


@register("bounded_problem_list", _with() + f"""
SELECT request_id, position, {_bounded_sql('names')} AS message
FROM (SELECT request_id, position, list(name ORDER BY name) AS names FROM ent WHERE value IS NOT NULL GROUP BY 1, 2)""")
def bounded_problem_list(spark, d):
    """sorted names joined with a bound: the first 10 then "(+n others)"."""
    ent = C.entries(records(spark, d)).filter(F.col("value").isNotNull())
    g = ent.groupBy(*C.KEYS).agg(F.array_sort(F.collect_list("name")).alias("names"))
    return g.select(*C.KEYS, C.bounded_list(F.col("names")).alias("message"))
