"""Registered drift queries: reference profile of the prediction log's window A, PSI of window B and of sub-windows, self-checks, sensitivity
sweep, synthesis and the data / escalation verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions.columns import psi_band, shift_clip
from ledgerlens.functions.rounding import round_dec, round_sig, sql_round_dec, sql_round_sig, stable_doubles
from ledgerlens.operators import drift as D
from ledgerlens.operators import logs as L
from ledgerlens.operators.ordered import attach, exact_percentiles
from ledgerlens.operators.sampling import hash_key, sql_hash_key
from ledgerlens.plans.feature_queries import build_feature_table
from ledgerlens.plans.feature_sql import feature_table_query
from ledgerlens.plans.registry import register
from ledgerlens.session import materialised
from ledgerlens.sources import roles
from ledgerlens.sources.roles import WINDOW_CUT, with_roles

R = sql_round_sig
RD = sql_round_dec

SPLIT = "2024-01-23 00:00:00"          # second production window starts here
SHIFT = 0.2
SHIFTS = [round(0.05 * i, 2) for i in range(0, 7)]
SHIFTED_FEATURE = "application_ratio"
FEATURES_SQL = {
    "k": "CAST(json_extract_string(features, '$.k') AS DOUBLE)",
    "latency_ms": "latency_ms",
    "application_ratio": "application_ratio",
    "history_ratio": "nullif(history_ratio, 0.0)",
}


def feature_columns():
    return {
        "k": L.json_double("features", "k"),
        "latency_ms": F.col("latency_ms"),
        "application_ratio": F.col("application_ratio"),
        "history_ratio": F.nullif(F.col("history_ratio"), F.lit(0.0)),
    }


# ---------------------------------------------------------------- Spark side
def _obs(spark, d):
    p = roles.predictions(spark, d)
    return D.observations(p, feature_columns(), ["id", "occurred_at", "probability", "decision"])


def _cut():
    return L.ts_literal(WINDOW_CUT)


def _reference(spark, d):
    """Observations of window A, all of them."""
    return _obs(spark, d).filter(F.col("occurred_at") < _cut())


def _production(spark, d):
    return _obs(spark, d).filter(F.col("occurred_at") >= _cut())


def _importance(ref):
    return ref.groupBy("feature").agg(round_dec(F.abs(F.corr("value", "probability")), 4).alias("importance"))


def log_profile(spark, d):
    # the observations are written once: the deciles, shares, missing rates and importances
    # below each read them instead of deriving them from the log again
    ref = materialised(_reference(spark, d), "reference")
    return D.reference_profile(ref, _importance(ref))


# ---------------------------------------------------------------- SQL side
def _obs_sql() -> str:
    parts = [f"SELECT id, occurred_at, probability, decision, '{n}' AS feature, CAST({e} AS DOUBLE) AS value FROM pred"
             for n, e in FEATURES_SQL.items()]
    return "\nUNION ALL ".join(parts)


def profile_ctes(ref: str = "ref", name: str = "profile") -> list[str]:
    qs = ", ".join(f"quantile_cont(value, {q})" for q in D.DECILES)
    return [
        f"{name}_b AS (SELECT feature, list_sort(list_distinct([{qs}])) AS bounds FROM {ref} WHERE value IS NOT NULL GROUP BY feature)",
        f"{name}_cls AS (SELECT r.feature, len(list_filter(b.bounds, lambda x: x <= r.value)) AS class "
        f"FROM {ref} r JOIN {name}_b b USING (feature) WHERE r.value IS NOT NULL)",
        f"{name}_cnt AS (SELECT feature, class, count(*) AS cnt FROM {name}_cls GROUP BY feature, class)",
        f"{name}_grid AS (SELECT feature, unnest(range(0, len(bounds) + 1)) AS class FROM {name}_b)",
        f"{name}_sh AS (SELECT g.feature, g.class, coalesce(c.cnt, 0) AS cnt, "
        f"sum(coalesce(c.cnt, 0)) OVER (PARTITION BY g.feature) AS n FROM {name}_grid g LEFT JOIN {name}_cnt c USING (feature, class))",
        f"{name}_p AS (SELECT feature, list({RD('CASE WHEN n = 0 THEN 0.0 ELSE cnt / n END', 6)} ORDER BY class) AS proportions "
        f"FROM {name}_sh GROUP BY feature)",
        f"{name}_m AS (SELECT feature, {RD('avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)', 6)} AS missing, "
        f"{RD('abs(corr(value, probability))', 4)} AS importance FROM {ref} GROUP BY feature)",
        f"{name} AS (SELECT b.feature, b.bounds, p.proportions, m.missing, m.importance FROM {name}_b b "
        f"JOIN {name}_p p USING (feature) JOIN {name}_m m USING (feature))",
    ]


def base_ctes() -> list[str]:
    return [
        f"pred AS ({roles.SQL['predictions']})",
        f"obs AS ({_obs_sql()})",
        f"ref AS (SELECT * FROM obs WHERE occurred_at < TIMESTAMP '{WINDOW_CUT}')",
        f"prod AS (SELECT * FROM obs WHERE occurred_at >= TIMESTAMP '{WINDOW_CUT}')",
    ] + profile_ctes()


def psi_ctes(obs: str, name: str, group: list[str], profile: str = "profile") -> list[str]:
    """CTE ``{name}`` = (group..., feature, psi, missing_production) of ``obs`` against ``profile``."""
    gs = "".join(f"{c}, " for c in group)
    gs_o = "".join(f"o.{c}, " for c in group)
    if group:
        grid = f"SELECT DISTINCT {gs_o}o.feature FROM {obs} o JOIN {profile} USING (feature)"
    else:
        grid = f"SELECT feature FROM {profile}"
    part = ", ".join(group + ["feature"])
    return [
        f"{name}_cls AS (SELECT {gs_o}o.feature, len(list_filter(p.bounds, lambda x: x <= o.value)) AS class "
        f"FROM {obs} o JOIN {profile} p USING (feature) WHERE o.value IS NOT NULL)",
        f"{name}_cnt AS (SELECT {gs}feature, class, count(*) AS cnt FROM {name}_cls GROUP BY {gs}feature, class)",
        f"{name}_grid AS ({grid})",
        f"{name}_ref AS (SELECT feature, unnest(proportions) AS r, unnest(range(0, len(proportions))) AS class FROM {profile})",
        f"{name}_full AS (SELECT g.*, rf.class, rf.r, coalesce(c.cnt, 0) AS cnt FROM {name}_grid g "
        f"JOIN {name}_ref rf USING (feature) LEFT JOIN {name}_cnt c USING ({part}, class))",
        f"{name}_sh AS (SELECT *, CASE WHEN sum(cnt) OVER (PARTITION BY {part}) = 0 THEN 0.0 "
        f"ELSE cnt / sum(cnt) OVER (PARTITION BY {part}) END AS p FROM {name}_full)",
        f"{name}_psi AS (SELECT {gs}feature, "
        f"{RD('sum((greatest(p, 0.0001) - greatest(r, 0.0001)) * ln(greatest(p, 0.0001) / greatest(r, 0.0001)))', 4)} AS psi "
        f"FROM {name}_sh GROUP BY {gs}feature)",
        f"{name}_miss AS (SELECT {gs}feature, {RD('avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)', 4)} AS missing_production "
        f"FROM {obs} JOIN (SELECT feature FROM {profile}) USING (feature) GROUP BY {gs}feature)",
        f"{name} AS (SELECT s.*, m.missing_production FROM {name}_psi s LEFT JOIN {name}_miss m USING ({part}))",
    ]


BAND = "CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END"


def _with(*ctes) -> str:
    return "WITH " + ",\n".join(c for group in ctes for c in group) + "\n"


def _r_list(expr: str) -> str:
    return f"list_transform({expr}, lambda x: {R('x')})"


# ---------------------------------------------------------------- keys
@register("decile_bounds", _with(base_ctes()) + f"SELECT feature, {_r_list('bounds')} AS bounds FROM profile_b")
def decile_bounds(spark, d):
    """De-duplicated inner deciles per feature of the reference sample."""
    return stable_doubles(D.decile_bounds(_reference(spark, d)))


@register("class_shares", _with(base_ctes(), psi_ctes("prod", "pr", [])) +
          f"SELECT feature, CAST(class AS INTEGER) AS class, {R('p')} AS share, "
          "CAST(sum(cnt) OVER (PARTITION BY feature) AS BIGINT) AS n_values FROM pr_sh")
def class_shares(spark, d):
    """Share of window B's non-missing values in each reference class (empty classes = 0)."""
    return stable_doubles(D.class_shares(_production(spark, d), log_profile(spark, d)))


@register("reference_profile", _with(base_ctes()) +
          f"SELECT feature, {_r_list('bounds')} AS bounds, proportions, missing, importance FROM profile")
def reference_profile(spark, d):
    """Bounds, class proportions (6 decimals), missing rate and importance per feature."""
    prof = log_profile(spark, d)
    return prof.select("feature", F.transform("bounds", lambda x: round_sig(x)).alias("bounds"),
                       "proportions", "missing", "importance")


@register("psi_feature", _with(base_ctes(), psi_ctes("prod", "pr", [])) + f"SELECT feature, psi, {BAND} AS band FROM pr")
def psi_feature(spark, d):
    """PSI of window B per feature and its band (on the rounded value)."""
    return D.psi(_production(spark, d), log_profile(spark, d)).select("feature", "psi", "band")


_DRIFT_SQL = (_with(base_ctes(), psi_ctes("prod", "pr", [])) +
              f"SELECT p.feature, pr.psi, {BAND.replace('psi', 'pr.psi')} AS band, p.missing AS missing_reference, "
              "pr.missing_production, p.importance FROM profile p LEFT JOIN pr USING (feature)")


@register("drift_table", _DRIFT_SQL)
def drift_table(spark, d):
    """PSI, band, missing rates and importance for every profiled feature."""
    return D.drift_table(_production(spark, d), log_profile(spark, d))


# ---------------------------------------------------------------- the whole contract
_CONTRACT_CTES = [
    f"ftab AS ({feature_table_query()})",
    "cells AS (SELECT * FROM (SELECT SK_ID_CURR AS id, TARGET IS NULL AS unlabelled, "
    "CAST(COLUMNS(* EXCLUDE (SK_ID_CURR, TARGET)) AS DOUBLE) FROM ftab) "
    "UNPIVOT INCLUDE NULLS (value FOR feature IN (COLUMNS(* EXCLUDE (id, unlabelled)))))",
    "ref AS (SELECT id, feature, value, value AS probability FROM cells WHERE NOT unlabelled)",
    "prod AS (SELECT id, feature, value FROM cells WHERE unlabelled)",
] + profile_ctes() + psi_ctes("prod", "pr", [])


def _contract_drift(spark, d):
    """Drift table of every model feature: labelled customers are the reference, the others production."""
    ft = build_feature_table(spark, d, finish=lambda e: f"CAST(CAST({e} AS FLOAT) AS DOUBLE)")
    features = {c: F.col(f"`{c}`") for c in ft.columns if c not in ("SK_ID_CURR", "TARGET")}
    obs = materialised(D.observations(ft, features, ["TARGET"]), "contract-observations")
    profile = D.reference_profile(obs.filter(F.col("TARGET").isNotNull()))
    return D.drift_table(obs.filter(F.col("TARGET").isNull()), profile)


@register("drift_contract", _with(_CONTRACT_CTES) + f"""
SELECT p.feature, pr.psi, {BAND.replace('psi', 'pr.psi')} AS band, p.missing AS missing_reference, pr.missing_production
FROM profile p LEFT JOIN pr USING (feature)""")
def drift_contract(spark, d):
    """PSI, band and missing rates of every feature of the contract, from the feature table."""
    return _contract_drift(spark, d).drop("importance")


@register("drift_contract_share", _with(_CONTRACT_CTES) + """
SELECT count(*) AS n_features, count(*) FILTER (WHERE psi >= 0.10) AS n_drifted,
       count(*) FILTER (WHERE psi >= 0.25) AS n_significant FROM pr""")
def drift_contract_share(spark, d):
    """How many of the contract's features drifted."""
    return _contract_drift(spark, d).agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("psi") >= 0.10).alias("n_drifted"),
        F.count_if(F.col("psi") >= 0.25).alias("n_significant"))


@register("missing_rate_gap", _with(base_ctes(), psi_ctes("prod", "pr", [])) + f"""
SELECT feature, missing_reference, missing_production, {R('missing_production - missing_reference')} AS gap,
       row_number() OVER (ORDER BY abs(missing_production - missing_reference) DESC, feature) AS rank
FROM (SELECT p.feature, p.missing AS missing_reference, pr.missing_production FROM profile p JOIN pr USING (feature))""")
def missing_rate_gap(spark, d):
    """Reference vs production missing rates, sorted by absolute gap (window on the feature table)."""
    t = D.drift_table(_production(spark, d), log_profile(spark, d))
    gap = F.col("missing_production") - F.col("missing_reference")
    w = Window.orderBy(F.abs(gap).desc(), "feature")
    out = t.select("feature", "missing_reference", "missing_production", gap.alias("gap"),
                   F.row_number().over(w).cast("bigint").alias("rank"))
    return out.withColumn("gap", round_sig(F.col("gap")))


@register("drifted_share", _with(base_ctes(), psi_ctes("prod", "pr", [])) + f"""
SELECT count(*) AS n_features, count(*) FILTER (WHERE pr.psi >= 0.10) AS n_drifted,
       {R('count(*) FILTER (WHERE pr.psi >= 0.10) / count(*)')} AS drifted_share
FROM profile p LEFT JOIN pr USING (feature)""")
def drifted_share(spark, d):
    """Number and share of profiled features with PSI >= 0.10."""
    t = D.drift_table(_production(spark, d), log_profile(spark, d))
    return stable_doubles(t.agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("psi") >= 0.10).alias("n_drifted"),
                                (F.count_if(F.col("psi") >= 0.10) / F.count(F.lit(1))).alias("drifted_share")))


def _self_check_sql():
    h = sql_hash_key("id")
    ctes = base_ctes() + [
        f"half1 AS (SELECT * FROM ref WHERE {h} % 2 = 0)",
        f"half2 AS (SELECT * FROM ref WHERE {h} % 2 <> 0)",
    ] + profile_ctes("half1", "prof1") + psi_ctes("half2", "hv", [], "prof1") + [
        f"shifted AS (SELECT id, feature, CASE WHEN feature = '{SHIFTED_FEATURE}' THEN "
        f"(CASE WHEN value - {SHIFT} < 0 THEN 0.0 WHEN value - {SHIFT} > 1 THEN 1.0 ELSE value - {SHIFT} END) "
        "ELSE value END AS value FROM ref)",
    ] + psi_ctes("shifted", "sv", [])
    return "WITH " + ",\n".join(ctes) + f"""
SELECT feature, hv.psi AS psi_halves, {BAND.replace('psi', 'hv.psi')} AS band_halves,
       sv.psi AS psi_shifted, {BAND.replace('psi', 'sv.psi')} AS band_shifted
FROM hv JOIN sv USING (feature)"""


@register("drift_self_check", _self_check_sql())
def drift_self_check(spark, d):
    """The instrument itself: one half of the reference against a profile of the
    other half must be stable; the reference with one feature shifted must drift."""
    ref = materialised(_reference(spark, d), "reference")
    h = hash_key("id")
    half1, half2 = ref.filter(h % 2 == 0), ref.filter(h % 2 != 0)
    prof1 = D.reference_profile(half1)
    halves = D.psi(half2, prof1).select("feature", F.col("psi").alias("psi_halves"), F.col("band").alias("band_halves"))
    shifted = ref.withColumn("value", F.when(F.col("feature") == SHIFTED_FEATURE, shift_clip("value", SHIFT))
                             .otherwise(F.col("value")))
    sv = D.psi(shifted, D.reference_profile(ref)).select("feature", F.col("psi").alias("psi_shifted"),
                                                          F.col("band").alias("band_shifted"))
    return halves.join(sv, "feature")


def _sensitivity_sql():
    grid = "(VALUES " + ", ".join(f"(CAST({s} AS DOUBLE))" for s in SHIFTS) + ") sh(shift)"
    ctes = base_ctes() + [
        f"swept AS (SELECT sh.shift, o.id, o.feature, CASE WHEN o.feature = '{SHIFTED_FEATURE}' THEN "
        "(CASE WHEN o.value - sh.shift < 0 THEN 0.0 WHEN o.value - sh.shift > 1 THEN 1.0 ELSE o.value - sh.shift END) "
        f"ELSE o.value END AS value FROM prod o, {grid})",
    ] + psi_ctes("swept", "sw", ["shift"])
    return "WITH " + ",\n".join(ctes) + f"""
SELECT shift, psi, {BAND} AS band, n_drifted,
       min(CASE WHEN psi >= 0.10 THEN shift END) OVER () AS first_moderate_shift,
       min(CASE WHEN psi >= 0.25 THEN shift END) OVER () AS first_significant_shift
FROM (SELECT shift, max(psi) FILTER (WHERE feature = '{SHIFTED_FEATURE}') AS psi,
             count(*) FILTER (WHERE psi >= 0.10) AS n_drifted FROM sw GROUP BY shift)"""


@register("drift_sensitivity", _sensitivity_sql())
def drift_sensitivity(spark, d):
    """Shift one feature of window B by 0 ... 0.30; PSI and drifted count per shift, and the
    first shift crossing each band."""
    p = D.shifted_psi(_production(spark, d), log_profile(spark, d), SHIFTS, [SHIFTED_FEATURE])
    per = p.groupBy("shift").agg(F.max(F.when(F.col("feature") == SHIFTED_FEATURE, F.col("psi"))).alias("psi"),
                                 F.count_if(F.col("psi") >= 0.10).alias("n_drifted"))
    w = Window.partitionBy()  # over the 7 shift rows only
    return per.select("shift", "psi", psi_band("psi").alias("band"), "n_drifted",
                      F.min(F.when(F.col("psi") >= 0.10, F.col("shift"))).over(w).alias("first_moderate_shift"),
                      F.min(F.when(F.col("psi") >= 0.25, F.col("shift"))).over(w).alias("first_significant_shift"))


SHIFTED_TOGETHER = ["application_ratio", "history_ratio"]


def _sweep_sql():
    grid = "(VALUES " + ", ".join(f"(CAST({s} AS DOUBLE))" for s in SHIFTS) + ") sh(shift)"
    moved = ", ".join(f"'{f}'" for f in SHIFTED_TOGETHER)
    ctes = base_ctes() + [
        f"swept AS (SELECT sh.shift, o.feature, CASE WHEN o.feature IN ({moved}) THEN least(greatest(o.value - sh.shift, 0.0), 1.0) "
        f"ELSE o.value END AS value FROM prod o, {grid} WHERE o.value IS NOT NULL)",
    ] + psi_ctes("swept", "sw", ["shift"])
    return "WITH " + ",\n".join(ctes) + f"""
SELECT shift, feature, psi, {BAND} AS band, CAST(sum(CASE WHEN psi >= 0.10 THEN 1 ELSE 0 END) OVER (PARTITION BY shift) AS BIGINT) AS n_drifted,
       min(CASE WHEN psi >= 0.10 THEN shift END) OVER (PARTITION BY feature) AS first_moderate_shift,
       min(CASE WHEN psi >= 0.25 THEN shift END) OVER (PARTITION BY feature) AS first_significant_shift FROM sw"""


@register("drift_sweep", _sweep_sql())
def drift_sweep(spark, d):
    """Several features of window B shifted together; PSI of every feature per shift, the number that drifted, and the
    first shift at which each feature crosses a band."""
    p = D.shifted_psi(_production(spark, d), log_profile(spark, d), SHIFTS, SHIFTED_TOGETHER)
    by_shift, by_feature = Window.partitionBy("shift"), Window.partitionBy("feature")      # features x shifts rows
    return p.select("shift", "feature", "psi", "band", F.sum((F.col("psi") >= 0.10).cast("bigint")).over(by_shift).alias("n_drifted"),
                    F.min(F.when(F.col("psi") >= 0.10, F.col("shift"))).over(by_feature).alias("first_moderate_shift"),
                    F.min(F.when(F.col("psi") >= 0.25, F.col("shift"))).over(by_feature).alias("first_significant_shift"))


_WIN_SQL = f"CASE WHEN occurred_at < TIMESTAMP '{SPLIT}' THEN 'B1' ELSE 'B2' END"


def _sub_windows(spark, d):
    prod = _production(spark, d)
    return prod.withColumn("window_label", F.when(F.col("occurred_at") < L.ts_literal(SPLIT), "B1").otherwise("B2"))


@register("drift_two_windows", _with(base_ctes(), [f"prodw AS (SELECT *, {_WIN_SQL} AS window_label FROM prod)"],
                                     psi_ctes("prodw", "tw", ["window_label"])) + f"""
SELECT a.feature, a.psi AS psi_a, b.psi AS psi_b, {BAND.replace('psi', 'b.psi')} AS band_b
FROM (SELECT * FROM tw WHERE window_label = 'B1') a JOIN (SELECT * FROM tw WHERE window_label = 'B2') b USING (feature)""")
def drift_two_windows(spark, d):
    """PSI of two production windows per feature (grouped once), band of the later one."""
    p = D.psi(_sub_windows(spark, d), log_profile(spark, d), ["window_label"])
    a = p.filter(F.col("window_label") == "B1").select("feature", F.col("psi").alias("psi_a"))
    b = p.filter(F.col("window_label") == "B2").select("feature", F.col("psi").alias("psi_b"), F.col("band").alias("band_b"))
    return a.join(b, "feature")


@register("window_synthesis", _with(base_ctes(), [f"prodw AS (SELECT *, {_WIN_SQL} AS window_label FROM prod)"],
                                    psi_ctes("prodw", "tw", ["window_label"])) + f"""
SELECT s.window_label, {R('s.max_psi')} AS max_psi, s.n_drifted, {R('l.refusal_rate')} AS refusal_rate, {R('l.p95_latency_ms')} AS p95_latency_ms
FROM (SELECT window_label, max(psi) AS max_psi, count(*) FILTER (WHERE psi >= 0.10) AS n_drifted FROM tw GROUP BY window_label) s
JOIN (SELECT {_WIN_SQL} AS window_label, avg(CASE WHEN decision = 'rejected' THEN 1.0 ELSE 0.0 END) AS refusal_rate,
             quantile_cont(latency_ms, 0.95) AS p95_latency_ms
      FROM pred WHERE occurred_at >= TIMESTAMP '{WINDOW_CUT}' GROUP BY 1) l USING (window_label)""")
def window_synthesis(spark, d):
    """Per production window, max PSI, drifted features, refusal rate and p95 latency."""
    p = D.psi(_sub_windows(spark, d), log_profile(spark, d), ["window_label"])
    s = p.groupBy("window_label").agg(F.max("psi").alias("max_psi"), F.count_if(F.col("psi") >= 0.10).alias("n_drifted"))
    pred = roles.predictions(spark, d).filter(F.col("occurred_at") >= _cut())
    pred = pred.withColumn("window_label", F.when(F.col("occurred_at") < L.ts_literal(SPLIT), "B1").otherwise("B2"))
    lg = pred.groupBy("window_label").agg(L.rejected_rate().alias("refusal_rate"))
    lg = attach(lg, exact_percentiles(pred, "latency_ms", {"p95_latency_ms": 0.95}, ["window_label"]), ["window_label"])
    return stable_doubles(s.join(lg, "window_label"))


@register("verdict_data", _with(base_ctes(), psi_ctes("prod", "pr", [])) + f"""
SELECT n.n_predictions, s.n_significant, s.n_moderate,
       CASE WHEN n.n_predictions < 500 THEN 'info' WHEN s.n_significant > 0 THEN 'warning' ELSE 'ok' END AS level,
       s.features
FROM (SELECT count(*) AS n_predictions FROM pred WHERE occurred_at >= TIMESTAMP '{WINDOW_CUT}') n,
     (SELECT count(*) FILTER (WHERE psi >= 0.25) AS n_significant,
             count(*) FILTER (WHERE psi >= 0.10 AND psi < 0.25) AS n_moderate,
             coalesce(array_to_string(list_sort(list(feature) FILTER (WHERE psi >= 0.25)), ', '), '') AS features
      FROM pr) s""")
def verdict_data(spark, d):
    """Info under 500 predictions, warning naming the significant features, ok otherwise."""
    t = D.drift_table(_production(spark, d), log_profile(spark, d))
    s = t.agg(F.count_if(F.col("psi") >= 0.25).alias("n_significant"),
              F.count_if((F.col("psi") >= 0.10) & (F.col("psi") < 0.25)).alias("n_moderate"),
              F.concat_ws(", ", F.array_sort(F.collect_list(F.when(F.col("psi") >= 0.25, F.col("feature"))))).alias("features"))
    n = roles.predictions(spark, d).filter(F.col("occurred_at") >= _cut()).agg(F.count(F.lit(1))).scalar()
    out = s.withColumn("n_predictions", n)
    level = (F.when(F.col("n_predictions") < L.MIN_PREDICTIONS_PSI, "info")
             .when(F.col("n_significant") > 0, "warning").otherwise("ok"))
    return out.select("n_predictions", "n_significant", "n_moderate", level.alias("level"), "features")


ESCALATION_SQL = _with(base_ctes(), [
    "prodd AS (SELECT *, CAST(date_trunc('day', occurred_at) AS TIMESTAMP) AS day FROM prod)"],
    psi_ctes("prodd", "dd", ["day"])) + f"""
, rates AS (SELECT CAST(date_trunc('day', occurred_at) AS TIMESTAMP) AS day,
                   date_diff('day', DATE '1970-01-01', CAST(occurred_at AS DATE)) AS day_number,
                   avg(CASE WHEN decision = 'rejected' THEN 1.0 ELSE 0.0 END) AS refusal_rate FROM pred GROUP BY 1, 2),
trail AS (SELECT *, avg(refusal_rate) OVER (ORDER BY day_number RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS tr FROM rates)
SELECT day, n_significant, {R('refusal_rate')} AS refusal_rate, {R('tr')} AS trailing_rate,
       coalesce(abs(refusal_rate - tr) / tr > 0.2, false) AS refusal_alert,
       n_significant >= 2 OR coalesce(abs(refusal_rate - tr) / tr > 0.2, false) AS alert
FROM (SELECT day, count(*) FILTER (WHERE psi >= 0.25) AS n_significant FROM dd GROUP BY day) JOIN trail USING (day)"""


@register("escalation_alerts", ESCALATION_SQL)
def escalation_alerts(spark, d):
    """Per production day, alert when >= 2 features are significant or the refusal rate is
    more than 20 % off the mean of the 7 preceding days."""
    prod = _production(spark, d).withColumn("day", L.bucket_start("occurred_at", "day"))
    p = D.psi(prod, log_profile(spark, d), ["day"])
    sig = p.groupBy("day").agg(F.count_if(F.col("psi") >= 0.25).alias("n_significant"))
    pred = roles.predictions(spark, d)
    daily = pred.groupBy(L.bucket_start("occurred_at", "day").alias("day"),
                         F.unix_date(F.col("occurred_at").cast("date")).cast("bigint").alias("day_number")).agg(
        L.rejected_rate().alias("refusal_rate"))
    daily = daily.withColumn("trailing_rate", F.avg("refusal_rate").over(Window.orderBy("day_number").rangeBetween(-7, -1)))
    gap_alert = F.coalesce(F.abs(F.col("refusal_rate") - F.col("trailing_rate")) / F.col("trailing_rate") > L.MAX_REFUSAL_GAP,
                           F.lit(False))
    out = sig.join(daily, "day").select("day", "n_significant", "refusal_rate", "trailing_rate",
                                        gap_alert.alias("refusal_alert"),
                                        ((F.col("n_significant") >= 2) | gap_alert).alias("alert"))
    return stable_doubles(out)


@register("psi_bucket", _with(base_ctes()) + """
SELECT o.id, o.feature, len(list_filter(p.bounds, lambda x: x <= o.value)) AS class
FROM prod o JOIN profile p USING (feature) WHERE o.value IS NOT NULL""")
def psi_bucket(spark, d):
    """class of each production value = number of sorted bounds <= value (broadcast profile)."""
    prof = F.broadcast(log_profile(spark, d).select("feature", "bounds"))
    prod = _production(spark, d).filter(F.col("value").isNotNull()).join(prof, "feature")
    return prod.select("id", "feature", D.class_of(F.col("bounds"), F.col("value")).cast("bigint").alias("class"))
