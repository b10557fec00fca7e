"""Registered queries over the node table of boosted trees.

A fit depends on the iterative solver, so the fitted keys are checked by rows only (``tests/test_trees.py`` holds their node
table against the model). The same operators are checked exactly with ``STAND_IN``, a stated ensemble applied to
the customer feature table: its oracle walks the node table row by row. Leaf values are multiples of 1/128, so
that both engines sum them exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.rounding import round_sig, sql_round_sig, stable_doubles
from ledgerlens.operators import drift as D
from ledgerlens.operators import trees as T
from ledgerlens.operators.sampling import sql_hash_key, stratified_folds
from ledgerlens.plans import feature_sql as FS
from ledgerlens.plans.contract_queries import feature_names
from ledgerlens.plans.drift_queries import profile_ctes
from ledgerlens.plans.feature_queries import build_feature_table
from ledgerlens.plans.registry import register
from ledgerlens.session import materialised

R = sql_round_sig
KEY, TARGET = "SK_ID_CURR", "TARGET"
SEEDS = [100, 101, 102]
FOLLOWED = 20          # features of the stored profile (fixed value)

# Stand-in ensemble: root, left and right split as (feature, split, gain), and four leaf values from left to right.
STAND_IN = [
    (("AMT_CREDIT", 6000.0, 9000.0), ("DAYS_EMPLOYED", -400.0, 3100.0), ("PAYMENT_RATE", 0.07, 800.0), (0.25, 0.125, -0.0625, -0.25)),
    (("AMT_INCOME_TOTAL", 40000.0, 4100.0), ("AMT_CREDIT", 3000.0, 2600.0), ("NAME_CONTRACT_TYPE_BUILDING", 0.5, 2200.0),
     (0.1875, 0.0625, -0.1875, 0.03125)),
    (("NAME_CONTRACT_TYPE_BUILDING", 0.5, 3900.0), ("DAYS_BIRTH", -7600.0, 700.0), ("DAYS_EMPLOYED", -900.0, 650.0),
     (-0.0625, -0.03125, 0.125, 0.15625)),
    (("PAYMENT_RATE", 0.05, 1500.0), ("BURO_AMT_CREDIT_SUM_MAX", 460000.0, 610.0), ("INSTAL_AMT_INSTALMENT_SUM", 103000.0, 590.0),
     (0.09375, 0.0625, -0.0390625, -0.0546875)),
    (("PREV_APP_CREDIT_PERC_VAR", 0.0014, 520.0), ("INSTAL_DPD_MEAN", 6.4, 500.0), ("CC_AMT_BALANCE_SUM", 2000000.0, 480.0),
     (0.0234375, -0.015625, 0.0078125, -0.0234375)),
    (("DAYS_EMPLOYED_PERC", 0.1, 900.0), ("POS_SK_DPD_DEF_MAX", 220.0, 210.0), ("INCOME_PER_PERSON", 25000.0, 470.0),
     (0.046875, 0.0546875, -0.03125, -0.0625)),
    (("ANNUITY_INCOME_PERC", 0.0083, 450.0), ("PREV_AMT_DOWN_PAYMENT_MEAN", 12500.0, 430.0), ("APPROVED_CNT_PAYMENT_MEAN", 17.0, 410.0),
     (0.015625, 0.0390625, -0.015625, 0.0)),
    (("REFUSED_DAYS_DECISION_MIN", -1364.0, 390.0), ("ACTIVE_AMT_ANNUITY_MEAN", 21000.0, 370.0), ("CLOSED_DAYS_CREDIT_VAR", 400000.0, 350.0),
     (0.0078125, -0.0078125, 0.015625, 0.0234375)),
    (("BURO_STATUS_F_MEAN_MEAN", 0.33, 330.0), ("CC_SK_DPD_MEAN", 4.0, 310.0), ("AMT_ANNUITY", 350.0, 290.0),
     (-0.0234375, 0.0078125, 0.03125, -0.0390625)),
    (("INSTAL_PAYMENT_DIFF_VAR", 5100000.0, 270.0), ("CNT_FAM_MEMBERS", 1.0, 250.0), ("AMT_CREDIT", 1500.0, 230.0),
     (0.0078125, -0.0078125, 0.0234375, -0.015625)),
]


def stand_in_nodes(spark):
    """The node table of ``STAND_IN``."""
    return spark.createDataFrame(_stand_in_rows(), T.NODES)


def _stand_in_rows() -> list[tuple]:
    rows = []
    for tree, (root, left, right, leaves) in enumerate(STAND_IN):
        for node, split, children in ((0, root, (1, 4)), (1, left, (2, 3)), (4, right, (5, 6))):
            rows.append((tree, node, split[0], split[1], *children, None, split[2]))
        rows += [(tree, node, None, None, None, None, value, None) for node, value in zip((2, 3, 5, 6), leaves)]
    return rows


def _labelled(spark, d):
    """Labelled customers of the feature table (single-precision values, as its oracle has them), written once."""
    ft = build_feature_table(spark, d, finish=lambda e: f"CAST(CAST({e} AS FLOAT) AS DOUBLE)")
    return materialised(ft.filter(F.col(TARGET).isNotNull()), "labelled-features")


def _folded(rows, columns):
    rows = rows.select(F.col(KEY).alias("id"), F.col(TARGET).alias("y"), *[f"`{c}`" for c in columns])
    return stratified_folds(rows, "y", "id", 3)


# ---------------------------------------------------------------- SQL side
def _sql_value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)


def _ctes() -> list[str]:
    used = sorted({s[0] for *splits, _ in STAND_IN for s in splits})
    values = ", ".join(f"({', '.join(_sql_value(v) for v in row)})" for row in _stand_in_rows())
    cast = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in used)
    names = ", ".join(f'"{c}"' for c in used)
    return [
        f"ftab AS ({FS.feature_table_query()})",
        f"nodes(tree, node, feature, split, low, high, value, gain) AS (VALUES {values})",
        f"""lab AS (SELECT SK_ID_CURR AS id, TARGET AS y,
          (row_number() OVER (PARTITION BY TARGET ORDER BY {sql_hash_key('SK_ID_CURR')}, SK_ID_CURR) - 1) % 3 AS fold
          FROM ftab WHERE TARGET IS NOT NULL)""",
        f"wide AS (SELECT SK_ID_CURR AS id, {cast} FROM ftab WHERE TARGET IS NOT NULL)",
        f"cells AS (SELECT id, feature, value FROM wide UNPIVOT INCLUDE NULLS (value FOR feature IN ({names})))",
    ]


def _walk(start: str, cells: str, name: str, keys: str) -> list[str]:
    """CTEs that walk two levels of the node table from the roots; ``{name}`` = (keys..., tree, value)."""
    def step(before, after):
        on = " AND ".join(f"c.{k} = w.{k}" for k in keys.split(", "))
        return (f"{after} AS (SELECT {', '.join('w.' + k for k in keys.split(', '))}, w.tree, "
                "CASE WHEN n.feature IS NULL THEN w.node WHEN c.value <= n.split THEN n.low ELSE n.high END AS node "
                f"FROM {before} w JOIN nodes n ON w.tree = n.tree AND w.node = n.node LEFT JOIN {cells} c ON {on} AND c.feature = n.feature)")
    return [step(start, f"{name}_1"), step(f"{name}_1", f"{name}_2"),
            f"{name} AS (SELECT {', '.join('w.' + k for k in keys.split(', '))}, w.tree, n.value FROM {name}_2 w "
            "JOIN nodes n ON w.tree = n.tree AND w.node = n.node)"]


def _auc(source: str, keys: str) -> str:
    """(keys..., auc, n) by mid-ranks."""
    return (f"SELECT {keys}, (sum(mid) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) "
            "/ (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc, count(*) AS n FROM ("
            f"SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY p) + (count(*) OVER (PARTITION BY {keys}, p) - 1) / 2.0 AS mid "
            f"FROM {source}) GROUP BY {keys}")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_ROOTS = "roots AS (SELECT id, tree, 0 AS node FROM lab, (SELECT DISTINCT tree FROM nodes))"
_LEAVES = [_ROOTS, *_walk("roots", "cells", "leaf", "id")]


# ---------------------------------------------------------------- keys with an oracle
@register("staged_curve", _with(
    *_ctes(), *_LEAVES,
    """staged AS (SELECT l.id, CASE WHEN lab.fold = 0 THEN 'valid' ELSE 'train' END AS part, lab.y, l.tree + 1 AS iteration,
       sum(l.value) OVER (PARTITION BY l.id ORDER BY l.tree ROWS UNBOUNDED PRECEDING) AS p FROM leaf l JOIN lab USING (id))""",
    f"auc AS ({_auc('staged', 'part, iteration')})",
    """loss AS (SELECT part, iteration, avg(ln(1 + exp(CASE WHEN y = 1 THEN -2 * p ELSE 2 * p END))) AS log_loss
       FROM staged GROUP BY part, iteration)""") + f"""
SELECT part, CAST(iteration AS INTEGER) AS iteration, {R('auc')} AS auc, {R('log_loss')} AS log_loss, n
FROM auc JOIN loss USING (part, iteration)""")
def staged_curve(spark, d):
    """AUC and log loss of both parts of the labelled customers after each tree of the stated ensemble."""
    forest = T.Forest.of(stand_in_nodes(spark))
    rows = _folded(_labelled(spark, d), forest.features())
    rows = rows.withColumn("part", F.when(F.col("fold") == 0, "valid").otherwise("train"))
    return stable_doubles(T.learning_curve(rows, forest))


@register("permutation_drops", _with(
    *_ctes(), *_LEAVES,
    "valid AS (SELECT id, y FROM lab WHERE fold = 0)",
    "partners AS (" + " UNION ALL ".join(
        f"SELECT {k} AS repeat, a.id, b.id AS partner FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM valid) a JOIN "
        f"(SELECT id, row_number() OVER (ORDER BY {sql_hash_key('id', seed)}, id) AS r FROM valid) b USING (r)"
        for k, seed in enumerate(SEEDS, start=1)) + ")",
    "uses AS (SELECT DISTINCT tree, feature AS moved FROM nodes WHERE feature IS NOT NULL)",
    """mixed AS (SELECT p.repeat, u.moved, p.id, c.feature, CASE WHEN c.feature = u.moved THEN o.value ELSE c.value END AS value
       FROM partners p JOIN (SELECT DISTINCT moved FROM uses) u ON true JOIN cells c ON c.id = p.id
       JOIN cells o ON o.id = p.partner AND o.feature = c.feature)""",
    "again AS (SELECT p.repeat, u.moved, p.id, u.tree, 0 AS node FROM partners p JOIN uses u ON true)",
    *_walk("again", "mixed", "moved_leaf", "repeat, moved, id"),
    "whole AS (SELECT id, sum(value) AS p FROM leaf GROUP BY id)",
    """scores AS (SELECT m.repeat, m.moved, m.id, any_value(v.y) AS y, any_value(w.p) + sum(m.value - l.value) AS p
       FROM moved_leaf m JOIN leaf l ON l.id = m.id AND l.tree = m.tree JOIN whole w ON w.id = m.id JOIN valid v ON v.id = m.id
       GROUP BY m.repeat, m.moved, m.id)""",
    f"base AS ({_auc('(SELECT 0 AS one, y, p FROM whole JOIN valid USING (id))', 'one')})",
    f"moved_auc AS ({_auc('scores', 'repeat, moved')})",
    f"names(feature) AS (VALUES {', '.join(f'({_sql_value(n)})' for n in feature_names())})") + f"""
SELECT n.feature, r.repeat::INTEGER AS repeat, {R('coalesce((SELECT auc FROM base) - m.auc, 0.0)')} AS auc_drop
FROM names n JOIN (VALUES (1), (2), (3)) r(repeat) ON true LEFT JOIN moved_auc m ON m.moved = n.feature AND m.repeat = r.repeat""")
def permutation_drops(spark, d):
    """AUC drop of the stated ensemble on the validation fold for every feature of the contract, 3 repeats."""
    forest = T.Forest.of(stand_in_nodes(spark))
    valid = _folded(_labelled(spark, d), forest.features()).filter("fold = 0")
    return stable_doubles(T.permutation_drops(valid, forest, feature_names(), SEEDS))


_GAINS = "gains AS (SELECT feature, sum(gain) AS importance FROM nodes WHERE feature IS NOT NULL GROUP BY feature)"
_TOP = ("top AS (SELECT *, importance / sum(importance) OVER () AS share, row_number() OVER (ORDER BY importance DESC, feature) AS rank, "
        "sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) / sum(importance) OVER () AS cum_share FROM gains)")


@register("gain_importance", _with(*_ctes(), _GAINS, _TOP) + f"""
SELECT top.feature, {R('importance')} AS importance, {R('share')} AS share, rank::INTEGER AS rank, {R('cum_share')} AS cum_share, n_rows
FROM top JOIN (SELECT feature, count(*) FILTER (value IS NOT NULL) AS n_rows FROM cells GROUP BY feature) c ON top.feature = c.feature""")
def gain_importance(spark, d):
    """Gain of every feature that the stated ensemble splits on, with the labelled customers that have a value."""
    nodes = stand_in_nodes(spark)
    rows = _labelled(spark, d)
    used = T.Forest.of(nodes).features()
    n = D.observations(rows, {c: F.col(f"`{c}`") for c in used}, []).groupBy("feature").agg(F.count("value").alias("n_rows"))
    return stable_doubles(T.gain_importance(nodes).join(n, "feature"))


def model_profile_of(rows, nodes, most: int = FOLLOWED):
    """Drift profile of the ``most`` features with the largest gain. The gain table prunes the rows to these columns
    before they are unpivoted, so a scan of ``rows`` reads them only."""
    gains = T.gain_importance(nodes).filter(F.col("rank") <= most).select("feature", "importance")
    followed = sorted(r["feature"] for r in gains.collect())                     # ``most`` names
    obs = D.observations(rows, {c: F.col(f"`{c}`") for c in followed}, [])
    return D.reference_profile(obs, gains)


@register("model_profile", _with(
    *_ctes(), _GAINS, _TOP,
    "ref AS (SELECT id, feature, value, value AS probability FROM cells WHERE feature IN (SELECT feature FROM top WHERE rank <= 20))",
    *profile_ctes()) + f"""
SELECT p.feature, list_transform(p.bounds, lambda x: {R('x')}) AS bounds, p.proportions, p.missing, {R('top.importance')} AS importance
FROM profile p JOIN top ON p.feature = top.feature""")
def model_profile(spark, d):
    """Bounds, class shares, missing rate and gain of the 20 features with the largest gain, over the labelled customers."""
    profile = model_profile_of(_labelled(spark, d), stand_in_nodes(spark))
    return profile.select("feature", F.transform("bounds", lambda x: round_sig(x)).alias("bounds"), "proportions", "missing",
                          round_sig("importance").alias("importance"))
