"""Row-level operators on the application / history tables (P, E, U, J8 families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.columns import clip_low, inf_to_null, ne_null_safe, safe_ratio, sentinel_to_null, shift_clip
from ledgerlens.functions.rounding import round_sig, sql_round_sig, stable_doubles
from ledgerlens.operators.encode import category_share, factorize, fit_catalogue, one_hot, string_columns
from ledgerlens.plans import feature_sql as FS
from ledgerlens.plans import features as FT
from ledgerlens.plans.registry import register
from ledgerlens.sources import roles
from ledgerlens.sources.roles import with_roles

R = sql_round_sig


@register("filter_ne_nullsafe", with_roles("application") + """
SELECT SK_ID_CURR, CODE_GENDER FROM application WHERE CODE_GENDER IS DISTINCT FROM 'XNA'""")
def filter_ne_nullsafe(spark, d):
    """Drop the junk category, keep rows where the category is missing."""
    return roles.application(spark, d).filter(ne_null_safe("CODE_GENDER", "XNA")).select("SK_ID_CURR", "CODE_GENDER")


@register("sentinel_to_null", with_roles("previous_application") + """
SELECT SK_ID_PREV, """ + ", ".join(
    f"CASE WHEN {c} = 365243 THEN NULL ELSE {c} END AS {c}" for c in FT.SENTINEL_COLUMNS_PREVIOUS) + """
FROM previous_application""")
def sentinel_to_null_q(spark, d):
    """The 365243 day sentinel becomes missing."""
    prev = roles.previous_application(spark, d)
    return prev.select("SK_ID_PREV", *[sentinel_to_null(c).alias(c) for c in FT.SENTINEL_COLUMNS_PREVIOUS])


_RATIOS_SQL = [
    (FS.ratio_sql("CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE DAYS_EMPLOYED END", "DAYS_BIRTH"), "DAYS_EMPLOYED_PERC"),
    (FS.ratio_sql("AMT_INCOME_TOTAL", "AMT_CREDIT"), "INCOME_CREDIT_PERC"),
    (FS.ratio_sql("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"), "INCOME_PER_PERSON"),
    (FS.ratio_sql("AMT_ANNUITY", "AMT_INCOME_TOTAL"), "ANNUITY_INCOME_PERC"),
    (FS.ratio_sql("AMT_ANNUITY", "AMT_CREDIT"), "PAYMENT_RATE"),
]


def _ratio_frame(spark, d):
    app = roles.application(spark, d).withColumn("DAYS_EMPLOYED", sentinel_to_null("DAYS_EMPLOYED"))
    return app.select(
        "SK_ID_CURR",
        safe_ratio("DAYS_EMPLOYED", "DAYS_BIRTH").alias("DAYS_EMPLOYED_PERC"),
        safe_ratio("AMT_INCOME_TOTAL", "AMT_CREDIT").alias("INCOME_CREDIT_PERC"),
        safe_ratio("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS").alias("INCOME_PER_PERSON"),
        safe_ratio("AMT_ANNUITY", "AMT_INCOME_TOTAL").alias("ANNUITY_INCOME_PERC"),
        safe_ratio("AMT_ANNUITY", "AMT_CREDIT").alias("PAYMENT_RATE"))


@register("ratio_features", with_roles("application") + "SELECT SK_ID_CURR, " + ", ".join(
    f"{R(e)} AS {n}" for e, n in _RATIOS_SQL) + " FROM application")
def ratio_features(spark, d):
    """Ratio columns with float semantics (x/0 = ±inf, 0/0 = missing); infinities kept."""
    return stable_doubles(_ratio_frame(spark, d))


@register("inf_to_null", with_roles("application") + "SELECT SK_ID_CURR, " + ", ".join(
    f"{FS.clean_sql(e)} AS {n}" for e, n in _RATIOS_SQL) + ", " + " + ".join(
    f"CASE WHEN isinf({e}) THEN 1 ELSE 0 END" for e, _ in _RATIOS_SQL) + " AS n_infinite FROM application")
def inf_to_null_q(spark, d):
    """±inf -> missing over all ratio columns, with the count removed per row."""
    df = _ratio_frame(spark, d)
    cols = [c for c in df.columns if c != "SK_ID_CURR"]
    n_inf = sum(F.when(F.abs(F.col(c)) == float("inf"), 1).otherwise(0) for c in cols)
    return stable_doubles(df.select("SK_ID_CURR", *[inf_to_null(c).alias(c) for c in cols],
                                    n_inf.cast("int").alias("n_infinite")))


@register("clip_lower_days", with_roles("installments") + f"""
SELECT SK_ID_PREV, SK_ID_CURR, {FS.clip_low_sql('DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT')} AS DPD,
       {FS.clip_low_sql('DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT')} AS DBD FROM installments""")
def clip_lower_days(spark, d):
    """Days past / before due, clipped below at 0, missing kept."""
    ins = roles.installments(spark, d)
    return ins.select("SK_ID_PREV", "SK_ID_CURR",
                      clip_low(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")).alias("DPD"),
                      clip_low(F.col("DAYS_INSTALMENT") - F.col("DAYS_ENTRY_PAYMENT")).alias("DBD"))


@register("shift_clip", with_roles("predictions") + f"""
SELECT id, {R("CASE WHEN application_ratio - 0.2 < 0 THEN 0.0 WHEN application_ratio - 0.2 > 1 THEN 1.0 ELSE application_ratio - 0.2 END")} AS shifted
FROM predictions""")
def shift_clip_q(spark, d):
    """P5: subtract a shift then clip to [0, 1]."""
    p = roles.predictions(spark, d)
    return stable_doubles(p.select("id", shift_clip("application_ratio", 0.2).alias("shifted")))


_NUMERIC_APP = ["SK_ID_CURR", "TARGET", "DAYS_BIRTH", "DAYS_EMPLOYED", "AMT_INCOME_TOTAL", "AMT_CREDIT",
                "AMT_ANNUITY", "CNT_FAM_MEMBERS"]


@register("drop_by_dtype", with_roles("application") + f"SELECT {', '.join(_NUMERIC_APP)} FROM application")
def drop_by_dtype(spark, d):
    """Drop the residual string columns, found from the schema."""
    app = roles.application(spark, d)
    return app.drop(*string_columns(app))


@register("cast_numeric", with_roles("application") + "SELECT SK_ID_CURR, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in _NUMERIC_APP[1:]) + " FROM application")
def cast_numeric(spark, d):
    """Cast a group of columns to double in one projection."""
    app = roles.application(spark, d)
    return app.select("SK_ID_CURR", *[F.col(c).cast("double").alias(c) for c in _NUMERIC_APP[1:]])


def _bureau_oh_sql(nan: bool, sanitise: bool) -> str:
    items, names = FS.one_hot_sql(FT.CATALOGUE["bureau"], nan=nan)
    if sanitise:
        items = [i.rsplit(" AS ", 1)[0] + f' AS "{FT.sanitise_name(n)}"' for i, n in zip(items, names)]
    return with_roles("bureau") + f"SELECT SK_ID_BUREAU, {', '.join(items)} FROM bureau"


@register("sanitise_columns", _bureau_oh_sql(True, True))
def sanitise_columns_q(spark, d):
    """One-hot names with space / comma / colon replaced by '_' (collisions rejected)."""
    b = roles.bureau(spark, d).select("SK_ID_BUREAU", *FT.CATALOGUE["bureau"])
    df, _ = one_hot(b, FT.CATALOGUE["bureau"], nan_as_category=True)
    return FT.sanitise_columns(df)


_EXTRA_CONTRACT = ["EXT_SOURCE_1", "EXT_SOURCE_2"]
_REINDEX = ["SK_ID_CURR", "AMT_CREDIT", "EXT_SOURCE_1", "DAYS_BIRTH", "EXT_SOURCE_2", "PAYMENT_RATE"]


@register("reindex_contract", with_roles("application") + "SELECT SK_ID_CURR, AMT_CREDIT, CAST(NULL AS DOUBLE) AS EXT_SOURCE_1, "
          "DAYS_BIRTH, CAST(NULL AS DOUBLE) AS EXT_SOURCE_2, " + R(FS.clean_sql(FS.ratio_sql("AMT_ANNUITY", "AMT_CREDIT"))) +
          " AS PAYMENT_RATE FROM application")
def reindex_contract(spark, d):
    """P10: reorder to a contract name list; names the frame lacks come back as missing."""
    rate = round_sig(inf_to_null(safe_ratio("AMT_ANNUITY", "AMT_CREDIT")))
    app = roles.application(spark, d).select("*", rate.alias("PAYMENT_RATE"))
    have = set(app.columns)
    return app.select(*[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in _REINDEX])


@register("split_labelled", with_roles("application") + """
SELECT SK_ID_CURR, TARGET, 'labelled' AS part FROM application WHERE TARGET IS NOT NULL
UNION ALL
SELECT SK_ID_CURR, TARGET, 'unlabelled' AS part FROM application WHERE TARGET IS NULL""")
def split_labelled(spark, d):
    """Labelled / unlabelled split on the target being present."""
    app = roles.application(spark, d).select("SK_ID_CURR", "TARGET")
    lab = app.filter(F.col("TARGET").isNotNull()).withColumn("part", F.lit("labelled"))
    unl = app.filter(F.col("TARGET").isNull()).withColumn("part", F.lit("unlabelled"))
    return lab.unionByName(unl)


@register("union_by_name", with_roles("application") + "SELECT * FROM application")
def union_by_name(spark, d):
    """Train and test unioned by name; the test part has no TARGET."""
    return roles.application(spark, d)


@register("factorize_first_seen", with_roles("application") + """,
f AS (SELECT *, CASE WHEN TARGET IS NULL THEN 1 ELSE 0 END AS _test FROM application WHERE CODE_GENDER IS DISTINCT FROM 'XNA'),
""" + ",\n".join(
    f"c{i} AS (SELECT {c} AS v, dense_rank() OVER (ORDER BY min({{'t': _test, 'k': SK_ID_CURR}})) - 1 AS code FROM f "
    f"WHERE {c} IS NOT NULL GROUP BY {c})" for i, c in enumerate(FT.BINARY_APPLICATION)) + """
SELECT SK_ID_CURR, """ + ", ".join(f"coalesce(c{i}.code, -1) AS {c}" for i, c in enumerate(FT.BINARY_APPLICATION)) +
    " FROM f " + " ".join(f"LEFT JOIN c{i} ON f.{c} = c{i}.v" for i, c in enumerate(FT.BINARY_APPLICATION)))
def factorize_first_seen(spark, d):
    """Codes by order of first appearance (train before test, then key), missing = -1."""
    app = roles.application(spark, d).filter(ne_null_safe("CODE_GENDER", "XNA"))
    app = app.withColumn("_test", F.col("TARGET").isNull().cast("int"))
    return factorize(app, FT.BINARY_APPLICATION, ["_test", "SK_ID_CURR"]).select("SK_ID_CURR", *FT.BINARY_APPLICATION)


def _pos_oh_sql():
    items, _ = FS.one_hot_sql(FT.CATALOGUE["pos_cash"], nan=True)
    return with_roles("pos_cash") + f"SELECT SK_ID_PREV, {', '.join(items)} FROM pos_cash"


@register("one_hot_indicators", _pos_oh_sql())
def one_hot_indicators(spark, d):
    """Catalogue fitted on the data in one distributed pass, then 0/1 indicators plus ``_nan``."""
    pos = roles.pos_cash(spark, d).select("SK_ID_PREV", "NAME_CONTRACT_STATUS")
    cat = fit_catalogue(pos, ["NAME_CONTRACT_STATUS"])
    df, _ = one_hot(pos, cat, nan_as_category=True)
    return df


_PORTFOLIO = FT.CATALOGUE["previous_application"]["NAME_PORTFOLIO"]


@register("category_share", with_roles("previous_application") + "SELECT SK_ID_CURR, " + ", ".join(
    R(f"avg(CASE WHEN NAME_PORTFOLIO = '{v}' THEN 1.0 ELSE 0.0 END)") + f' AS "PREV_NAME_PORTFOLIO_{FT.sanitise_name(v)}_MEAN"'
    for v in _PORTFOLIO) + " FROM previous_application GROUP BY SK_ID_CURR")
def category_share_q(spark, d):
    """Share of each category among all rows of the customer."""
    prev = roles.previous_application(spark, d)
    return stable_doubles(FT.sanitise_columns(category_share(prev, "SK_ID_CURR", "NAME_PORTFOLIO", _PORTFOLIO, "PREV_")))


def _dup_sql():
    parts = []
    for name, block in (("bureau", FS.bureau_block), ("previous", FS.previous_block), ("pos", FS.pos_block),
                        ("instalments", FS.instalment_block), ("card", FS.card_block)):
        ctes, _, src = block()
        parts.append(f"SELECT '{name}' AS source, count(*) AS n_keys, count(*) - count(DISTINCT SK_ID_CURR) AS n_duplicated "
                     f"FROM (WITH {', '.join(ctes)} SELECT SK_ID_CURR FROM {src})")
    return "\nUNION ALL\n".join(parts)


@register("duplicate_keys", _dup_sql())
def duplicate_keys(spark, d):
    """Every aggregate must be unique on the customer key before it is joined."""
    blocks = {
        "bureau": FT.bureau_features(roles.bureau(spark, d), roles.bureau_balance(spark, d)),
        "previous": FT.previous_features(roles.previous_application(spark, d)),
        "pos": FT.pos_features(roles.pos_cash(spark, d)),
        "instalments": FT.instalment_features(roles.installments(spark, d)),
        "card": FT.card_features(roles.card_balance(spark, d)),
    }
    out = None
    for name, df in blocks.items():
        row = df.select(FT.KEY).agg(F.count(F.lit(1)).alias("n_keys"),
                                    (F.count(F.lit(1)) - F.countDistinct(FT.KEY)).alias("n_duplicated"))
        row = row.select(F.lit(name).alias("source"), "n_keys", "n_duplicated")
        out = row if out is None else out.unionByName(row)
    return out
