"""Customer feature table: application columns plus per-customer aggregates of
five history tables, left-joined on the customer key.

Every builder takes DataFrames with the reference's table schemas and returns
one row per ``SK_ID_CURR``. Each aggregate is a single ``groupBy`` by the
customer key over rows that are dealt by that key before (``_dealt``), and the
final chain of left joins runs on these partitions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.columns import (clip_low, inf_to_null, ne_null_safe, safe_ratio,
                                          sentinel_to_null)
from ledgerlens.operators.aggregate import agg_columns, aggregate, output_names
from ledgerlens.operators.encode import factorize_few, indicator_name, one_hot

KEY = "SK_ID_CURR"

# ---------------------------------------------------------------- fixed values
# Aggregation specifications of the reference (column -> statistics).
BUREAU_BALANCE_NUM = {"MONTHS_BALANCE": ["min", "max", "size"]}
BUREAU_NUM = {
    "DAYS_CREDIT": ["min", "max", "mean", "var"],
    "DAYS_CREDIT_ENDDATE": ["min", "max", "mean"],
    "DAYS_CREDIT_UPDATE": ["mean"],
    "CREDIT_DAY_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_MAX_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_DEBT": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM_LIMIT": ["mean", "sum"],
    "AMT_ANNUITY": ["max", "mean"],
    "CNT_CREDIT_PROLONG": ["sum"],
    "MONTHS_BALANCE_MIN": ["min"],
    "MONTHS_BALANCE_MAX": ["max"],
    "MONTHS_BALANCE_SIZE": ["mean", "sum"],
}
PREVIOUS_NUM = {
    "AMT_ANNUITY": ["min", "max", "mean"],
    "AMT_APPLICATION": ["min", "max", "mean"],
    "AMT_CREDIT": ["min", "max", "mean"],
    "APP_CREDIT_PERC": ["min", "max", "mean", "var"],
    "AMT_DOWN_PAYMENT": ["min", "max", "mean"],
    "AMT_GOODS_PRICE": ["min", "max", "mean"],
    "HOUR_APPR_PROCESS_START": ["min", "max", "mean"],
    "RATE_DOWN_PAYMENT": ["min", "max", "mean"],
    "DAYS_DECISION": ["min", "max", "mean"],
    "CNT_PAYMENT": ["mean", "sum"],
}
POS_NUM = {
    "MONTHS_BALANCE": ["max", "mean", "size"],
    "SK_DPD": ["max", "mean"],
    "SK_DPD_DEF": ["max", "mean"],
}
INSTAL_NUM = {
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "DPD": ["max", "mean", "sum"],
    "DBD": ["max", "mean", "sum"],
    "PAYMENT_PERC": ["max", "mean", "sum", "var"],
    "PAYMENT_DIFF": ["max", "mean", "sum", "var"],
    "AMT_INSTALMENT": ["max", "mean", "sum"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "DAYS_ENTRY_PAYMENT": ["max", "mean", "sum"],
}
CARD_STATS = ["min", "max", "mean", "sum", "var"]
CARD_INDICATOR_STATS = ["mean", "sum", "var"]
SENTINEL_COLUMNS_PREVIOUS = ["DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION",
                             "DAYS_LAST_DUE", "DAYS_TERMINATION"]
BINARY_APPLICATION = ["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY"]
# Characters replaced by "_" in the final column names.
NAME_CHARS = "[ ,:]"

Catalogue = dict[str, dict[str, list[str]]]

# Category catalogue of the stand-in tables (fixed output schema; an unseen
# category encodes as all zeros). ``tests/test_features.py`` checks it against
# ``fit_catalogue`` on the data.
CATALOGUE = {
    "application": {"NAME_CONTRACT_TYPE": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]},
    "bureau": {
        "CREDIT_ACTIVE": ["Active", "Closed", "Sold"],
        "CREDIT_CURRENCY": ["currency 1", "currency 2"],
        "CREDIT_TYPE": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    },
    "bureau_balance": {"STATUS": ["F", "O", "X"]},
    "previous_application": {
        "NAME_CONTRACT_STATUS": ["Approved", "Canceled", "Refused"],
        "NAME_PORTFOLIO": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    },
    "pos_cash": {"NAME_CONTRACT_STATUS": ["click", "error", "purchase", "signup", "view"]},
    "card_balance": {"NAME_CONTRACT_STATUS": ["A", "N", "R"]},
}


def _ref(name: str):
    return F.col(f"`{name}`")


def _dealt(df: DataFrame) -> DataFrame:
    """The rows hash-partitioned by the customer key, for an aggregate of many statistics.

    A customer's few rows are spread over many tasks, so partial aggregates would hardly combine anything before the
    shuffle, and the buffers of a hundred statistics are over ten times as wide as the row they come from. The rows are
    shuffled instead, before their categories are spread over indicators; the aggregate then needs no shuffle of its own.
    """
    return df.repartition(F.col(KEY))


# ---------------------------------------------------------------- application
def application_features(app: DataFrame, catalogue: Catalogue = CATALOGUE) -> DataFrame:
    """Junk filter (NULL kept), first-seen codes for binary columns, one-hot without
    a missing indicator, sentinel -> NULL, five ratio columns."""
    df = app.filter(ne_null_safe("CODE_GENDER", "XNA"))
    order = ["_test", KEY]
    df = df.withColumn("_test", F.col("TARGET").isNull().cast("int"))
    df = factorize_few(df, BINARY_APPLICATION, order).drop("_test")
    df, _ = one_hot(df, catalogue["application"], nan_as_category=False)
    df = df.withColumn("DAYS_EMPLOYED", sentinel_to_null("DAYS_EMPLOYED"))
    return df.select(
        "*",
        safe_ratio("DAYS_EMPLOYED", "DAYS_BIRTH").alias("DAYS_EMPLOYED_PERC"),
        safe_ratio("AMT_INCOME_TOTAL", "AMT_CREDIT").alias("INCOME_CREDIT_PERC"),
        safe_ratio("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS").alias("INCOME_PER_PERSON"),
        safe_ratio("AMT_ANNUITY", "AMT_INCOME_TOTAL").alias("ANNUITY_INCOME_PERC"),
        safe_ratio("AMT_ANNUITY", "AMT_CREDIT").alias("PAYMENT_RATE"),
    )


# ---------------------------------------------------------------- bureau
def bureau_accounts(bureau: DataFrame, balance: DataFrame, catalogue: Catalogue = CATALOGUE) -> tuple[DataFrame, list[str], list[str]]:
    """Accounts with one-hot categories and their monthly-balance aggregates.

    Returns the frame, the bureau indicator names and the balance share names.
    """
    bb, bb_cat = one_hot(balance, catalogue["bureau_balance"], nan_as_category=True)
    bb_spec = dict(BUREAU_BALANCE_NUM, **{c: ["mean"] for c in bb_cat})
    bb_agg = aggregate(bb, "SK_ID_BUREAU", bb_spec)
    accounts = _dealt(bureau.join(bb_agg, "SK_ID_BUREAU", "left").drop("SK_ID_BUREAU"))
    accounts, b_cat = one_hot(accounts, catalogue["bureau"], nan_as_category=True)
    return accounts, b_cat, [f"{c}_MEAN" for c in bb_cat]


def bureau_features(bureau: DataFrame, balance: DataFrame, catalogue: Catalogue = CATALOGUE) -> DataFrame:
    """``BURO_`` aggregates plus ``ACTIVE_`` / ``CLOSED_`` sub-populations, one pass."""
    accounts, b_cat, bb_share = bureau_accounts(bureau, balance, catalogue)
    spec = dict(BUREAU_NUM, **{c: ["mean"] for c in b_cat + bb_share})
    return accounts.groupBy(KEY).agg(
        *agg_columns(spec, "BURO_"),
        *agg_columns(BUREAU_NUM, "ACTIVE_", where="`CREDIT_ACTIVE_Active` = 1"),
        *agg_columns(BUREAU_NUM, "CLOSED_", where="`CREDIT_ACTIVE_Closed` = 1"),
    )


def bureau_subpopulations(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """``ACTIVE_`` / ``CLOSED_`` aggregates in one conditional aggregation."""
    accounts, _, _ = bureau_accounts(bureau, balance)
    return accounts.groupBy(KEY).agg(
        *agg_columns(BUREAU_NUM, "ACTIVE_", where="`CREDIT_ACTIVE_Active` = 1"),
        *agg_columns(BUREAU_NUM, "CLOSED_", where="`CREDIT_ACTIVE_Closed` = 1"),
    )


def bureau_subpopulations_joined(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Same result as separate filtered aggregates left-joined on the key (J3 shape)."""
    accounts, _, _ = bureau_accounts(bureau, balance)
    keys = accounts.select(KEY).distinct()
    active = aggregate(accounts.filter(_ref("CREDIT_ACTIVE_Active") == 1), KEY, BUREAU_NUM, "ACTIVE_")
    closed = aggregate(accounts.filter(_ref("CREDIT_ACTIVE_Closed") == 1), KEY, BUREAU_NUM, "CLOSED_")
    return keys.join(active, KEY, "left").join(closed, KEY, "left")


# ---------------------------------------------------------------- previous applications
def previous_features(prev: DataFrame, catalogue: Catalogue = CATALOGUE) -> DataFrame:
    df, cat = one_hot(_dealt(prev), catalogue["previous_application"], nan_as_category=True)
    for col in SENTINEL_COLUMNS_PREVIOUS:
        df = df.withColumn(col, sentinel_to_null(col))
    df = df.withColumn("APP_CREDIT_PERC", safe_ratio("AMT_APPLICATION", "AMT_CREDIT"))
    spec = dict(PREVIOUS_NUM, **{c: ["mean"] for c in cat})
    return df.groupBy(KEY).agg(
        *agg_columns(spec, "PREV_"),
        *agg_columns(PREVIOUS_NUM, "APPROVED_", where="`NAME_CONTRACT_STATUS_Approved` = 1"),
        *agg_columns(PREVIOUS_NUM, "REFUSED_", where="`NAME_CONTRACT_STATUS_Refused` = 1"),
    )


# ---------------------------------------------------------------- POS / cash
def pos_features(pos: DataFrame, catalogue: Catalogue = CATALOGUE) -> DataFrame:
    df, cat = one_hot(_dealt(pos), catalogue["pos_cash"], nan_as_category=True)
    spec = dict(POS_NUM, **{c: ["mean"] for c in cat})
    return df.groupBy(KEY).agg(*agg_columns(spec, "POS_"), F.count(F.lit(1)).alias("POS_COUNT"))


# ---------------------------------------------------------------- instalments
def instalment_columns(ins: DataFrame) -> DataFrame:
    return ins.select(
        "*",
        safe_ratio("AMT_PAYMENT", "AMT_INSTALMENT").alias("PAYMENT_PERC"),
        (F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT")).alias("PAYMENT_DIFF"),
        clip_low(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")).alias("DPD"),
        clip_low(F.col("DAYS_INSTALMENT") - F.col("DAYS_ENTRY_PAYMENT")).alias("DBD"),
    )


def instalment_features(ins: DataFrame) -> DataFrame:
    df = instalment_columns(_dealt(ins))
    return df.groupBy(KEY).agg(*agg_columns(INSTAL_NUM, "INSTAL_"), F.count(F.lit(1)).alias("INSTAL_COUNT"))


# ---------------------------------------------------------------- credit card
def card_spec(card: DataFrame, catalogue: Catalogue = CATALOGUE) -> tuple[dict[str, list[str]], list[str]]:
    cols = [c for c in card.columns if c not in (KEY, "SK_ID_PREV", "NAME_CONTRACT_STATUS")]
    cat = [indicator_name("NAME_CONTRACT_STATUS", v) for v in catalogue["card_balance"]["NAME_CONTRACT_STATUS"]]
    cat.append(indicator_name("NAME_CONTRACT_STATUS", None))
    spec = {c: CARD_STATS for c in cols}
    spec.update({c: CARD_INDICATOR_STATS for c in cat})
    return spec, cat


def card_features(card: DataFrame, catalogue: Catalogue = CATALOGUE) -> DataFrame:
    """Five statistics of every numeric column, mean/sum/var of the indicators."""
    spec, _ = card_spec(card, catalogue)
    df, _ = one_hot(_dealt(card.drop("SK_ID_PREV")), catalogue["card_balance"], nan_as_category=True)
    return df.groupBy(KEY).agg(*agg_columns(spec, "CC_"), F.count(F.lit(1)).alias("CC_COUNT"))


# ---------------------------------------------------------------- full table
def sanitise_name(name: str) -> str:
    return re.sub(NAME_CHARS, "_", name)


def sanitise_columns(df: DataFrame) -> DataFrame:
    new = [sanitise_name(c) for c in df.columns]
    if len(set(new)) != len(new):
        dup = sorted({n for n in new if new.count(n) > 1})
        raise ValueError(f"column names collide after sanitising: {dup}")
    return df.toDF(*new)


def feature_table(app: DataFrame, bureau: DataFrame, balance: DataFrame, prev: DataFrame,
                  pos: DataFrame, ins: DataFrame, card: DataFrame, finish=None,
                  catalogue: Catalogue = CATALOGUE) -> DataFrame:
    """One row per application; aggregates joined left so the row count is unchanged.

    Names are sanitised and ±inf / NaN become NULL in one final projection;
    ``finish`` (SQL text -> SQL text) is applied to every double column in the same
    projection. The categories are those of ``catalogue``, as stored by ``operators.catalogue``.
    """
    df = application_features(app, catalogue)
    for part in (bureau_features(bureau, balance, catalogue), previous_features(prev, catalogue), pos_features(pos, catalogue),
                 instalment_features(ins), card_features(card, catalogue)):
        df = df.join(part, KEY, "left")
    names = [sanitise_name(c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("column names collide after sanitising")
    # one projection built from SQL text: a single JVM call for a few hundred columns
    exprs = []
    for (name, dtype), new in zip(df.dtypes, names):
        e = f"`{name}`"
        if dtype in ("double", "float"):
            e = f"CASE WHEN isnan({e}) OR abs({e}) = double('inf') THEN NULL ELSE CAST({e} AS DOUBLE) END"
            if finish is not None:
                e = finish(e)
        exprs.append(f"{e} AS `{new}`")
    return df.selectExpr(*exprs)


def feature_family_sizes() -> dict[str, int]:
    """Number of generated columns per family for the stand-in catalogue."""
    b_cat = sum(len(v) + 1 for v in CATALOGUE["bureau"].values())
    bb_cat = len(CATALOGUE["bureau_balance"]["STATUS"]) + 1
    p_cat = sum(len(v) + 1 for v in CATALOGUE["previous_application"].values())
    pos_cat = len(CATALOGUE["pos_cash"]["NAME_CONTRACT_STATUS"]) + 1
    n = lambda spec: len(output_names(spec))
    return {
        "BURO_": n(BUREAU_NUM) + b_cat + bb_cat,
        "ACTIVE_": n(BUREAU_NUM), "CLOSED_": n(BUREAU_NUM),
        "PREV_": n(PREVIOUS_NUM) + p_cat,
        "APPROVED_": n(PREVIOUS_NUM), "REFUSED_": n(PREVIOUS_NUM),
        "POS_": n(POS_NUM) + pos_cat + 1,
        "INSTAL_": n(INSTAL_NUM) + 1,
    }
