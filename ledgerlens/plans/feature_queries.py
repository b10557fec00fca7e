"""Registered feature queries (feature table and its blocks) with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.functions.columns import inf_to_null_all
from ledgerlens.functions.rounding import stable_doubles
from ledgerlens.operators.aggregate import aggregate, sql_agg_columns
from ledgerlens.operators.catalogue import read_catalogue, store_catalogue, unseen_categories
from ledgerlens.plans import feature_sql as FS
from ledgerlens.plans import features as FT
from ledgerlens.plans.registry import register
from ledgerlens.session import shared_path
from ledgerlens.sources import roles
from ledgerlens.sources.tables import scan


def _out(df):
    return stable_doubles(inf_to_null_all(FT.sanitise_columns(df)))


def _subpop_on_applications():
    ctes, cols, name = FS.subpopulation_block()
    ctes = ctes[:-1] + [
        f"appk AS (SELECT SK_ID_CURR FROM ({roles.SQL['application']}))",
        "sub AS (SELECT appk.SK_ID_CURR, buro_act.* EXCLUDE (SK_ID_CURR), buro_clo.* EXCLUDE (SK_ID_CURR) "
        "FROM appk LEFT JOIN buro_act USING (SK_ID_CURR) LEFT JOIN buro_clo USING (SK_ID_CURR))"]
    return ctes, cols, name


@register("features_subpopulation", FS.block_query(lambda: _subpop_on_applications()))
def features_subpopulation(spark, d):
    """ACTIVE_/CLOSED_ account aggregates in one conditional pass, left-joined to every application."""
    sub = FT.bureau_subpopulations(roles.bureau(spark, d), roles.bureau_balance(spark, d))
    keys = roles.application(spark, d).select(FT.KEY)
    return _out(keys.join(sub, FT.KEY, "left"))


@register("subpopulation_join", FS.block_query(FS.subpopulation_block))
def subpopulation_join(spark, d):
    """Separate filtered aggregates left-joined on the customer key (J3 shape)."""
    return _out(FT.bureau_subpopulations_joined(roles.bureau(spark, d), roles.bureau_balance(spark, d)))


@register("features_bureau", FS.block_query(FS.bureau_block))
def features_bureau(spark, d):
    return _out(FT.bureau_features(roles.bureau(spark, d), roles.bureau_balance(spark, d)))


@register("features_previous", FS.block_query(FS.previous_block))
def features_previous(spark, d):
    return _out(FT.previous_features(roles.previous_application(spark, d)))


@register("features_pos", FS.block_query(FS.pos_block))
def features_pos(spark, d):
    return _out(FT.pos_features(roles.pos_cash(spark, d)))


@register("features_instalments", FS.block_query(FS.instalment_block))
def features_instalments(spark, d):
    return _out(FT.instalment_features(roles.installments(spark, d)))


@register("features_all_columns", FS.block_query(FS.card_block))
def features_all_columns(spark, d):
    return _out(FT.card_features(roles.card_balance(spark, d)))


@register("features_bureau_fitted", FS.block_query(FS.bureau_block))
def features_bureau_fitted(spark, d):
    """The account features with the categories of a stored catalogue, fitted on all accounts."""
    bureau, balance = roles.bureau(spark, d), roles.bureau_balance(spark, d)
    path = shared_path(spark, f"catalogue-{uuid.uuid4().hex}")
    store_catalogue(spark, {"bureau": (bureau, list(FT.CATALOGUE["bureau"])),
                            "bureau_balance": (balance, list(FT.CATALOGUE["bureau_balance"]))}, path, "all")
    return _out(FT.bureau_features(bureau, balance, read_catalogue(spark, path, "all")))


# the catalogue of the report knows the accounts opened before a day, and the customers of the labelled nations
FITTED_DAYS = -1800
_STACKED = """
SELECT 'bureau' AS "table", DAYS_CREDIT < {days} AS fitted, unnest(['CREDIT_ACTIVE', 'CREDIT_CURRENCY', 'CREDIT_TYPE']) AS "column",
       unnest([CREDIT_ACTIVE, CREDIT_CURRENCY, CREDIT_TYPE]) AS value FROM ({bureau})
UNION ALL SELECT 'application', TARGET IS NOT NULL, 'CODE_GENDER', CODE_GENDER FROM ({application})
UNION ALL SELECT 'customer', c_nationkey < 20, unnest(['c_mktsegment', 'n_name']), unnest([c_mktsegment, n_name])
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""


@register("unseen_categories", f"""
WITH stacked AS ({_STACKED.format(days=FITTED_DAYS, bureau=roles.SQL['bureau'], application=roles.SQL['application'])}),
known AS (SELECT DISTINCT "table", "column", value FROM stacked WHERE fitted AND value IS NOT NULL)
SELECT s."table", s."column", count(*) AS n_rows, count(*) - count(s.value) AS n_missing,
       count(*) FILTER (WHERE s.value IS NOT NULL AND k.value IS NULL) AS n_unseen,
       count(DISTINCT s.value) FILTER (WHERE s.value IS NOT NULL AND k.value IS NULL) AS n_unseen_values,
       min(s.value) FILTER (WHERE s.value IS NOT NULL AND k.value IS NULL) AS first_unseen
FROM stacked s LEFT JOIN known k ON s."table" = k."table" AND s."column" = k."column" AND s.value = k.value
GROUP BY ALL""")
def report_unseen(spark, d):
    """Rows of all tables whose category a catalogue, stored from early accounts and customers of some nations, does not know."""
    nations = scan(spark, d, "nation", ["n_nationkey", "n_name"])
    customers = scan(spark, d, "customer", ["c_nationkey", "c_mktsegment"])
    customers = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    tables = {"bureau": (roles.bureau(spark, d), F.col("DAYS_CREDIT") < FITTED_DAYS, list(FT.CATALOGUE["bureau"])),
              "application": (roles.application(spark, d), F.col("TARGET").isNotNull(), ["CODE_GENDER"]),
              "customer": (customers, F.col("c_nationkey") < 20, ["c_mktsegment", "n_name"])}
    path = shared_path(spark, f"catalogue-{uuid.uuid4().hex}")
    store_catalogue(spark, {t: (df.filter(fitted), columns) for t, (df, fitted, columns) in tables.items()}, path, "early")
    catalogue = read_catalogue(spark, path, "early")
    out = None
    for table, (df, _, _) in tables.items():
        found = unseen_categories(df, catalogue[table]).withColumn("table", F.lit(table))
        out = found if out is None else out.unionByName(found)
    return out


def build_feature_table(spark, d, finish=None):
    return FT.feature_table(roles.application(spark, d), roles.bureau(spark, d), roles.bureau_balance(spark, d),
                            roles.previous_application(spark, d), roles.pos_cash(spark, d),
                            roles.installments(spark, d), roles.card_balance(spark, d), finish=finish)


@register("feature_table", FS.feature_table_query())
def feature_table(spark, d):
    """The full customer feature table (flagship)."""
    return build_feature_table(spark, d, finish=lambda e: f"CAST(CAST({e} AS FLOAT) AS DOUBLE)")


# A1: the dictionary aggregation with every statistic it supports.
AGG_DICTIONARY_SPEC = {
    "AMT_INSTALMENT": ["min", "max", "mean", "var", "sum", "size", "nunique"],
    "DAYS_ENTRY_PAYMENT": ["min", "max", "mean", "var", "sum", "nunique"],
    "NUM_INSTALMENT_VERSION": ["nunique"],
}


@register("agg_dictionary", FS.block_query(lambda: (
    [f"ins AS ({roles.SQL['installments']})",
     f"a AS (SELECT SK_ID_CURR, {', '.join(sql_agg_columns(AGG_DICTIONARY_SPEC, 'INS_'))} FROM ins GROUP BY SK_ID_CURR)"],
    FS._spec_cols(AGG_DICTIONARY_SPEC, "INS_"), "a")))
def agg_dictionary(spark, d):
    return stable_doubles(aggregate(roles.installments(spark, d), FT.KEY, AGG_DICTIONARY_SPEC, "INS_"))


@register("group_size", f"""WITH ins AS ({roles.SQL['installments']})
SELECT SK_ID_CURR, count(*) AS n_rows, count(DISTINCT SK_ID_PREV) AS n_accounts FROM ins GROUP BY SK_ID_CURR""")
def group_size(spark, d):
    """Rows per customer (pandas ``size``) and accounts per customer."""
    return roles.installments(spark, d).groupBy(FT.KEY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("SK_ID_PREV").alias("n_accounts"))
