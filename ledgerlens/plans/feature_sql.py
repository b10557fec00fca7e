"""DuckDB text of the feature builds, rendered from the same fixed specifications.

Used only by the oracles: it restates the feature semantics in plain SQL
(separate filtered aggregates and explicit CASE encoders) so that the Spark
builders are checked against an independent formulation.
"""

from __future__ import annotations

from ledgerlens.functions.rounding import sql_round_sig
from ledgerlens.operators.aggregate import _q, output_name, sql_agg_columns
from ledgerlens.operators.encode import indicator_name
from ledgerlens.plans import features as FT
from ledgerlens.sources import roles

ROLE_COLUMNS = {
    "bureau": ["SK_ID_BUREAU", "SK_ID_CURR", "CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE",
               "DAYS_CREDIT", "DAYS_CREDIT_ENDDATE", "DAYS_CREDIT_UPDATE", "CREDIT_DAY_OVERDUE",
               "AMT_CREDIT_MAX_OVERDUE", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT",
               "AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM_LIMIT", "AMT_ANNUITY", "CNT_CREDIT_PROLONG"],
    "card_numeric": ["MONTHS_BALANCE", "AMT_BALANCE", "AMT_DRAWINGS_CURRENT", "CNT_DRAWINGS_CURRENT", "SK_DPD"],
}


def one_hot_sql(catalogue: dict[str, list[str]], nan: bool) -> tuple[list[str], list[str]]:
    """Select-list items and names of the indicators."""
    items, names = [], []
    for col, values in catalogue.items():
        for v in values:
            n = indicator_name(col, v)
            items.append(f"CASE WHEN {_q(col)} = '{v}' THEN 1 ELSE 0 END AS {_q(n)}")
            names.append(n)
        if nan:
            n = indicator_name(col, None)
            items.append(f"CASE WHEN {_q(col)} IS NULL THEN 1 ELSE 0 END AS {_q(n)}")
            names.append(n)
    return items, names


def ratio_sql(a: str, b: str) -> str:
    return (f"CASE WHEN {b} IS NULL OR {a} IS NULL THEN NULL WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / {b} "
            f"WHEN {a} > 0 THEN CAST('inf' AS DOUBLE) WHEN {a} < 0 THEN CAST('-inf' AS DOUBLE) ELSE NULL END")


def clip_low_sql(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN 0.0 ELSE {x} END"


def clean_sql(x: str) -> str:
    """inf/NaN -> NULL, then significant-digit rounding."""
    return sql_round_sig(f"CASE WHEN isinf({x}) OR isnan({x}) THEN NULL ELSE {x} END")


# ---------------------------------------------------------------- blocks: (ctes, [(name, kind)])
def application_block():
    cat_items, cat_names = one_hot_sql(FT.CATALOGUE["application"], nan=False)
    ctes = [f"app AS ({roles.SQL['application']})",
            "app_f AS (SELECT *, CASE WHEN TARGET IS NULL THEN 1 ELSE 0 END AS _test FROM app "
            "WHERE CODE_GENDER IS DISTINCT FROM 'XNA')"]
    joins, code_cols = [], []
    for i, col in enumerate(FT.BINARY_APPLICATION):
        ctes.append(f"code{i} AS (SELECT {col} AS v, dense_rank() OVER (ORDER BY min({{'t': _test, 'k': SK_ID_CURR}})) - 1 AS code "
                    f"FROM app_f WHERE {col} IS NOT NULL GROUP BY {col})")
        joins.append(f"LEFT JOIN code{i} ON app_f.{col} = code{i}.v")
        code_cols.append(f"coalesce(code{i}.code, -1) AS {col}")
    de = "CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE DAYS_EMPLOYED END"
    ratios = [(ratio_sql(de, "DAYS_BIRTH"), "DAYS_EMPLOYED_PERC"),
              (ratio_sql("AMT_INCOME_TOTAL", "AMT_CREDIT"), "INCOME_CREDIT_PERC"),
              (ratio_sql("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"), "INCOME_PER_PERSON"),
              (ratio_sql("AMT_ANNUITY", "AMT_INCOME_TOTAL"), "ANNUITY_INCOME_PERC"),
              (ratio_sql("AMT_ANNUITY", "AMT_CREDIT"), "PAYMENT_RATE")]
    select = (["SK_ID_CURR", "TARGET"] + code_cols +
              ["DAYS_BIRTH", f"{de} AS DAYS_EMPLOYED", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY",
               "CNT_FAM_MEMBERS"] + cat_items + [f"{e} AS {n}" for e, n in ratios])
    ctes.append(f"app_x AS (SELECT {', '.join(select)} FROM app_f {' '.join(joins)})")
    cols = ([("SK_ID_CURR", "bigint"), ("TARGET", "int")] + [(c, "bigint") for c in FT.BINARY_APPLICATION] +
            [("DAYS_BIRTH", "bigint"), ("DAYS_EMPLOYED", "bigint")] +
            [(c, "double") for c in ("AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "CNT_FAM_MEMBERS")] +
            [(c, "int") for c in cat_names] + [(n, "double") for _, n in ratios])
    return ctes, cols, "app_x"


def _spec_cols(spec, prefix):
    return [(output_name(prefix, c, s), "bigint" if s in ("size", "nunique") else "double")
            for c, stats in spec.items() for s in stats]


def bureau_accounts_ctes():
    bb_items, bb_names = one_hot_sql(FT.CATALOGUE["bureau_balance"], nan=True)
    b_items, b_names = one_hot_sql(FT.CATALOGUE["bureau"], nan=True)
    bb_spec = dict(FT.BUREAU_BALANCE_NUM, **{c: ["mean"] for c in bb_names})
    b_num = [c for c in ROLE_COLUMNS["bureau"] if c not in FT.CATALOGUE["bureau"]]
    bb_out = [output_name("", c, s) for c, st in bb_spec.items() for s in st]
    ctes = [
        f"bb AS ({roles.SQL['bureau_balance']})",
        f"bb_oh AS (SELECT SK_ID_BUREAU, MONTHS_BALANCE, {', '.join(bb_items)} FROM bb)",
        f"bb_agg AS (SELECT SK_ID_BUREAU, {', '.join(sql_agg_columns(bb_spec))} FROM bb_oh GROUP BY SK_ID_BUREAU)",
        f"bur AS ({roles.SQL['bureau']})",
        f"bur_oh AS (SELECT {', '.join(b_num)}, {', '.join(b_items)} FROM bur)",
        "accounts AS (SELECT bur_oh.*, " + ", ".join(f"bb_agg.{_q(c)}" for c in bb_out) +
        " FROM bur_oh LEFT JOIN bb_agg ON bur_oh.SK_ID_BUREAU = bb_agg.SK_ID_BUREAU)",
    ]
    return ctes, b_names, [f"{c}_MEAN" for c in bb_names]


def bureau_block():
    ctes, b_names, bb_share = bureau_accounts_ctes()
    spec = dict(FT.BUREAU_NUM, **{c: ["mean"] for c in b_names + bb_share})
    ctes += [
        f"buro_all AS (SELECT SK_ID_CURR, {', '.join(sql_agg_columns(spec, 'BURO_'))} FROM accounts GROUP BY SK_ID_CURR)",
        f"buro_act AS (SELECT SK_ID_CURR, {', '.join(sql_agg_columns(FT.BUREAU_NUM, 'ACTIVE_'))} "
        f"FROM accounts WHERE \"CREDIT_ACTIVE_Active\" = 1 GROUP BY SK_ID_CURR)",
        f"buro_clo AS (SELECT SK_ID_CURR, {', '.join(sql_agg_columns(FT.BUREAU_NUM, 'CLOSED_'))} "
        f"FROM accounts WHERE \"CREDIT_ACTIVE_Closed\" = 1 GROUP BY SK_ID_CURR)",
        "buro AS (SELECT buro_all.*, buro_act.* EXCLUDE (SK_ID_CURR), buro_clo.* EXCLUDE (SK_ID_CURR) "
        "FROM buro_all LEFT JOIN buro_act USING (SK_ID_CURR) LEFT JOIN buro_clo USING (SK_ID_CURR))",
    ]
    cols = _spec_cols(spec, "BURO_") + _spec_cols(FT.BUREAU_NUM, "ACTIVE_") + _spec_cols(FT.BUREAU_NUM, "CLOSED_")
    return ctes, cols, "buro"


def subpopulation_block():
    ctes, _, _ = bureau_accounts_ctes()
    ctes += [
        f"buro_act AS (SELECT SK_ID_CURR, {', '.join(sql_agg_columns(FT.BUREAU_NUM, 'ACTIVE_'))} "
        f"FROM accounts WHERE \"CREDIT_ACTIVE_Active\" = 1 GROUP BY SK_ID_CURR)",
        f"buro_clo AS (SELECT SK_ID_CURR, {', '.join(sql_agg_columns(FT.BUREAU_NUM, 'CLOSED_'))} "
        f"FROM accounts WHERE \"CREDIT_ACTIVE_Closed\" = 1 GROUP BY SK_ID_CURR)",
        "sub AS (SELECT k.SK_ID_CURR, buro_act.* EXCLUDE (SK_ID_CURR), buro_clo.* EXCLUDE (SK_ID_CURR) "
        "FROM (SELECT DISTINCT SK_ID_CURR FROM accounts) k LEFT JOIN buro_act USING (SK_ID_CURR) "
        "LEFT JOIN buro_clo USING (SK_ID_CURR))",
    ]
    cols = [("SK_ID_CURR", "bigint")] + _spec_cols(FT.BUREAU_NUM, "ACTIVE_") + _spec_cols(FT.BUREAU_NUM, "CLOSED_")
    return ctes, cols, "sub"


def previous_block():
    items, names = one_hot_sql(FT.CATALOGUE["previous_application"], nan=True)
    spec = dict(FT.PREVIOUS_NUM, **{c: ["mean"] for c in names})
    num = ["SK_ID_CURR", "AMT_ANNUITY", "AMT_APPLICATION", "AMT_CREDIT", "AMT_DOWN_PAYMENT",
           "AMT_GOODS_PRICE", "HOUR_APPR_PROCESS_START", "RATE_DOWN_PAYMENT", "DAYS_DECISION", "CNT_PAYMENT"]
    ctes = [
        f"prev_raw AS ({roles.SQL['previous_application']})",
        f"prev AS (SELECT {', '.join(num)}, {', '.join(items)}, "
        f"{ratio_sql('AMT_APPLICATION', 'AMT_CREDIT')} AS APP_CREDIT_PERC FROM prev_raw)",
        f"prev_all AS (SELECT SK_ID_CURR, {', '.join(sql_agg_columns(spec, 'PREV_'))} FROM prev GROUP BY SK_ID_CURR)",
        f"prev_app AS (SELECT SK_ID_CURR, {', '.join(sql_agg_columns(FT.PREVIOUS_NUM, 'APPROVED_'))} "
        f"FROM prev WHERE \"NAME_CONTRACT_STATUS_Approved\" = 1 GROUP BY SK_ID_CURR)",
        f"prev_ref AS (SELECT SK_ID_CURR, {', '.join(sql_agg_columns(FT.PREVIOUS_NUM, 'REFUSED_'))} "
        f"FROM prev WHERE \"NAME_CONTRACT_STATUS_Refused\" = 1 GROUP BY SK_ID_CURR)",
        "prevf AS (SELECT prev_all.*, prev_app.* EXCLUDE (SK_ID_CURR), prev_ref.* EXCLUDE (SK_ID_CURR) "
        "FROM prev_all LEFT JOIN prev_app USING (SK_ID_CURR) LEFT JOIN prev_ref USING (SK_ID_CURR))",
    ]
    cols = _spec_cols(spec, "PREV_") + _spec_cols(FT.PREVIOUS_NUM, "APPROVED_") + _spec_cols(FT.PREVIOUS_NUM, "REFUSED_")
    return ctes, cols, "prevf"


def pos_block():
    items, names = one_hot_sql(FT.CATALOGUE["pos_cash"], nan=True)
    spec = dict(FT.POS_NUM, **{c: ["mean"] for c in names})
    ctes = [
        f"pos_raw AS ({roles.SQL['pos_cash']})",
        f"pos AS (SELECT SK_ID_CURR, MONTHS_BALANCE, SK_DPD, SK_DPD_DEF, {', '.join(items)} FROM pos_raw)",
        f"posf AS (SELECT SK_ID_CURR, {', '.join(sql_agg_columns(spec, 'POS_'))}, count(*) AS POS_COUNT "
        "FROM pos GROUP BY SK_ID_CURR)",
    ]
    return ctes, _spec_cols(spec, "POS_") + [("POS_COUNT", "bigint")], "posf"


def instalment_block():
    ctes = [
        f"ins_raw AS ({roles.SQL['installments']})",
        "ins AS (SELECT *, " + ratio_sql("AMT_PAYMENT", "AMT_INSTALMENT") + " AS PAYMENT_PERC, "
        "AMT_INSTALMENT - AMT_PAYMENT AS PAYMENT_DIFF, "
        f"{clip_low_sql('DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT')} AS DPD, "
        f"{clip_low_sql('DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT')} AS DBD FROM ins_raw)",
        f"insf AS (SELECT SK_ID_CURR, {', '.join(sql_agg_columns(FT.INSTAL_NUM, 'INSTAL_'))}, "
        "count(*) AS INSTAL_COUNT FROM ins GROUP BY SK_ID_CURR)",
    ]
    return ctes, _spec_cols(FT.INSTAL_NUM, "INSTAL_") + [("INSTAL_COUNT", "bigint")], "insf"


def card_block():
    items, names = one_hot_sql(FT.CATALOGUE["card_balance"], nan=True)
    spec = {c: FT.CARD_STATS for c in ROLE_COLUMNS["card_numeric"]}
    spec.update({c: FT.CARD_INDICATOR_STATS for c in names})
    ctes = [
        f"cc_raw AS ({roles.SQL['card_balance']})",
        f"cc AS (SELECT SK_ID_CURR, {', '.join(ROLE_COLUMNS['card_numeric'])}, {', '.join(items)} FROM cc_raw)",
        f"ccf AS (SELECT SK_ID_CURR, {', '.join(sql_agg_columns(spec, 'CC_'))}, count(*) AS CC_COUNT "
        "FROM cc GROUP BY SK_ID_CURR)",
    ]
    return ctes, _spec_cols(spec, "CC_") + [("CC_COUNT", "bigint")], "ccf"


def final_select(cols: list[tuple[str, str]], source: str, key_first: bool = False) -> str:
    items = []
    for name, kind in cols:
        out = FT.sanitise_name(name)
        expr = clean_sql(f"{source}.{_q(name)}") if kind == "double" else f"{source}.{_q(name)}"
        items.append(f"{expr} AS {_q(out)}")
    return "SELECT " + ", ".join(items) + f" FROM {source}"


def block_query(block) -> str:
    """Stand-alone query of one aggregate block (key + its features)."""
    ctes, cols, name = block()
    if cols[0][0] != "SK_ID_CURR":
        cols = [("SK_ID_CURR", "bigint")] + cols
    return "WITH " + ",\n".join(ctes) + "\n" + final_select(cols, name)


def feature_table_query() -> str:
    blocks = [application_block(), bureau_block(), previous_block(), pos_block(), instalment_block(), card_block()]
    ctes, cols = [], []
    joins = []
    for i, (c, cl, name) in enumerate(blocks):
        ctes += c
        cols += [(n, k) for n, k in cl if not (i and n == "SK_ID_CURR")]
        if i:
            joins.append(f"LEFT JOIN {name} USING (SK_ID_CURR)")
    sel = ", ".join(["app_x.*"] + [f"{b[2]}.* EXCLUDE (SK_ID_CURR)" for b in blocks[1:]])
    ctes.append(f"ft AS (SELECT {sel} FROM app_x {' '.join(joins)})")
    return "WITH " + ",\n".join(ctes) + "\n" + final_select(cols, "ft")
