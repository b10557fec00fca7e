"""Stand-ins for the reference's input tables, derived from the driver tables.

Each role is a DataFrame builder with the reference's schema (FIXTURES.md) and
an SQL view text with exactly the same definition, used by the DuckDB oracles.
The mapping of driver columns to roles is a documented choice of this repo
(README, "Stand-in tables"); it contains no rounding so that both engines see
bit-identical inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.tables import scan

# Fixed values of the stand-ins (not from the reference): origin day for the
# relative day counts, the reference/production cut of the event log, the
# probability scale of the labelled orders, and the decision threshold.
DAY_ORIGIN = "1999-12-31"
WINDOW_CUT = "2024-01-16 00:00:00"
SCORE_SCALE = 500000.0
THRESHOLD = 0.1


def _days(ts_col: str) -> Column:
    return F.datediff(F.col(ts_col).cast("date"), F.lit(DAY_ORIGIN).cast("date")).cast("bigint")


def _sql_days(ts_col: str) -> str:
    return f"date_diff('day', DATE '{DAY_ORIGIN}', CAST({ts_col} AS DATE))"


def _json_k(c: str = "props") -> Column:
    return F.get_json_object(F.col(c), "$.k").cast("bigint")


_SQL_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

def _null_d() -> Column:
    return F.lit(None).cast("double")


# --------------------------------------------------------------------------- application
def _application_cols(with_target: bool) -> list[Column]:
    c = F.col
    cols = [c("c_custkey").alias("SK_ID_CURR")]
    if with_target:
        # a noisy label: the rate (percent) depends on a category, the balance and the days employed, the rest is a hash that
        # no feature holds
        noise = F.conv(F.substring(F.md5(F.concat(F.lit("label"), c("c_custkey").cast("string"))), 1, 6), 16, 10).cast("bigint") % 100
        rate = (F.when(c("c_mktsegment") == "BUILDING", 19).otherwise(4) + F.floor((9999 - c("c_acctbal")) / 275)
                + F.when(c("c_custkey") % 4000 < 400, 12).otherwise(0))
        cols.append(F.when(noise < rate, 1).otherwise(0).cast("int").alias("TARGET"))
    cols += [
        F.when((c("c_nationkey") == 3) & (c("c_mktsegment") == "MACHINERY"), "XNA")
         .when(c("c_nationkey") == 4, F.lit(None).cast("string"))
         .when(c("c_custkey") % 2 == 0, "F").otherwise("M").alias("CODE_GENDER"),
        F.when(c("c_acctbal") > 5000, "Y").otherwise("N").alias("FLAG_OWN_CAR"),
        F.when(c("c_nationkey") % 3 == 0, "N").otherwise("Y").alias("FLAG_OWN_REALTY"),
        F.when(c("c_nationkey") == 5, F.lit(None).cast("string"))
         .otherwise(c("c_mktsegment")).alias("NAME_CONTRACT_TYPE"),
        (-(F.lit(7000) + c("c_custkey") % 15000)).cast("bigint").alias("DAYS_BIRTH"),
        F.when(c("c_nationkey") == 0, F.lit(365243).cast("bigint"))
         .otherwise(-(c("c_custkey") % 4000)).cast("bigint").alias("DAYS_EMPLOYED"),
        (F.abs(c("c_acctbal")) * 10).alias("AMT_INCOME_TOTAL"),
        (c("c_acctbal") + 1000.0).alias("AMT_CREDIT"),
        F.when(c("c_nationkey") == 7, _null_d()).otherwise(F.abs(c("c_acctbal")) / 12).alias("AMT_ANNUITY"),
        (c("c_nationkey") % 4).cast("double").alias("CNT_FAM_MEMBERS"),
    ]
    return cols


def application_train(spark: SparkSession, d: str) -> DataFrame:
    cust = scan(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return cust.filter(F.col("c_nationkey") < 20).select(*_application_cols(True))


def application_test(spark: SparkSession, d: str) -> DataFrame:
    cust = scan(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return cust.filter(F.col("c_nationkey") >= 20).select(*_application_cols(False))


def application(spark: SparkSession, d: str) -> DataFrame:
    """Train and test applications, union by name (test has no TARGET)."""
    return application_train(spark, d).unionByName(application_test(spark, d), allowMissingColumns=True)


_APP_BODY = """
           CASE WHEN c_nationkey = 3 AND c_mktsegment = 'MACHINERY' THEN 'XNA'
                WHEN c_nationkey = 4 THEN NULL
                WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS CODE_GENDER,
           CASE WHEN c_acctbal > 5000 THEN 'Y' ELSE 'N' END AS FLAG_OWN_CAR,
           CASE WHEN c_nationkey % 3 = 0 THEN 'N' ELSE 'Y' END AS FLAG_OWN_REALTY,
           CASE WHEN c_nationkey = 5 THEN NULL ELSE c_mktsegment END AS NAME_CONTRACT_TYPE,
           CAST(-(7000 + c_custkey % 15000) AS BIGINT) AS DAYS_BIRTH,
           CAST(CASE WHEN c_nationkey = 0 THEN 365243 ELSE -(c_custkey % 4000) END AS BIGINT) AS DAYS_EMPLOYED,
           abs(c_acctbal) * 10 AS AMT_INCOME_TOTAL,
           c_acctbal + 1000.0 AS AMT_CREDIT,
           CASE WHEN c_nationkey = 7 THEN NULL ELSE abs(c_acctbal) / 12 END AS AMT_ANNUITY,
           CAST(c_nationkey % 4 AS DOUBLE) AS CNT_FAM_MEMBERS"""

SQL: dict[str, str] = {}
DEPS: dict[str, tuple[str, ...]] = {}

SQL["application"] = f"""
    SELECT c_custkey AS SK_ID_CURR, CAST(CASE WHEN CAST(('0x' || substr(md5('label' || CAST(c_custkey AS VARCHAR)), 1, 6)) AS BIGINT) % 100
                < CASE WHEN c_mktsegment = 'BUILDING' THEN 19 ELSE 4 END + CAST(floor((9999 - c_acctbal) / 275) AS BIGINT)
                  + CASE WHEN c_custkey % 4000 < 400 THEN 12 ELSE 0 END THEN 1 ELSE 0 END AS INTEGER) AS TARGET,{_APP_BODY}
    FROM customer WHERE c_nationkey < 20
    UNION ALL BY NAME
    SELECT c_custkey AS SK_ID_CURR,{_APP_BODY}
    FROM customer WHERE c_nationkey >= 20"""


# --------------------------------------------------------------------------- bureau (orders)
def bureau(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    o = scan(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                  "o_orderdate", "o_orderpriority"])
    days = _days("o_orderdate")
    return o.select(
        c("o_orderkey").alias("SK_ID_BUREAU"),
        c("o_custkey").alias("SK_ID_CURR"),
        F.when(c("o_orderstatus") == "O", "Active").when(c("o_orderstatus") == "F", "Closed")
         .otherwise("Sold").alias("CREDIT_ACTIVE"),
        F.when(c("o_orderkey") % 50 == 0, "currency 2").otherwise("currency 1").alias("CREDIT_CURRENCY"),
        c("o_orderpriority").alias("CREDIT_TYPE"),
        days.alias("DAYS_CREDIT"),
        F.when(c("o_orderstatus") == "O", _null_d()).otherwise((days + 365).cast("double")).alias("DAYS_CREDIT_ENDDATE"),
        (days + 30).alias("DAYS_CREDIT_UPDATE"),
        (c("o_orderkey") % 7).alias("CREDIT_DAY_OVERDUE"),
        F.when(c("o_orderkey") % 3 == 0, _null_d()).otherwise(c("o_totalprice") * 0.01).alias("AMT_CREDIT_MAX_OVERDUE"),
        c("o_totalprice").alias("AMT_CREDIT_SUM"),
        F.when(c("o_orderstatus") == "F", F.lit(0.0)).otherwise(c("o_totalprice") * 0.5).alias("AMT_CREDIT_SUM_DEBT"),
        F.when(c("o_orderkey") % 7 == 0, c("o_totalprice") * 0.02).otherwise(F.lit(0.0)).alias("AMT_CREDIT_SUM_OVERDUE"),
        F.when(c("o_orderstatus") == "P", _null_d()).otherwise(c("o_totalprice") * 0.1).alias("AMT_CREDIT_SUM_LIMIT"),
        (c("o_totalprice") / 12).alias("AMT_ANNUITY"),
        (c("o_orderkey") % 3).alias("CNT_CREDIT_PROLONG"),
    )


SQL["bureau"] = f"""
    SELECT o_orderkey AS SK_ID_BUREAU, o_custkey AS SK_ID_CURR,
           CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed' ELSE 'Sold' END AS CREDIT_ACTIVE,
           CASE WHEN o_orderkey % 50 = 0 THEN 'currency 2' ELSE 'currency 1' END AS CREDIT_CURRENCY,
           o_orderpriority AS CREDIT_TYPE,
           {_sql_days('o_orderdate')} AS DAYS_CREDIT,
           CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST({_sql_days('o_orderdate')} + 365 AS DOUBLE) END AS DAYS_CREDIT_ENDDATE,
           {_sql_days('o_orderdate')} + 30 AS DAYS_CREDIT_UPDATE,
           o_orderkey % 7 AS CREDIT_DAY_OVERDUE,
           CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice * 0.01 END AS AMT_CREDIT_MAX_OVERDUE,
           o_totalprice AS AMT_CREDIT_SUM,
           CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice * 0.5 END AS AMT_CREDIT_SUM_DEBT,
           CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 0.02 ELSE 0.0 END AS AMT_CREDIT_SUM_OVERDUE,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice * 0.1 END AS AMT_CREDIT_SUM_LIMIT,
           o_totalprice / 12 AS AMT_ANNUITY,
           o_orderkey % 3 AS CNT_CREDIT_PROLONG
    FROM orders"""


def bureau_balance(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    li = scan(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"])
    return li.select(
        c("l_orderkey").alias("SK_ID_BUREAU"),
        (-c("l_linenumber")).cast("bigint").alias("MONTHS_BALANCE"),
        F.when(c("l_returnflag") == "R", "X").otherwise(c("l_linestatus")).alias("STATUS"),
    )


SQL["bureau_balance"] = """
    SELECT l_orderkey AS SK_ID_BUREAU, CAST(-l_linenumber AS BIGINT) AS MONTHS_BALANCE,
           CASE WHEN l_returnflag = 'R' THEN 'X' ELSE l_linestatus END AS STATUS
    FROM lineitem"""


# --------------------------------------------------------------------------- previous applications
def previous_application(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    o = scan(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                  "o_orderdate", "o_orderpriority"])
    days = _days("o_orderdate")
    k5 = c("o_orderkey") % 5

    def drawn(slot: int, offset: int) -> Column:
        return F.when(k5 == slot, F.lit(365243.0)).otherwise((days + offset).cast("double"))

    return o.select(
        c("o_orderkey").alias("SK_ID_PREV"),
        c("o_custkey").alias("SK_ID_CURR"),
        F.when(c("o_orderstatus") == "F", "Approved").when(c("o_orderstatus") == "O", "Refused")
         .otherwise("Canceled").alias("NAME_CONTRACT_STATUS"),
        c("o_orderpriority").alias("NAME_PORTFOLIO"),
        F.when(c("o_orderkey") % 11 == 0, _null_d()).otherwise(c("o_totalprice") / 24).alias("AMT_ANNUITY"),
        c("o_totalprice").alias("AMT_APPLICATION"),
        F.when(c("o_orderkey") % 13 == 0, F.lit(0.0)).otherwise(c("o_totalprice") + (c("o_orderkey") % 100) * 100.0).alias("AMT_CREDIT"),
        F.when(c("o_orderstatus") == "P", _null_d()).otherwise(c("o_totalprice") * 0.05).alias("AMT_DOWN_PAYMENT"),
        (c("o_totalprice") * 0.9).alias("AMT_GOODS_PRICE"),
        (c("o_orderkey") % 24).alias("HOUR_APPR_PROCESS_START"),
        F.when(c("o_orderstatus") == "P", _null_d()).otherwise((c("o_orderkey") % 10) / 100.0).alias("RATE_DOWN_PAYMENT"),
        days.alias("DAYS_DECISION"),
        (c("o_orderkey") % 36).cast("double").alias("CNT_PAYMENT"),
        drawn(0, 10).alias("DAYS_FIRST_DRAWING"),
        drawn(1, 40).alias("DAYS_FIRST_DUE"),
        drawn(2, 400).alias("DAYS_LAST_DUE_1ST_VERSION"),
        drawn(3, 380).alias("DAYS_LAST_DUE"),
        drawn(4, 420).alias("DAYS_TERMINATION"),
    )


def _sql_drawn(slot: int, offset: int) -> str:
    return f"CASE WHEN o_orderkey % 5 = {slot} THEN 365243.0 ELSE CAST({_sql_days('o_orderdate')} + {offset} AS DOUBLE) END"


SQL["previous_application"] = f"""
    SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
           CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE 'Canceled' END AS NAME_CONTRACT_STATUS,
           o_orderpriority AS NAME_PORTFOLIO,
           CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 24 END AS AMT_ANNUITY,
           o_totalprice AS AMT_APPLICATION,
           CASE WHEN o_orderkey % 13 = 0 THEN 0.0 ELSE o_totalprice + (o_orderkey % 100) * 100.0 END AS AMT_CREDIT,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice * 0.05 END AS AMT_DOWN_PAYMENT,
           o_totalprice * 0.9 AS AMT_GOODS_PRICE,
           o_orderkey % 24 AS HOUR_APPR_PROCESS_START,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (o_orderkey % 10) / 100.0 END AS RATE_DOWN_PAYMENT,
           {_sql_days('o_orderdate')} AS DAYS_DECISION,
           CAST(o_orderkey % 36 AS DOUBLE) AS CNT_PAYMENT,
           {_sql_drawn(0, 10)} AS DAYS_FIRST_DRAWING,
           {_sql_drawn(1, 40)} AS DAYS_FIRST_DUE,
           {_sql_drawn(2, 400)} AS DAYS_LAST_DUE_1ST_VERSION,
           {_sql_drawn(3, 380)} AS DAYS_LAST_DUE,
           {_sql_drawn(4, 420)} AS DAYS_TERMINATION
    FROM orders"""


# --------------------------------------------------------------------------- POS / cash (events)
def pos_cash(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    e = scan(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    return e.select(
        c("event_id").alias("SK_ID_PREV"),
        c("user_id").alias("SK_ID_CURR"),
        (-F.dayofmonth("ts")).cast("bigint").alias("MONTHS_BALANCE"),
        c("event_type").alias("NAME_CONTRACT_STATUS"),
        _json_k().alias("SK_DPD"),
        F.floor("value").cast("bigint").alias("SK_DPD_DEF"),
    )


SQL["pos_cash"] = f"""
    SELECT event_id AS SK_ID_PREV, user_id AS SK_ID_CURR,
           CAST(-day(ts) AS BIGINT) AS MONTHS_BALANCE,
           event_type AS NAME_CONTRACT_STATUS,
           {_SQL_K} AS SK_DPD,
           CAST(floor(value) AS BIGINT) AS SK_DPD_DEF
    FROM events"""


# --------------------------------------------------------------------------- instalments, card (lineitem + orders)
def _lines_with_customer(spark: SparkSession, d: str) -> DataFrame:
    li = scan(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                     "l_discount", "l_tax", "l_returnflag", "l_shipdate"])
    o = scan(spark, d, "orders", ["o_orderkey", "o_custkey"])
    return li.join(o, li.l_orderkey == o.o_orderkey, "inner")


def installments(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    x = _lines_with_customer(spark, d)
    due_day = _days("l_shipdate").cast("double")
    return x.select(
        c("l_orderkey").alias("SK_ID_PREV"),
        c("o_custkey").alias("SK_ID_CURR"),
        (c("l_linenumber") % 3).cast("double").alias("NUM_INSTALMENT_VERSION"),
        due_day.alias("DAYS_INSTALMENT"),
        F.when(c("l_returnflag") == "R", _null_d()).otherwise(due_day + (c("l_quantity") - 25)).alias("DAYS_ENTRY_PAYMENT"),
        (c("l_extendedprice") * c("l_discount")).alias("AMT_INSTALMENT"),
        F.when(c("l_returnflag") == "R", _null_d()).otherwise(c("l_extendedprice") * c("l_tax")).alias("AMT_PAYMENT"),
    )


SQL["installments"] = f"""
    SELECT l_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
           CAST(l_linenumber % 3 AS DOUBLE) AS NUM_INSTALMENT_VERSION,
           CAST({_sql_days('l_shipdate')} AS DOUBLE) AS DAYS_INSTALMENT,
           CASE WHEN l_returnflag = 'R' THEN NULL
                ELSE CAST({_sql_days('l_shipdate')} AS DOUBLE) + (l_quantity - 25) END AS DAYS_ENTRY_PAYMENT,
           l_extendedprice * l_discount AS AMT_INSTALMENT,
           CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice * l_tax END AS AMT_PAYMENT
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def card_balance(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    x = _lines_with_customer(spark, d)
    return x.select(
        c("l_orderkey").alias("SK_ID_PREV"),
        c("o_custkey").alias("SK_ID_CURR"),
        (-c("l_linenumber")).cast("bigint").alias("MONTHS_BALANCE"),
        c("l_extendedprice").alias("AMT_BALANCE"),
        (c("l_extendedprice") * c("l_discount")).alias("AMT_DRAWINGS_CURRENT"),
        c("l_quantity").alias("CNT_DRAWINGS_CURRENT"),
        F.floor(c("l_tax") * 100 + 0.5).cast("bigint").alias("SK_DPD"),
        c("l_returnflag").alias("NAME_CONTRACT_STATUS"),
    )


SQL["card_balance"] = """
    SELECT l_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
           CAST(-l_linenumber AS BIGINT) AS MONTHS_BALANCE,
           l_extendedprice AS AMT_BALANCE,
           l_extendedprice * l_discount AS AMT_DRAWINGS_CURRENT,
           l_quantity AS CNT_DRAWINGS_CURRENT,
           CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS SK_DPD,
           l_returnflag AS NAME_CONTRACT_STATUS
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


# --------------------------------------------------------------------------- logs (events)
def requests(spark: SparkSession, d: str) -> DataFrame:
    """Request log: one row per call (path, status, duration)."""
    c = F.col
    e = scan(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    et = c("event_type")
    return e.select(
        c("event_id").alias("id"),
        F.concat(F.lit("r"), c("event_id").cast("string")).alias("request_id"),
        c("ts").alias("occurred_at"),
        F.lit("POST").alias("method"),
        F.when(et == "purchase", "/predict/batch")
         .when((et == "error") & (c("user_id") % 2 == 0), "/predict/batch")
         .otherwise("/predict").alias("path"),
        F.when(et == "error", 500).when(et == "signup", 422).otherwise(200).cast("int").alias("status_code"),
        c("value").alias("duration_ms"),
    )


SQL["requests"] = """
    SELECT event_id AS id, 'r' || CAST(event_id AS VARCHAR) AS request_id, ts AS occurred_at,
           'POST' AS method,
           CASE WHEN event_type = 'purchase' THEN '/predict/batch'
                WHEN event_type = 'error' AND user_id % 2 = 0 THEN '/predict/batch'
                ELSE '/predict' END AS path,
           CAST(CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 422 ELSE 200 END AS INTEGER) AS status_code,
           value AS duration_ms
    FROM events"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Prediction log: one row per scored file; a ``purchase`` call is a batch of
    2 to 5 files, every other accepted call scores one file."""
    c = F.col
    e = scan(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    e = e.filter(c("event_type").isin("click", "view", "purchase"))
    k = _json_k()
    batch = F.when(c("event_type") == "purchase", k % 4 + 2).otherwise(F.lit(1).cast("bigint"))
    x = e.select("*", k.alias("_k"), batch.alias("_n"),
                 F.explode(F.sequence(F.lit(0).cast("bigint"), batch - 1)).alias("_pos"))
    p = F.least((c("value") + c("_pos")) / 100.0, F.lit(1.0))
    provided = (c("_k") + 300).cast("int")
    return x.select(
        (c("event_id") * 8 + c("_pos")).alias("id"),
        F.concat(F.lit("r"), c("event_id").cast("string")).alias("request_id"),
        c("_pos").cast("int").alias("position"),
        c("ts").alias("occurred_at"),
        F.when(c("event_type") == "purchase", "/predict/batch").otherwise("/predict").alias("endpoint"),
        F.when(c("user_id") % 2 == 0, "v1").otherwise("v2").alias("model_version"),
        F.lit(THRESHOLD).alias("threshold"),
        p.alias("probability"),
        F.when(p >= THRESHOLD, "rejected").otherwise("accepted").alias("decision"),
        provided.alias("features_provided"),
        (F.lit(779) - provided).cast("int").alias("features_missing"),
        ((c("_k") % 50 + 50) / 100.0).alias("application_ratio"),
        ((c("_k") % 10) / 10.0).alias("history_ratio"),
        (c("value") / c("_n")).alias("latency_ms"),
        c("props").alias("features"),
    )


SQL["predictions"] = f"""
    SELECT event_id * 8 + pos AS id, 'r' || CAST(event_id AS VARCHAR) AS request_id,
           CAST(pos AS INTEGER) AS position, ts AS occurred_at,
           CASE WHEN event_type = 'purchase' THEN '/predict/batch' ELSE '/predict' END AS endpoint,
           CASE WHEN user_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version,
           CAST({THRESHOLD} AS DOUBLE) AS threshold,
           least((value + pos) / 100.0, 1.0) AS probability,
           CASE WHEN least((value + pos) / 100.0, 1.0) >= {THRESHOLD} THEN 'rejected' ELSE 'accepted' END AS decision,
           CAST(k + 300 AS INTEGER) AS features_provided,
           CAST(779 - (k + 300) AS INTEGER) AS features_missing,
           (k % 50 + 50) / 100.0 AS application_ratio,
           (k % 10) / 10.0 AS history_ratio,
           value / n AS latency_ms,
           props AS features
    FROM (SELECT *, unnest(generate_series(0, n - 1)) AS pos
          FROM (SELECT *, {_SQL_K} AS k,
                       CASE WHEN event_type = 'purchase' THEN {_SQL_K} % 4 + 2 ELSE 1 END AS n
                FROM events WHERE event_type IN ('click', 'view', 'purchase')))"""


# --------------------------------------------------------------------------- labelled scores (orders)
def scores(spark: SparkSession, d: str) -> DataFrame:
    """Labelled scores: y = closed order, p = scaled total price; ``p_alt`` is the
    same score from a second engine, kept to 3 decimals."""
    c = F.col
    o = scan(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    p = c("o_totalprice") / SCORE_SCALE
    return o.select(
        c("o_orderkey").alias("id"),
        F.when(c("o_orderstatus") == "F", 1).otherwise(0).cast("int").alias("y"),
        p.alias("p"),
        (F.floor(p * 1000 + 0.5) / 1000).alias("p_alt"),
    )


SQL["scores"] = f"""
    SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS y,
           o_totalprice / {SCORE_SCALE} AS p,
           floor(o_totalprice / {SCORE_SCALE} * 1000 + 0.5) / 1000 AS p_alt
    FROM orders"""


# --------------------------------------------------------------------------- scoring requests (customer)
# Each customer sends one record as JSON text; three records make a batch request, in every fourth group each is a
# request of its own. Some payloads break one rule of the record contract each.
_PAYLOAD = {
    "AMT_CREDIT": "CASE WHEN k % 31 = 0 THEN '1e999' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) + 1000 AS {text}) END",
    "AMT_INCOME_TOTAL": "CAST(CAST(floor(abs(c_acctbal) * 10) AS BIGINT) AS {text})",
    "AMT_ANNUITY": "CASE WHEN k % 23 = 0 THEN '\"350\"' WHEN k % 19 = 0 THEN 'null' ELSE CAST(CAST(floor(abs(c_acctbal) / 12) AS BIGINT) AS {text}) END",
    "DAYS_BIRTH": "CASE WHEN k % 17 = 0 THEN '100' ELSE CAST(-(7000 + k % 15000) AS {text}) END",
    "DAYS_EMPLOYED": "CASE WHEN k % 37 = 0 THEN '{{\"days\": 1}}' ELSE CAST(-(k % 4000) AS {text}) END",
    "CNT_FAM_MEMBERS": "CAST(c_nationkey % 4 AS {text}) || '.5'",
    "CODE_GENDER": "CAST(k % 2 AS {text})",
    "FLAG_OWN_CAR": "CASE WHEN k % 29 = 0 THEN 'true' WHEN c_acctbal > 5000 THEN '1' ELSE '0' END",
    "FLAG_OWN_REALTY": "CASE WHEN c_nationkey % 3 = 0 THEN '0' ELSE '1' END",
    "NAME_CONTRACT_TYPE_BUILDING": "CASE WHEN c_mktsegment = 'BUILDING' THEN '1' ELSE '0' END",
    "NAME_CONTRACT_TYPE_FURNITURE": "CASE WHEN c_mktsegment = 'FURNITURE' THEN '1' ELSE '0' END",
}
_PAYLOAD_UNKNOWN = "CASE WHEN k % 13 = 0 THEN ', \"UNKNOWN_SCORE\": 1' ELSE '' END"


def _payload_columns(text: str) -> list[str]:
    """The columns of ``payloads``, in one text for both engines; ``text`` is the engine's string type."""
    fields = " || ', ' || ".join(f"'\"{name}\": ' || " + expr.format(text=text) for name, expr in _PAYLOAD.items())
    group = "CAST(floor(k / 3) AS BIGINT)"
    alone = f"{group} % 4 = 0"
    return [
        "k",
        f"CASE WHEN {alone} THEN 's' || CAST(k AS {text}) ELSE 'b' || CAST({group} AS {text}) END AS request_id",
        f"CAST(CASE WHEN {alone} THEN 0 ELSE k % 3 END AS INTEGER) AS position",
        f"CASE WHEN {alone} THEN '/predict' ELSE '/predict/batch' END AS endpoint",
        f"86400 + 60 * {group} AS occurred_s",
        f"CAST({group} % 50 + 5 AS DOUBLE) AS duration_ms",
        f"""CASE WHEN k % 41 = 0 THEN '{{"AMT_CREDIT": NaN}}' WHEN k % 43 = 0 THEN '{{"AMT_CREDIT": 1'
                 WHEN k % 47 = 0 THEN '{{"AMT_CREDIT": 5000}}' WHEN k % 53 = 0 THEN '{{}}' WHEN k % 59 = 0 THEN '[1, 2]'
                 ELSE '{{' || {fields} || {_PAYLOAD_UNKNOWN} || '}}' END AS payload""",
    ]


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """Scoring requests: (k, request_id, position, endpoint, occurred_s, duration_ms, payload)."""
    cust = scan(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return cust.withColumn("k", F.col("c_custkey")).selectExpr(*_payload_columns("STRING"))


SQL["payloads"] = f"SELECT {', '.join(_payload_columns('VARCHAR'))} FROM (SELECT *, c_custkey AS k FROM customer)"


def with_roles(*names: str) -> str:
    """``WITH`` clause defining the given role views for an oracle query."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n"
