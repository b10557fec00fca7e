"""Record contract: validation of sparse ``{feature: value}`` records against an
ordered feature list, coverage, verdict, batch gate and prediction records.

Records are exploded once into ``(request_id, position, name, value)`` entries;
every check is a join of the entries with the contract table (one row per
feature, broadcast: its size is the model's feature count) followed by one
aggregation per record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.ordered import scalar_fields

# ---------------------------------------------------------------- fixed values
# Prefixes of history aggregates, range rules (prefix, low, high; first match
# wins, names ending in _PERC are exempt), minimum application coverage and the
# batch size limit of the reference.
HISTORY_PREFIXES = ("BURO_", "ACTIVE_", "CLOSED_", "PREV_", "APPROVED_", "REFUSED_", "POS_", "INSTAL_", "CC_")
RANGE_RULES = (
    ("EXT_SOURCE_", 0.0, 1.0, "normalised external score, expected between 0 and 1"),
    ("DAYS_", None, 0.0, "days before the application, expected negative or zero"),
    ("AMT_", 0.0, None, "amount, expected positive or zero"),
    ("CNT_", 0.0, None, "count, expected positive or zero"),
    ("FLAG_", 0.0, 1.0, "binary flag, expected 0 or 1"),
)
EXEMPT_SUFFIX = "_PERC"
MIN_APPLICATION_COVERAGE = 0.5
MAX_BATCH_SIZE = 1000
MAX_LISTED = 10

KEYS = ["request_id", "position"]


def contract_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """``(pos, name, origin, low, high, reason)``: rules evaluated once per feature as CASE expressions."""
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string")
    name = F.col("name")
    hist = F.lit(False)
    for p in HISTORY_PREFIXES:
        hist = hist | name.startswith(p)
    origin = F.when(hist, "history").otherwise("application")

    def rule(i):
        expr = F.lit(None)
        for prefix, low, high, reason in reversed(RANGE_RULES):
            val = (low, high, reason)[i]
            expr = F.when(name.startswith(prefix), F.lit(val)).otherwise(expr)
        return F.when(name.endswith(EXEMPT_SUFFIX), F.lit(None)).otherwise(expr)

    return df.select("pos", "name", origin.alias("origin"), rule(0).cast("double").alias("low"),
                     rule(1).cast("double").alias("high"), rule(2).cast("string").alias("reason"))


def entries(records: DataFrame, features: str = "features") -> DataFrame:
    """``(request_id, position, name, value)``, explicit nulls kept."""
    return records.select(*KEYS, F.explode(F.col(features)).alias("name", "value"))


def unknown_names(ent: DataFrame, contract: DataFrame) -> DataFrame:
    """Per record, sorted names outside the contract (explicit null values included)."""
    unknown = ent.join(F.broadcast(contract.select("name")), "name", "left_anti")
    return unknown.groupBy(*KEYS).agg(F.array_sort(F.collect_list("name")).alias("unknown"))


def out_of_range(ent: DataFrame, contract: DataFrame) -> DataFrame:
    """Per record, ``name=value (reason)`` messages sorted by name; NULL values and unknown names ignored."""
    j = ent.filter(F.col("value").isNotNull()).join(
        F.broadcast(contract.filter(F.col("reason").isNotNull()).select("name", "low", "high", "reason")), "name")
    bad = j.filter((F.col("low").isNotNull() & (F.col("value") < F.col("low"))) |
                   (F.col("high").isNotNull() & (F.col("value") > F.col("high"))))
    msg = F.concat(F.col("name"), F.lit("="), F.col("value").cast("string"), F.lit(" ("), F.col("reason"), F.lit(")"))
    return bad.groupBy(*KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("name", msg.alias("m")))), lambda s: s.getField("m")).alias("problems"))


def coverage(ent: DataFrame, contract: DataFrame, records: DataFrame) -> DataFrame:
    """provided / missing counts and application / history ratios (NULL = not provided)."""
    sizes = scalar_fields(contract.agg(F.count_if(F.col("origin") == "application").alias("_na"),
                                       F.count_if(F.col("origin") == "history").alias("_nh")))
    hits = (ent.filter(F.col("value").isNotNull())
            .join(F.broadcast(contract.select("name", "origin")), "name")
            .groupBy(*KEYS).agg(F.count_if(F.col("origin") == "application").alias("_app"),
                                F.count_if(F.col("origin") == "history").alias("_hist")))
    base = records.select(*KEYS).join(hits, KEYS, "left").fillna(0, ["_app", "_hist"])
    na, nh = sizes["_na"], sizes["_nh"]
    return base.select(*KEYS,
                       (F.col("_app") + F.col("_hist")).cast("int").alias("provided"),
                       (na + nh - F.col("_app") - F.col("_hist")).cast("int").alias("missing"),
                       (F.col("_app") / na).alias("application_ratio"),
                       (F.col("_hist") / nh).alias("history_ratio"))


def non_finite(ent: DataFrame) -> DataFrame:
    """Per record, number of values that are NaN or infinite (NULL is allowed)."""
    bad = F.isnan("value") | (F.abs(F.col("value")) == F.lit(float("inf")))
    return ent.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_values"), F.count_if(bad).alias("n_non_finite"))


def bounded_list(names: Column, limit: int = MAX_LISTED, between: str = ", ") -> Column:
    """``a, b, ... (+n others)`` from a sorted array, at most ``limit`` names spelled out."""
    n = F.size(names)
    head = F.concat_ws(between, F.slice(names, 1, limit))
    return F.when(n > limit, F.concat(head, F.lit(" (+"), (n - limit).cast("string"), F.lit(" others)"))).otherwise(head)


def validate(records: DataFrame, contract: DataFrame) -> DataFrame:
    """Verdict per record with precedence non-finite -> unknown -> range -> coverage.

    One pass: the entries are left-joined once to the broadcast contract, and every
    component (unknown names, range problems, coverage counts, non-finite values) is a
    conditional aggregate of the same ``groupBy`` on the record key. A record with an
    empty payload keeps one row through ``explode_outer``.
    """
    return entry_verdicts(records.select(*KEYS, F.explode_outer(F.col("features")).alias("name", "value")), contract)


def entry_verdicts(ent: DataFrame, contract: DataFrame, kind: str | None = None) -> DataFrame:
    """The verdict of every record from its entries (``KEYS``, name, value); a record without any has one NULL entry.

    ``kind``: a column with the type of the entry's value. Other kinds than ``number`` and ``null`` reject the record first
    (``unreadable`` before ``type``). The reason depends on counts alone, so a query that takes no message sorts and keeps no
    entry: its aggregate has a few numbers per record.
    """
    sizes = scalar_fields(contract.agg(F.count_if(F.col("origin") == "application").alias("_na"),
                                       F.count_if(F.col("origin") == "history").alias("_nh")))
    rules = contract.select("name", "origin", "low", "high", "reason", F.lit(True).alias("_known"))
    wrong_kind = F.lit(False) if kind is None else ~F.col(kind).isin("number", "null")
    j = ent.join(F.broadcast(rules), "name", "left")
    name, value = F.col("name"), F.col("value")
    known, present = F.col("_known").isNotNull(), value.isNotNull()
    outside = (F.col("low").isNotNull() & (value < F.col("low"))) | (F.col("high").isNotNull() & (value > F.col("high")))
    bad = known & present & F.col("reason").isNotNull() & outside
    msg = F.concat(name, F.lit("="), value.cast("string"), F.lit(" ("), F.col("reason"), F.lit(")"))
    agg = j.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.when(name.isNotNull() & ~known, name))).alias("unknown"),
        F.transform(F.array_sort(F.collect_list(F.when(bad, F.struct(name, msg.alias("m"))))),
                    lambda e: e.getField("m")).alias("problems"),
        F.count_if(known & present & (F.col("origin") == "application")).alias("_app"),
        F.count_if(known & present & (F.col("origin") == "history")).alias("_hist"),
        F.count_if(F.isnan(value) | (F.abs(value) == F.lit(float("inf")))).alias("n_non_finite"),
        F.array_sort(F.collect_list(F.when(wrong_kind, F.concat(
            F.coalesce(name, F.lit("payload")), F.lit(" is "), F.col(kind) if kind else F.lit(""))))).alias("mistyped"),
        F.count_if(wrong_kind & name.isNull()).alias("_unreadable"), F.count_if(wrong_kind).alias("_mistyped"),
        F.count_if(name.isNotNull() & ~known).alias("_unknown"), F.count_if(bad).alias("_problems"))
    na, nh = sizes["_na"], sizes["_nh"]
    application_ratio = F.col("_app") / na
    reason = (F.when(F.col("_unreadable") > 0, "unreadable")
              .when(F.col("_mistyped") > 0, "type")
              .when(F.col("n_non_finite") > 0, "non_finite")
              .when(F.col("_unknown") > 0, "unknown")
              .when(F.col("_problems") > 0, "range")
              .when(application_ratio < MIN_APPLICATION_COVERAGE, "coverage"))
    counted = lambda names, what, between: F.concat(
        F.size(names).cast("string"), F.lit(f" {what}: "), bounded_list(F.col(names), between=between))
    percent = F.concat((F.floor(application_ratio * 1000 + 0.5) / 10).cast("decimal(4,1)").cast("string"), F.lit("%"))
    message = (F.when(reason == "unknown", counted("unknown", "unknown feature(s)", ", "))
               .when(reason == "range", counted("problems", "value(s) out of range", "; "))
               .when(reason == "coverage", F.concat(F.lit("application coverage "), percent,
                                                    F.lit(f", at least {MIN_APPLICATION_COVERAGE:.0%} needed")))
               .when(reason == "non_finite", F.lit("non-finite values"))
               .when(reason == "type", counted("mistyped", "value(s) not a number or null", "; "))
               .when(reason == "unreadable", F.lit("payload is not a JSON object")))
    return agg.select(*KEYS,
                      (F.col("_app") + F.col("_hist")).cast("int").alias("provided"),
                      (na + nh - F.col("_app") - F.col("_hist")).cast("int").alias("missing"),
                      application_ratio.alias("application_ratio"), (F.col("_hist") / nh).alias("history_ratio"),
                      reason.alias("reject_reason"), message.alias("message"))


def validate_batches(verdicts: DataFrame) -> DataFrame:
    """All-or-nothing batches: 1..MAX items, the first invalid item (by position) rejects the whole batch."""
    first_bad = F.min_by(F.struct("position", "reject_reason"), F.when(F.col("reject_reason").isNotNull(), F.col("position")))
    agg = verdicts.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_items"), first_bad.alias("_b"),
                                             F.count_if(F.col("reject_reason").isNotNull()).alias("n_invalid"))
    status = (F.when((F.col("n_items") < 1) | (F.col("n_items") > MAX_BATCH_SIZE), "rejected")
              .when(F.col("n_invalid") > 0, "rejected").otherwise("accepted"))
    return agg.select("request_id", "n_items", status.alias("status"),
                      F.when(F.col("n_invalid") > 0, F.col("_b.position")).alias("first_invalid_position"),
                      F.when(F.col("n_invalid") > 0, F.col("_b.reject_reason")).alias("first_reason"))
