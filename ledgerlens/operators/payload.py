"""Scoring requests as JSON text: strict types, verdict, score and prediction record in one pass.

The text is parsed once to a VARIANT. Its entries are exploded with their types, so a string, a boolean, an array or an
object is seen as what it was sent as; only numbers and null are accepted, an infinite number (``1e999``) is not finite,
and a text that is no JSON object (``NaN`` is no JSON) is unreadable. The score is an expression over the parsed payload
that looks up the features that the trees split on, so no row of all features is built. Only the keys go with the entries:
the verdict leaves an aggregate of a few numbers per record, and the text as received joins it afterwards, once per record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.columns import decide
from ledgerlens.operators import contract as C
from ledgerlens.operators.ordered import join_groups
from ledgerlens.operators.trees import Forest, probability


def parsed(records: DataFrame, payload: str = "payload") -> DataFrame:
    return records.withColumn("_v", F.try_parse_json(payload))


def value_kind(value: Column) -> Column:
    """``number``, ``null`` (also for no entry), or the JSON type."""
    kind = F.lower(F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1))
    return F.when(value.isNull() | (kind == "void"), "null").when(kind.isin("bigint", "decimal", "double"), "number").otherwise(kind)


def typed_entries(records: DataFrame, payload: str = "payload") -> DataFrame:
    """The columns of ``records`` with name, kind and value of every entry of the payload. An empty object has one row of a NULL
    name, a payload that is no JSON object one of kind ``unreadable``."""
    rows = parsed(records, payload)
    readable = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    rows = rows.withColumn("_object", F.when(readable, F.col("_v")))
    spark = records.sparkSession
    entries = rows.lateralJoin(spark.tvf.variant_explode_outer(F.col("_object").outer()))
    kind = F.when(F.col("_object").isNull(), "unreadable").otherwise(value_kind(F.col("value")))
    number = F.when(kind == "number", F.try_variant_get("value", "$", "double"))
    return entries.select(*records.columns, F.col("key").alias("name"), kind.alias("kind"), number.alias("value"))


def scored(records: DataFrame, forest: Forest, payload: str = "payload") -> DataFrame:
    """``records`` with the ``probability`` of their payload; a feature that it lacks is missing."""
    rows = parsed(records, payload)
    margin = forest.margin(lambda f: f"try_variant_get(_v, '$[\"{f}\"]', 'double')")
    return rows.withColumn("probability", probability(margin)).drop("_v")


def payload_verdicts(records: DataFrame, contract: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Verdict per record (request_id, position, payload), with the columns ``carried``."""
    verdicts = C.entry_verdicts(typed_entries(records.select(*C.KEYS, "payload")).select(*C.KEYS, "name", "kind", "value"), contract, "kind")
    return with_columns_of(verdicts, records, carried) if carried else verdicts


def with_columns_of(verdicts: DataFrame, records: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """``verdicts`` with the columns ``carried`` of their records, of any one if several records have the same keys. The records
    are dealt by their keys first, so that no task sorts all the texts of its part of the input."""
    one = records.select(*C.KEYS, *carried).repartition(*C.KEYS).groupBy(*C.KEYS).agg(*[F.any_value(c).alias(c) for c in carried])
    return join_groups(verdicts, one, C.KEYS)


def prediction_records(requests: DataFrame, contract: DataFrame, forest: Forest, version: str, threshold: float) -> DataFrame:
    """One log record per record of an accepted request (request_id, position, occurred_at, endpoint, duration_ms, payload):
    version, threshold, probability, decision, coverage, its share of the request's duration, and the payload as received."""
    verdicts = payload_verdicts(requests, contract)
    # a request has at most MAX_BATCH_SIZE records when it is accepted; larger ones are counted, not listed
    gate = C.validate_batches(verdicts).filter("status = 'accepted'").select("request_id", "n_items")
    accepted = with_columns_of(verdicts.join(gate, "request_id"), requests, ("occurred_at", "endpoint", "duration_ms", "payload"))
    return scored(accepted, forest).select(
        *C.KEYS, "occurred_at", "endpoint", F.lit(version).alias("model_version"), F.lit(threshold).alias("threshold"),
        "probability", decide("probability", threshold).alias("decision"), F.col("provided").alias("features_provided"),
        F.col("missing").alias("features_missing"), "application_ratio", "history_ratio",
        (F.col("duration_ms") / F.col("n_items")).alias("latency_ms"), F.col("payload").alias("features"))
