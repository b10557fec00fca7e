"""Structured Streaming jobs over the JSON-lines logs.

Each job reads a file source with an explicit schema, keeps event-time state
bounded by a watermark, writes to a Parquet sink with a checkpoint location in
the shared checkpoint folder, and is driven with ``trigger(availableNow=True)``
(run to the end of the available files, then stop; in production the same job
runs with a processing-time trigger). Append mode emits a window only once the
watermark has passed its end, so only closed windows appear in the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.columns import status_class
from ledgerlens.operators.logs import append_lines

REQUEST_SCHEMA = ("id long, request_id string, occurred_at timestamp, method string, path string, "
                  "status_code int, duration_ms double")
PREDICTION_SCHEMA = ("id long, request_id string, position int, occurred_at timestamp, endpoint string, "
                     "model_version string, threshold double, probability double, decision string, "
                     "features_provided int, features_missing int, application_ratio double, history_ratio double, "
                     "latency_ms double, features string")
RECORD_SCHEMA = "request_id string, position int, features map<string,double>"
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_json_log(df: DataFrame, path: str) -> None:
    """JSON lines with microsecond timestamps (the log format the streams read)."""
    df.write.mode("overwrite").option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT).json(path)


def read_json_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("timestampFormat", TS_FORMAT)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(path)


def run_to_parquet(df: DataFrame, out: str, checkpoint: str, partition_by: list[str] | None = None,
                   mode: str = "append") -> None:
    w = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def ingest_predictions(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per (request_id, position); duplicates inside the watermark delay are dropped."""
    return (stream.withWatermark("occurred_at", delay)
            .dropDuplicatesWithinWatermark(["request_id", "position"])
            .withColumn("dt", F.to_date("occurred_at")))


def ingest_lines(lines: DataFrame, base: str, checkpoint: str) -> None:
    """A stream of JSON lines (``value``) of both logs. Each micro-batch is one unit of the commit log under its batch
    id, so a replayed batch overwrites its own rows."""
    query = (lines.writeStream.foreachBatch(lambda batch, n: append_lines(batch.sparkSession, base, str(n), batch))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def request_series(stream: DataFrame, step: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """R2: tumbling-window calls per status class."""
    return (stream.withWatermark("occurred_at", delay)
            .groupBy(F.window("occurred_at", step).alias("w"), status_class("status_code").alias("status_class"))
            .agg(F.count(F.lit(1)).alias("calls"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status_class", "calls"))


def drift_sliding(stream: DataFrame, length: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Sliding 7-day windows, 1-day slide: volume and rejected count. The state is a
    handful of counters per open window, whatever the traffic."""
    return (stream.withWatermark("occurred_at", delay)
            .groupBy(F.window("occurred_at", length, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "rejected").alias("rejected"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "rejected"))


def psi_stream(stream: DataFrame, features: dict, profile: DataFrame, out: str, checkpoint: str,
               length: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> None:
    """PSI per feature of every closed sliding window, written by batch id with overwrite.

    The state is one counter per open window, feature and class; the bounds come from the broadcast profile. A
    window reaches the sink once, when the watermark closes it, and its PSI needs nothing but its counters.
    """
    from ledgerlens.operators import drift as D

    obs = D.observations(stream.withWatermark("occurred_at", delay), features, ["occurred_at"])
    classed = obs.filter(F.col("value").isNotNull()).join(F.broadcast(profile.select("feature", "bounds")), "feature")
    counts = classed.groupBy(F.window("occurred_at", length, slide).alias("w"), "feature",
                             D.class_of(F.col("bounds"), F.col("value")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feature", "class", "n")

    def handle(batch: DataFrame, batch_id: int) -> None:
        found = D.psi_of_counts(batch, profile, ["window_start", "window_end"])
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (counts.writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def escalation_stream(stream: DataFrame, features: dict, profile: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per closed day the number of significant features, the refusal rate and the mean rate of the seven days before.

    Chained stateful operators in append mode: counters per day, feature and class; the PSI inputs of a day and feature; one row
    per day; and sliding windows of eight days, whose last day is judged by the others. The watermark closes them one after
    the other, so the state holds the counters of open days and at most eight small rows for each open window, whatever the
    traffic. A day without rows has no result and does not count in the mean; no day before gives a NULL mean and no refusal alert;
    a feature without any value on a day counts as empty classes.
    """
    from ledgerlens.operators import drift as D
    from ledgerlens.operators import logs as L

    # the entry without a name carries the decisions of rows of any feature
    everything = features | {"": F.lit(None)}
    info = F.broadcast(profile.select("feature", "bounds"))                 # one row per feature
    obs = D.observations(stream.withWatermark("occurred_at", delay), everything, ["occurred_at", "decision"])
    place = F.when(F.col("value").isNotNull(), D.class_of(F.col("bounds"), F.col("value")))
    counts = (obs.join(info, "feature", "left").filter("feature = '' OR bounds IS NOT NULL")
              .groupBy(F.window("occurred_at", "1 day"), "feature", place.alias("class"))
              .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "rejected").alias("rejected")))

    per_feature = counts.groupBy("window", "feature").agg(
        F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "n"))).alias("classes"),
        F.sum("n").alias("n"), F.sum("rejected").alias("rejected"))
    shares = F.broadcast(profile.select("feature", "proportions"))
    judged = per_feature.join(shares, "feature", "left").withColumn("psi", D.psi_of_classes(F.col("classes"), F.col("proportions")))
    whole = F.col("feature") == ""
    days = judged.groupBy("window").agg(
        F.count_if(F.col("psi") >= L.PSI_SIGNIFICANT).alias("n_significant"),
        F.max(F.when(whole, F.col("rejected") / F.col("n"))).alias("refusal_rate"))

    seen = F.array_sort(F.collect_list(F.struct(F.col("window.start").alias("day"), "n_significant", "refusal_rate")))
    weeks = days.groupBy(F.window(F.col("window"), "8 days", "1 day").alias("week")).agg(seen.alias("seen"))
    last, before = F.element_at("seen", -1), F.slice("seen", 1, F.size("seen") - 1)
    mean = F.when(F.size(before) > 0, F.aggregate(before, F.lit(0.0), lambda a, x: a + x["refusal_rate"]) / F.size(before))
    closed = weeks.filter(last["day"] == F.col("week.end") - F.expr("INTERVAL 1 DAY")).select(
        last["day"].alias("day"), last["n_significant"].alias("n_significant"), last["refusal_rate"].alias("refusal_rate"),
        mean.alias("trailing_rate"))
    gap = F.coalesce(F.abs(F.try_divide(F.col("refusal_rate") - F.col("trailing_rate"), F.col("trailing_rate"))) > L.MAX_REFUSAL_GAP,
                     F.lit(False))
    return closed.select("*", gap.alias("refusal_alert"), ((F.col("n_significant") >= L.MIN_SIGNIFICANT) | gap).alias("alert"))


def score_stream(stream: DataFrame, contract: DataFrame, model, columns: list[str], out: str, checkpoint: str,
                 threshold: float) -> None:
    """Validate each micro-batch against the broadcast contract, score the records of valid
    requests with the fitted pipeline, write predictions and rejects to two sinks.

    A request is all or nothing: one invalid record rejects all of its records, as ``batch`` those that are
    valid themselves. The verdicts are written once, as the reject log of the batch, and both outputs are
    under ``batch=<id>`` with overwrite, so a replayed batch replaces its own files (idempotent on the batch id).
    """
    from ledgerlens.operators import contract as C
    from ledgerlens.operators.ml import positive_probability

    contract = F.broadcast(contract)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        verdict = C.validate(batch, contract).select(*C.KEYS, "reject_reason")
        gate = C.validate_batches(verdict).select("request_id", "status")
        path = f"{out}/verdicts/batch={batch_id}"
        verdict.join(gate, "request_id").write.mode("overwrite").parquet(path)
        verdict = spark.read.parquet(path)
        rejects = verdict.filter("status = 'rejected'").select(
            *C.KEYS, F.coalesce("reject_reason", F.lit("batch")).alias("reject_reason"))
        valid = batch.join(verdict.filter("status = 'accepted'").select(*C.KEYS), C.KEYS, "left_semi")
        dense = valid.select(*C.KEYS, *[F.col("features").getItem(c).alias(c) for c in columns])
        scored = positive_probability(model.transform(dense)).select(
            *C.KEYS, F.col("p").alias("probability"),
            F.when(F.col("p") >= threshold, "rejected").otherwise("accepted").alias("decision"))
        scored.write.mode("overwrite").parquet(f"{out}/predictions/batch={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
