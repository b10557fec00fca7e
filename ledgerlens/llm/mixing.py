"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash, up to ``copies`` times over; a document's virtual
finish time is the cumulative words of its source up to its end divided by the source's target. All
documents are range-sorted by it and the queue is truncated at the total budget: words that start after it are not
taken. A document that reaches over its source's target is two pieces, one that finishes at time 1 and one that
finishes later, so the words that finish by time 1 are the budget (all targets, rounded down), and sources meet theirs to the word.

Targets fill like water: weight times a common level, at most ``copies`` times the source's size. With
sources sorted by the level at which they are full, the common level is the largest of
(words left) / (weight left) over that order.

Defined cases: NULL or blank text has size 0 and is taken 0 times; a NULL source is a source, the last;
repeated rows are separate documents; no rows give no rows; with no words all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.text import text_or_empty
from ledgerlens.operators.ranges import running_totals
from ledgerlens.session import materialised

WORD = r"[^\x20\x09-\x0D]+"
COPIES = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, copies: int = COPIES, cycle: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size): sources in code point order weigh 1..cycle, repeating."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumns({"last": F.col("source").isNull(), "one": F.lit(1)})
    weighted = running_totals(per, ["last", "source"], ["one"]).select(
        "source", "source_size", "last", ((F.col("cum_one") - 1) % cycle + 1).alias("weight"))
    full = weighted.withColumns({"cap": copies * F.col("source_size")}).withColumn(
        "fills_at", F.col("cap").cast("double") / F.col("weight"))
    order = ["fills_at", "last", "source"]
    filling = materialised(running_totals(full, order, ["cap", "weight"]), "filling")
    total, weight = filling.agg(F.sum("source_size"), F.sum("weight")).first()
    words_left = F.lit(total or 0) - (F.col("cum_cap") - F.col("cap"))
    weight_left = F.lit(weight or 1) - (F.col("cum_weight") - F.col("weight"))
    level = filling.agg(F.max(words_left.cast("double") / weight_left.cast("double"))).first()[0]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level or 0.0))
    return materialised(filling.select("source", "source_size", target.alias("target")), "targets")


def mix_sources(docs: DataFrame, budget: int | None = None, copies: int = COPIES, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, key (md5 of the text), size, source_size, target, taken, mix_start.

    ``mix_start``: words of the mix before the document's first appearance. ``budget``: words the mix may hold,
    by default all targets.
    """
    size = F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long")
    one = ["doc_id", "source", "key", "size"]
    rows = docs.select("doc_id", "source", F.md5("text").alias("key"), size.alias("size")).groupBy(*one).count()
    rows = materialised(rows.select(*one,
                                    F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("nth")), "sizes")
    targets = source_targets(rows, copies)
    rows = rows.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rounds = F.greatest(F.lit(1), F.least(F.lit(copies), F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))))
    dealt = rows.withColumn("round", F.explode(F.sequence(F.lit(1), rounds.cast("int"))))
    dealt = dealt.withColumn("shuffled", F.md5(F.concat_ws(":", F.lit(seed), "round", F.col("doc_id").cast("string"))))
    queued = running_totals(dealt, ["round", "shuffled", "doc_id", "key", "nth"], ["size"], ["source"])
    finish = F.coalesce(F.try_divide(F.col("cum_size").cast("double"), F.col("target")), F.lit(1.0))
    early = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - F.col("cum_size") + F.col("size")))
    pieces = F.filter(F.array(
        F.struct(early.alias("words"), F.least(finish, F.lit(1.0)).alias("finish"), F.lit(False).alias("late")),
        F.struct((F.col("size") - early).alias("words"), F.greatest(finish, F.lit(1.0)).alias("finish"), F.lit(True).alias("late"))),
        lambda p: (p["words"] > 0) | ((F.col("size") == 0) & ~p["late"]))
    queued = queued.select(*one, "nth", "source_size", "target", "round", "shuffled", F.inline(pieces))
    mixed = running_totals(queued, ["finish", "late", "shuffled", "doc_id", "source", "key", "nth", "round"], ["words"])
    every = targets.agg(F.sum(F.floor("target"))).first()[0] or 0
    budget = every if budget is None else min(budget, every)
    start = F.col("cum_words") - F.col("words")
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - start))
    return mixed.select("*", taken.alias("part"), start.alias("start")).groupBy(
        *one, "nth", "source_size", "target").agg(
        F.sum("part").alias("taken"), F.min(F.when(F.col("part") > 0, F.col("start"))).alias("mix_start")).drop("nth")
