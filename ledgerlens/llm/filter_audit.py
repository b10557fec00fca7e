"""Filter interaction audit: what each filter removes, in every order of the filters.

Every filter has a relation of the ids of the documents that fail it, written once. A document that fails a filter is
*removed* there after a prefix of other filters if it fails none of them, and *redundant* if it fails one. Both depend on
the set of the filters before, not on their order, so the relations are grown filter by filter: the failures tested after a
set of earlier filters are joined with the next filter's ids, left-anti for those still there and left-semi for those gone by
then. After the last filter the relation holds every failure with every set of other filters; label losses are its left-semi
joins with the ids of good and of toxic documents. Counts by part and set then give all orders.

Rows of the relations are ids with a few small values and are hash-partitioned by id, so no source or text makes a hot key;
texts are read once. Copies are found by the md5 of the text, pre-aggregated to the smallest doc_id.

Defined cases: NULL text is empty; NULL source is the part ''; a row without doc_id fails no copy test, is nobody's
original, and has no label; repeated rows are separate documents with equal results; a document with several labels is good
if one says so, toxic likewise; no documents give no rows; other columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.text import text_or_empty
from ledgerlens.session import materialised

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 200


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails A (words), B (distinct words), C (capitals), D (symbols); ``_words`` holds its words."""
    words = F.size("_words")
    return {"A": words < LEAST_WORDS,
            "B": 100 * F.size(F.array_distinct("_words")) < 50 * words,
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
            "D": text.rlike("[#$%&*|]")}


def checked_documents(docs: DataFrame) -> DataFrame:
    """(id, doc_id, part, fails): every row under a number of its own, with the sorted letters of the filters that it fails."""
    rows = docs.select("doc_id", text_or_empty("source").alias("part"), text_or_empty("text").alias("text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    tests = text_filters(F.col("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.md5("text")).alias("key"), F.array_compact(F.array(
        *[F.when(fails, F.lit(name)) for name, fails in tests.items()])).alias("fails"))
    # numbers of a written table stay, whatever is run again
    rows = materialised(rows.withColumn("id", F.monotonically_increasing_id()), "tested")
    copies = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = copies.filter("first < last").select("key", "first")
    copy = F.when(F.col("doc_id") > F.col("first"), F.array(F.lit("E"))).otherwise(F.array().cast("array<string>"))
    return rows.join(copies, "key", "left").select("id", "doc_id", "part", F.concat("fails", copy).alias("fails"))


def failing_ids(tested: DataFrame, filters: Sequence[str]) -> dict[str, DataFrame]:
    """The id relation (id, part) of each filter, each a table of its own."""
    return {f: materialised(tested.filter(F.array_contains("fails", f)).select("id", "part"), f"failing-{f}") for f in filters}


def failures_after_sets(failing: dict[str, DataFrame]) -> DataFrame:
    """(id, part, filter, earlier, gone): every failure of a filter, for every set of other filters (``earlier``, one
    bit each) that may come before it, and whether one of these removes the document first."""
    names = sorted(failing)
    out = None
    for f in names:
        rows = failing[f].select("id", "part", F.lit(f).alias("filter"), F.lit(0).alias("earlier"), F.lit(False).alias("gone"))
        out = rows if out is None else out.unionByName(rows)
    for k, g in enumerate(names):
        after = out.filter(F.col("filter") != g).withColumn("earlier", F.col("earlier").bitwiseOR(F.lit(1 << k)))
        there, ids = after.filter("NOT gone"), failing[g].select("id")
        out = out.unionByName(after.filter("gone")).unionByName(there.join(ids, "id", "left_anti")).unionByName(
            there.join(ids, "id", "left_semi").withColumn("gone", F.lit(True)))
        out = materialised(out, f"failures-{k + 1}")
    return out


def audit_filters(docs: DataFrame, labels: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    names = sorted(filters)
    bits = {f: 1 << k for k, f in enumerate(names)}
    tested = materialised(checked_documents(docs), "tested-all")
    failures = failures_after_sets(failing_ids(tested, names))
    by = ["part", "filter", "earlier"]
    counts = failures.groupBy(*by).agg(F.count_if(~F.col("gone")).alias("removed"), F.count_if("gone").alias("redundant"))
    lost = failures.filter("NOT gone")
    for name, label in (("good_lost", "quality"), ("toxic_lost", "toxic")):
        ids = tested.join(labels.filter(F.col(label) == 1).select("doc_id"), "doc_id", "left_semi").select("id")
        labelled = lost.join(ids, "id", "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias(name))
        counts = counts.join(labelled, by, "left")
    counts = materialised(counts.fillna(0), "filter-counts")     # parts x filters x sets

    # over all orders, a set of s filters comes right before the filter in s! (n - 1 - s)! of them
    last = len(names) - 1
    orders = F.get(F.array(*[F.lit(factorial(s) * factorial(last - s)) for s in range(len(names))]), F.bit_count("earlier"))
    alone = F.bit_count("earlier") == last                       # after all others, only what fails nothing else is left
    overall = counts.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * orders).alias("shapley"), F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"))

    every = F.split(F.lit(",".join("".join(o) for o in permutations(names))), ",")
    rows = tested.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("filter_order", F.explode(every))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    rows = rows.withColumns({
        "filter": F.substr("filter_order", "step", F.lit(1)),
        "earlier": sum(F.when(F.instr("filter_order", f) < F.col("step"), b).otherwise(0) for f, b in bits.items())})
    rows = rows.join(counts, by, "left").join(overall, ["part", "filter"], "left").fillna(0)
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return rows.select("part", "filter_order", "step", (F.col("n") - F.sum("removed").over(so_far)).alias("kept"),
                       "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
