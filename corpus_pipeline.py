"""Corpus pipeline: documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes its rows as Parquet to the shared
folder and rereads them as the next stage's docs. All but the last stage return the columns of docs.

1. ``language_id`` drops documents without a letter and those that are far from every language's profile.
2. ``line_dedup`` removes repeated three-line windows; a document of which nothing is left goes.
3. ``near_dedup`` keeps the smallest (doc_id, md5 of the text) of every group of near duplicates (similarity 0.8).
4. ``decontamination`` drops documents with a window of a benchmark item.
5. ``source_mix`` takes documents to the sources' target weights; rows come in the order of the mix, with
   size, source_size, target, taken (words) and mix_start. Documents of which no word is taken go.

Rows without doc_id and repeated rows pass as the operators define it. Rows that share a doc_id are separate documents;
of those that share the text too, near_dedup keeps one if it has words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.decontamination import contamination
from ledgerlens.llm.language_id import accepted, learn_profiles
from ledgerlens.llm.line_dedup import without_repeated_lines
from ledgerlens.llm.mixing import mix_sources
from ledgerlens.llm.near_dedup import near_duplicates
from ledgerlens.llm.text import broadcast_if_few, packed, same_document, table, unpacked
from ledgerlens.operators.ranges import running_totals
from ledgerlens.session import materialised, scratch_tables

SIMILARITY = 80          # percent
LEAST_SCORE = 0.2        # of the nearest language


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, learn_profiles(docs), LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = without_repeated_lines(docs).filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        gone = near_duplicates(docs, SIMILARITY).filter("NOT kept").select("doc_id")
        rows = docs.join(broadcast_if_few(gone), "doc_id", "left_anti")
        return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
    # ids of several rows: texts are compared under the rank of (doc_id, md5)
    rows, same = packed(docs), same_document("_row.doc_id", "_md5", "_id", "_key")
    keys = rows.filter("_row.doc_id IS NOT NULL").select(F.col("_row.doc_id").alias("_id"), F.col("_md5").alias("_key")).distinct()
    ranks = running_totals(keys.withColumn("one", F.lit(1)), ["_id", "_key"], ["one"])
    ranks = materialised(ranks.select("_id", "_key", F.col("cum_one").cast("long").alias("doc_id")), "ranks")
    numbered = materialised(rows.join(ranks, same).select("doc_id", F.col("_row.text").alias("text")), "numbered")
    found = near_duplicates(numbered, SIMILARITY).groupBy("doc_id", "n_shingles", "kept").count()
    found = materialised(found.join(ranks, "doc_id"), "found")
    rows = rows.join(broadcast_if_few(found.filter("NOT kept").select("_id", "_key")), same, "left_anti")
    twice = broadcast_if_few(found.filter("kept AND n_shingles > 0 AND count > 1").select("_id", "_key"))
    one = rows.join(twice, same, "left_semi").groupBy(F.struct("_row.doc_id", "_md5").alias("_same")).agg(
        F.min_by("_row", F.to_json("_row")).alias("_row"))
    return unpacked(rows.join(twice, same, "left_anti").select("_row").unionByName(one.select("_row")), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    hit = found.filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    rows = packed(docs).join(broadcast_if_few(hit), same_document("_row.doc_id", "_md5", "_id", "_key"), "left_anti")
    return unpacked(rows, docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated rows are separate documents of the mix; they are joined as one row and listed apart again."""
    made = ["size", "source_size", "target", "taken", "mix_start"]
    mixed = mix_sources(docs).filter("taken > 0").groupBy(F.struct("doc_id", "source", "key").alias("_same")).agg(
        F.collect_list(F.struct(*made)).alias("_mixed"))
    # one struct as the key: NULLs are equal in it, and the texts are shuffled once for both steps
    rows = packed(docs).withColumn("_same", F.struct("_row.doc_id", "_row.source", F.col("_md5").alias("key")))
    rows = rows.dropDuplicates(["_same"]).join(mixed, "_same").withColumn("_m", F.explode("_mixed"))
    return unpacked(rows, docs.columns, {c: F.col("_m")[c] for c in made}).orderBy("mix_start")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("source_mix", source_mix)]

# Learned profiles, minimum hashes and connected components have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "*")
    for name, stage in STAGES:
        with scratch_tables(spark):
            docs = materialised(stage(spark, docs, sf_dir), f"stage-{name}", scratch=False)
    return docs
