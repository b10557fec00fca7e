"""Line dedup over overlapping windows of three lines.

Every run of three consecutive lines of a text is hashed (128 bits, over the trimmed lines). A window that occurs more than
once anywhere is kept where it occurs first, by (doc_id, text, line), and its later occurrences cover
their three lines; covered lines are removed. Overlapping windows merge by themselves, because each
covers positions.

Windows are pre-aggregated before they are shuffled: first to one row per text and hash with its
positions, then to the first place and the count of a hash. Only hashes that repeat go back to the texts, by
a join that adaptive execution can split at a hash that a third of all texts have.

Defined cases: a NULL text stays NULL; texts of one or two lines have no window and stay; windows without a
letter or digit (blank lines, rules) count as no window; rows of equal (doc_id, text) are one text, so both keep
their first lines; columns of other names are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.text import packed, same_document, unpacked
from ledgerlens.session import materialised

SPAN = 3


def windows_of(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, key, pos, hash): every window of ``span`` consecutive lines; ``key`` is the md5 of the text."""
    # the lines are a column used more than once, so that they are split once a text and not once a window
    texts = docs.filter(F.instr("text", "\n") > 0).select(
        "doc_id", F.md5("text").alias("key"), F.transform(F.split("text", "\n"), lambda x: F.trim(x)).alias("lines"))
    last = F.size("lines") - span
    starts = F.when(last >= 0, F.sequence(F.lit(0), last))
    windows = texts.select("doc_id", "key", F.explode(F.transform(starts, lambda i: F.struct(
        i.alias("pos"), F.array_join(F.slice("lines", i + 1, span), "\n").alias("window")))).alias("w"))
    return windows.filter(F.col("w.window").rlike(r"[\p{L}\p{N}]")).select(
        "doc_id", "key", "w.pos", F.unhex(F.md5("w.window")).alias("hash"))


def covered_lines(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, key, covered): sorted line numbers to remove from the text with md5 ``key``, at least one."""
    windows = materialised(windows_of(docs, span), "line-windows")
    here = F.struct("doc_id", "key", "pos")
    repeated = windows.groupBy("hash").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    repeated = materialised(repeated.filter("first <> last").select("hash", "first"), "line-repeats")
    later = windows.join(repeated, "hash").filter(here != F.col("first"))
    lines = later.select("doc_id", "key", F.explode(F.sequence("pos", F.col("pos") + (span - 1))).alias("line"))
    return lines.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("line")).alias("covered"))


def without_repeated_lines(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` with the lines of later windows removed from ``text``, and ``n_lines`` and ``n_removed`` (which replace
    columns of these names)."""
    covered = covered_lines(docs, span).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"),
                                               F.col("covered").alias("_covered"))
    rows = packed(docs).join(covered, same_document("_row.doc_id", "_md5", "_id", "_key"), "left")
    rows = rows.withColumn("_lines", F.split("_row.text", "\n"))
    n = F.coalesce(F.size("_lines"), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), n - 1), "_covered")       # by a hash set, in order
    kept = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    text = F.col("_row.text")
    return unpacked(rows, docs.columns, {
        "text": F.when(F.col("_covered").isNull(), text).otherwise(kept),
        "n_lines": F.when(text.isNull(), 0).otherwise(n), "n_removed": F.coalesce(F.size("_covered"), F.lit(0))})


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the sha256 of the text that is left, of every document."""
    return without_repeated_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
