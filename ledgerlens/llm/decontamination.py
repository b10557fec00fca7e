"""Benchmark decontamination: a prefix-filtered join with exact verification.

A benchmark item's words give windows of ``WINDOW`` consecutive words (an item of fewer words is one window). A
document that contains a window must contain every token of it, so one necessary token is enough: the window's
rarest by its count over all documents. Documents' words are joined with these tokens; the token's place
in the window bounds the place of the occurrence (it must start and end inside the document), and
the candidate is verified word by word. Words inside a verified occurrence are hit.

The benchmark side of the join is broadcast. It is taken in blocks of windows of about ``BLOCK_WORDS`` words, so its size
is bounded however large the benchmark or one of its items is; each block reads the documents' words again. Windows
are verified one by one, so an item's windows may lie in several blocks.

Defined cases: words are runs of digits, letters and characters above ASCII, A-Z lower-cased; a NULL text has no words; an
item without words has no window; an item without id contaminates, but is not counted or listed; items with
equal windows are all counted; repeated documents are separate rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.text import ascii_lower, text_or_empty
from ledgerlens.session import materialised

WINDOW = 10
BLOCK_WORDS = 1_000_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """The text's words, one blank between two."""
    return F.trim(F.regexp_replace(ascii_lower(text), _BETWEEN, " "))


def _split(words: Column | str) -> Column:
    words = F.col(words) if isinstance(words, str) else words
    return F.when(words != "", F.split(words, " ")).otherwise(F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, words): the distinct windows of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"),
                             _split(normal_words(text_or_empty("text"))).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words")).distinct()


def _blocks(windows: DataFrame) -> list[DataFrame]:
    """``windows`` in parts of about ``BLOCK_WORDS`` words, dealt by window and item, so that neither a long item, nor items
    without id, nor a window of many items fill one part."""
    words = windows.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-words // BLOCK_WORDS)
    part = F.pmod(F.xxhash64("words", "item"), F.lit(n))
    return [windows.filter(part == k) for k in range(n)] if n > 1 else [windows] * n


def _occurrences(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, item, start, width) of every occurrence of ``windows`` in the words of ``rows`` (row, words)."""
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    counts = (rows.select(F.explode(F.split("words", " ")).alias("word")).join(F.broadcast(vocabulary), "word")
              .groupBy("word").agg(F.count("word").alias("n")))
    # the rarest word of a window is necessary; a window with a word that no document has cannot occur
    places = windows.select("item", "words", F.posexplode("words").alias("place", "word"))
    ranked = places.join(counts, "word").groupBy("item", "words").agg(
        F.min(F.struct("n", "word", "place")).alias("rarest"), F.count("word").alias("known"))
    tokens = materialised(ranked.filter(F.col("known") == F.size("words")).select(
        F.col("rarest.word").alias("word"), F.col("rarest.place").alias("place"), "words", "item"), "tokens")
    tokens = tokens.groupBy("word", "place", F.col("words").alias("wanted")).agg(F.collect_list("item").alias("items"))
    each = rows.select("row", F.split("words", " ").alias("all")).select(
        "row", "all", F.size("all").alias("n"), F.posexplode("all").alias("pos", "word"))
    found = each.join(F.broadcast(tokens), "word").withColumn("start", F.col("pos") - F.col("place"))
    inside = (F.col("start") >= 0) & (F.col("start") + F.size("wanted") <= F.col("n"))
    exact = found.filter(inside).filter(F.slice("all", F.col("start") + 1, F.size("wanted")) == F.col("wanted"))
    return exact.select("row", "start", F.size("wanted").alias("width"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, key (md5 of the text), n_words, n_hit, n_items, items (sorted ids), contaminated."""
    rows = materialised(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.md5("text").alias("key"),
                                    normal_words(text_or_empty("text")).alias("words")), "doc-words")
    windows = materialised(item_windows(benchmark, window), "windows")
    total = rows.select("row", "doc_id", "key", F.size(_split("words")).cast("long").alias("n_words"))
    found = None
    for block in _blocks(windows):
        part = materialised(_occurrences(rows.select("row", "words"), block), "occurrences")
        found = part if found is None else found.union(part)
    if found is None:
        hits = total.select("row", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).limit(0)
    else:
        covered = F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("width") - 1)))
        ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
        hits = found.groupBy("row").agg(F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), ids.alias("items"))
    out = total.join(hits, "row", "left").drop("row")
    return out.withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", F.array().cast("array<string>")),
    }).withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
