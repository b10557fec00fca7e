"""Quality rules: counts of repetition and symbols, and divergence from the language's usual text.

Base rules count words, symbols, repeated lines and the words in repeated five-word windows. A document that passes them is
compared with its language (the ``lang`` column) by Jensen-Shannon distance (the root of the divergence in bits, 0 to 1) of
two histograms:

* character classes: lower case and other letters of ASCII, capitals, digits, white space, punctuation, other ASCII, non-ASCII;
* common words: the ``COMMON`` most frequent words of the language, and all other words as one more bin (words are runs of
  letters here, lower-cased).

The references are counted over all documents of a language. A short text is far from any distribution by chance alone, by
about one over the root of its length, so the allowed distance is a base plus such a term, and below a minimum length a
histogram is not judged at all; nor is it against a reference of few words. A document is kept unless a histogram is too far.

The texts are read twice: once for the common words, once for everything that is counted inside a row. What is written
between is a few numbers and word counts per document, no text. Windows are compared by 64-bit hashes, and those of equal
hash again by their words, so the counts are exact.

Defined cases: NULL text has no word and fails the base rules; NULL language, or one with little text, has no
reference: the base rules decide; rows of equal (doc_id, text) get the counts of one text and go together; other columns of any name are kept by
``without_poor_documents``; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.text import broadcast_if_few, packed, same_document, text_or_empty, unpacked
from ledgerlens.session import materialised

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, REPEATED_PERCENT, SPAN = 10, 20, 5
COMMON = 100                       # words of a language's reference
LEAST_REFERENCE = 1000             # words of a language; fewer make no reference
# a histogram of n items is judged from LEAST items on and may be BASE + NOISE / sqrt(n) away
CLASS_LEAST, CLASS_BASE, CLASS_NOISE = 200, 0.15, 3.0
WORD_LEAST, WORD_BASE, WORD_NOISE = 50, 0.10, 4.0

CLASSES = {
    "upper": r"[A-Z]",
    "digit": r"[0-9]",
    "space": r"[\x20\x09-\x0D]",
    "punctuation": r"[.,;:!?'\"()-]",
    "symbol": r"[#$%&*+/<=>@\[\\\]^_`{|}~\x00-\x08\x0E-\x1F\x7F]",
    "other": r"[^\x00-\x7F]",
}


def letter_words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def common_words(docs: DataFrame, most: int = COMMON) -> DataFrame:
    """(lang, word): the ``most`` frequent words of each language, of equally frequent ones the smaller."""
    words = docs.filter("lang IS NOT NULL").select("lang", F.explode(letter_words("text")).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("lang", "word")


def _neighbours(sorted_items: str, field: str) -> Column:
    """The positions of a sorted array of structs whose ``field`` equals that before or after."""
    def at(k):
        return F.get(F.col(sorted_items), k)[field]
    ks = F.sequence(F.lit(0), F.size(sorted_items) - 1)
    return F.filter(F.when(F.size(sorted_items) > 0, ks), lambda k: at(k).eqNullSafe(at(k - 1)) | at(k).eqNullSafe(at(k + 1)))


def repeated_words(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """``rows`` with ``n_repeat_words``: how many of ``_words`` are in a window of ``span`` words that occurs again in them."""
    starts = F.when(F.size("_words") >= span, F.sequence(F.lit(0), F.size("_words") - span))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    # word by word: slice() copies the whole array each time
    rows = rows.withColumn("_windows", F.transform(starts, lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(span)])))
    # windows of equal hash, which most texts have none of
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn("_sorted", F.when(again, F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty))
    # and of these the ones of equal words
    rows = rows.withColumn("_alike", F.transform(_neighbours("_sorted", "h"), lambda k: F.get(F.col("_sorted"), k)["i"]))
    rows = rows.withColumn("_alike", F.sort_array(F.transform("_alike", lambda i: F.struct(
        F.concat_ws(" ", *[F.get("_words", i + k) for k in range(span)]).alias("w"), i.alias("i")))))
    rows = rows.withColumn("_at", F.sort_array(F.transform(_neighbours("_alike", "w"), lambda k: F.get(F.col("_alike"), k)["i"])))
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(-span).alias("last")), lambda a, i: F.struct(
        (a["n"] + F.least(F.lit(span), i - a["last"])).alias("n"), i.alias("last")))["n"]
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "_hashes", "_windows", "_sorted", "_alike", "_at")


def measures(docs: DataFrame, common: list[str]) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, key (md5 of the text), lang, the base counts, ``classes`` (count
    per character class, lower case first), ``n_letter_words`` and ``common`` (word -> count, of the words of any reference)."""
    rows = docs.select("doc_id", "lang", F.md5("text").alias("key"), text_or_empty("text").alias("text"))
    rows = rows.withColumns({"_words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), "_tokens": letter_words("text"),
                             "_lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))})
    rows = rows.withColumn("_common", F.sort_array(F.filter("_tokens", lambda w: w.isin(common))))
    counts = [F.regexp_count("text", F.lit(p)).cast("long").alias(name) for name, p in CLASSES.items()]
    rows = rows.select(
        "doc_id", "key", "lang", "_words", "_common", F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_tokens").cast("long").alias("n_letter_words"), F.char_length("text").cast("long").alias("_chars"),
        F.struct(*counts).alias("_classes"))
    rows = repeated_words(rows)
    # runs of equal words in the sorted array
    ks = F.when(F.size("_common") > 0, F.sequence(F.lit(0), F.size("_common") - 1))
    rows = rows.withColumn("_starts", F.coalesce(F.filter(ks, lambda k: ~F.get(F.col("_common"), k).eqNullSafe(F.get(F.col("_common"), k - 1))),
                                                 F.array().cast("array<int>")))
    runs = F.transform("_starts", lambda k, j: F.struct(
        F.get(F.col("_common"), k).alias("word"),
        (F.coalesce(F.get(F.col("_starts"), j + 1), F.size("_common")) - k).cast("long").alias("n")))
    classes = [F.col("_classes")[name] for name in CLASSES]
    return rows.select("doc_id", "key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "n_letter_words", F.array(F.col("_chars") - sum(classes), *classes).alias("classes"),
                       runs.alias("common"))


def references(measured: DataFrame, common: DataFrame, least: int = LEAST_REFERENCE) -> DataFrame:
    """(lang, class_shares, word_shares): for each language its share of every class and of each of its common words."""
    n_classes = len(CLASSES) + 1
    sums = measured.filter("lang IS NOT NULL").groupBy("lang").agg(
        F.sum("n_letter_words").alias("words"), *[F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(n_classes)])
    sums = sums.filter(F.col("words") >= least)
    chars = sum(F.col(f"c{k}") for k in range(n_classes))
    shares = F.array(*[F.col(f"c{k}").cast("double") / chars for k in range(n_classes)])
    counts = measured.select("lang", F.inline("common")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = counts.join(common, ["lang", "word"], "left_semi").join(sums.select("lang", "words"), "lang")
    words = counts.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct(      # COMMON words at most
        "word", F.col("n").cast("double") / F.col("words")))).alias("word_shares"))
    return sums.select("lang", shares.alias("class_shares")).join(words, "lang")


def _gain(p: Column, q: Column) -> Column:
    """The part of the Jensen-Shannon divergence, in bits, of a bin with shares p and q."""
    def side(a):
        return F.when(a > 0, a * F.log2(2 * a / (p + q))).otherwise(0.0)
    return (side(p) + side(q)) / 2


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), divergence)))


def class_distance() -> Column:
    """Distance of ``classes`` from ``class_shares``."""
    total = F.greatest(sum(F.get("classes", F.lit(k)) for k in range(len(CLASSES) + 1)), F.lit(1))
    return _distance(sum(_gain(F.get("classes", F.lit(k)).cast("double") / total, F.get("class_shares", F.lit(k)))
                         for k in range(len(CLASSES) + 1)))


def word_distance(rows: DataFrame) -> DataFrame:
    """``rows`` with ``word_distance``: of ``common`` in ``n_letter_words`` from ``word_shares``.

    A bin that the document lacks adds half its share, so only the document's own words are looked up."""
    n = F.greatest(F.col("n_letter_words"), F.lit(1))
    rows = rows.withColumn("_bins", F.filter(F.transform("common", lambda x: F.struct(
        (x["n"].cast("double") / n).alias("p"), F.try_element_at("word_shares", x["word"]).alias("q"))), lambda x: x["q"].isNotNull()))

    def total(value):
        return F.aggregate("_bins", F.lit(0.0), lambda a, x: a + value(x))
    rows = rows.withColumns({"_p": total(lambda x: x["p"]), "_q": total(lambda x: x["q"]),
                             "_gained": total(lambda x: _gain(x["p"], x["q"])),
                             "_all": F.aggregate(F.map_values("word_shares"), F.lit(0.0), lambda a, x: a + x)})
    other = F.when(F.col("n_letter_words") > 0, F.greatest(F.lit(0.0), 1 - F.col("_p"))).otherwise(0.0)
    rest = _gain(other, F.greatest(F.lit(0.0), 1 - F.col("_all")))
    missing = F.greatest(F.lit(0.0), F.col("_all") - F.col("_q")) / 2
    return rows.withColumn("word_distance", _distance(F.col("_gained") + missing + rest)).drop("_bins", "_p", "_q", "_gained", "_all")


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance (NULL without a reference), kept."""
    docs = docs.select("doc_id", "text", "lang")
    common = materialised(common_words(docs), "common-words")
    listed = sorted({r["word"] for r in common.select("word").distinct().collect()})     # languages x COMMON
    measured = materialised(measures(docs, listed or [""]), "quality-measures")
    # a written table of one row per language, whose size the planner knows
    found = measured.join(materialised(references(measured, common), "quality-references"), "lang", "left")
    found = word_distance(found.withColumn("class_distance", class_distance()))
    known = F.col("class_shares").isNotNull()
    found = found.withColumns({c: F.when(known, F.col(c)) for c in ("class_distance", "word_distance")})

    def far(distance, n, least, base, noise):
        return (n >= least) & (F.col(distance) > base + noise / F.sqrt(n))
    chars = sum(F.get("classes", F.lit(k)) for k in range(len(CLASSES) + 1))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    unlike = F.coalesce(far("class_distance", chars, CLASS_LEAST, CLASS_BASE, CLASS_NOISE), F.lit(False)) | F.coalesce(
        far("word_distance", F.col("n_letter_words"), WORD_LEAST, WORD_BASE, WORD_NOISE), F.lit(False))
    return found.select("doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), "class_distance", "word_distance", (~failed & ~unlike).alias("kept"))


def without_poor_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    gone = quality_report(docs).filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    rows = packed(docs).join(broadcast_if_few(gone), same_document("_row.doc_id", "_md5", "_id", "_key"), "left_anti")
    return unpacked(rows, docs.columns)
