"""Source divergence audit: how the sources of a language differ in their terms.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Each language keeps the terms of at least
``MIN_DOCS`` of its documents. A group (language, source), and the language as a whole, gives each kept term the smoothed
share ``p = 1 + floor(10^9 (count + 1) / (N + V))`` in billionths (N: occurrences of kept terms there, V: kept terms). The
divergence of p from q is ``floor((p - q)^2 / q)``, summed over the kept terms for a pair of sources, and term by term for
a source against its language.

Identical texts of a language are collapsed first: one row per (language, text) with the number of its copies in each
source. That row is tokenized once, and its counts and document frequencies are weighted by the copies, so a text that a
third of all rows share costs one text. Python sums up a bounded number of terms before it hands them to Spark.

Pairs are evaluated sparsely. A term that neither source has adds the same value each time, a term of one source adds what
depends on its share alone (summed over the distinct shares of a group), and only terms of both sources are compared
one by one: blocks of terms, as numpy arrays of (terms x sources x sources), leave a block as one sum per pair.

All numbers are integers; shares are divided as decimals, so no count overflows.

Defined cases: NULL text, language or source is an empty string; a group without terms, or of a language that keeps none,
has pairs (0 where nothing is kept) and no terms; a source alone in its language has no pair; repeated rows are separate
documents; doc_id and other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.text import text_or_empty
from ledgerlens.session import materialised

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
_PENDING = 200_000       # terms that a task sums up before it hands them on
_CELLS = 1 << 19         # of an array of comparisons

# letters and non-ASCII bytes stay, A-Z become a-z, all else separates
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def collapsed_texts(docs: DataFrame) -> DataFrame:
    """(lang, text, copies): every distinct text of a language with [(source, n)], its copies in each source."""
    rows = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"),
                       text_or_empty("text").alias("text")).filter("text <> ''")
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    copies = rows.groupBy("lang", "key", "source").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.groupBy("lang", "key").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = rows.groupBy("lang", "key").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "key"]).select("lang", "text", "copies")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def handed_on():
        for (lang, source), seen in counts.items():
            terms = list(seen)
            held = docs[lang, source]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(terms), pa.string()), "source": pa.array([source] * len(terms), pa.string()),
                "term": pa.array(terms, pa.binary()).cast(pa.string()), "n": pa.array([seen[t] for t in terms], pa.int64()),
                "docs": pa.array([held[t] for t in terms], pa.int64())})
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, text, copies in zip(*(batch[c].to_pylist() for c in ("lang", "text", "copies"))):
            terms = text.encode().translate(_TERM_BYTES).split()
            distinct = Counter(terms)
            for copy in copies:
                group, n = (lang, copy["source"]), copy["n"]
                seen, held = counts.setdefault(group, Counter()), docs.setdefault(group, Counter())
                if n == 1:
                    seen.update(terms)
                    held.update(distinct.keys())
                else:
                    seen.update({t: n * k for t, k in distinct.items()})
                    held.update(dict.fromkeys(distinct, n))
            if sum(map(len, counts.values())) > _PENDING:
                yield from handed_on()
    yield from handed_on()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, uses): the terms of at least ``min_docs`` documents of a language, with [(source, n)]."""
    found = collapsed_texts(docs).mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    # dealt by term once, for both groupings
    per = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = per.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("uses"))
    return terms.filter(F.col("docs") >= min_docs).select("lang", "term", "total", "uses")


def _share(n: Column | str, total: str, kept: str) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    whole = F.greatest(F.col(total) + F.col(kept), F.lit(1)).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), whole)


def _divergence(p: Column | str, q: Column | str) -> Column:
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def source_groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, lang_n, v, absent): every occurring group, its and its language's occurrences of kept terms,
    the language's kept terms, and the group's share of a term that it lacks."""
    groups = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct()
    sizes = kept.select("lang", F.inline("uses")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count(F.lit(1)).alias("v"))
    out = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "lang_n", "v"])
    return out.withColumn("absent", _share(F.lit(0), "n", "v"))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value) of a batch of terms: for each pair of sources that share terms, what these terms' divergence
    has beyond the parts that each source has alone."""
    def divergence(p, q):
        d = p - q
        return d * d // q

    for batch in batches:
        uses = batch["uses"]
        starts, flat = uses.offsets.to_numpy(), uses.values
        size = np.diff(starts)
        lang = batch["lang"].dictionary_encode()
        source = flat.field("source").dictionary_encode()
        share, absent = (flat.field(c).to_numpy() for c in ("p", "absent"))
        n = len(source.dictionary)
        group = np.repeat(lang.indices.to_numpy().astype(np.int64), size) * n
        group += source.indices.to_numpy()[starts[0]:starts[-1]]
        n_groups = n * len(lang.dictionary)
        begin = starts[:-1] - starts[0]
        share, absent = share[starts[0]:starts[-1]], absent[starts[0]:starts[-1]]
        pairs, values = [], []
        for s in np.unique(size):
            at = begin[size == s][:, None] + np.arange(s)             # terms of s sources
            for term in range(0, len(at), max(1, _CELLS // (s * s))):
                some = at[term:term + max(1, _CELLS // (s * s))]
                for k in range(0, s, max(1, _CELLS // (len(some) * s))):
                    x, y = some[:, k:k + max(1, _CELLS // (len(some) * s)), None], some[:, None, :]
                    p, q, p0, q0 = share[x], share[y], absent[x], absent[y]
                    more = divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0)
                    pair, back = np.unique((group[x] * n_groups + group[y]).ravel(), return_inverse=True)
                    value = np.zeros(len(pair), np.int64)
                    np.add.at(value, back, more.ravel())
                    pairs.append(pair)
                    values.append(value)
        if not pairs:
            continue
        pair, back = np.unique(np.concatenate(pairs), return_inverse=True)
        value = np.zeros(len(pair), np.int64)
        np.add.at(value, back, np.concatenate(values))
        of, other = np.divmod(pair, n_groups)
        differ = of != other
        of, other, value = of[differ], other[differ], value[differ]
        yield pa.RecordBatch.from_pydict({
            "lang": lang.dictionary.take(pa.array(of // n)), "source": source.dictionary.take(pa.array(of % n)),
            "item": source.dictionary.take(pa.array(other % n)), "value": value})


def pair_divergence(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of every source from every other one of its language.

    ``shares``: (lang, term, source, p, absent) of the terms that a group has."""
    item = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("item_absent"))
    none = _divergence("absent", "item_absent")
    pairs = groups.join(item, "lang").filter("source <> item")
    lacking = pairs.select("lang", "source", "item", (F.col("v") * none).alias("value"))
    # terms of one source, by the distinct shares it gives them
    distinct = shares.groupBy("lang", "source", "p", "absent").agg(F.count(F.lit(1)).alias("terms"))
    one = distinct.join(item, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.col("terms") * (_divergence("p", "item_absent") - none)).alias("forth"),
        F.sum(F.col("terms") * (_divergence("item_absent", "p") - _divergence("item_absent", "absent"))).alias("back"))
    there = F.struct("source", "item", F.col("forth").alias("value"))
    back = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))
    one = one.select("lang", F.inline(F.array(there, back)))
    terms = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "absent")).alias("uses"))
    both = terms.filter(F.size("uses") > 1).select("lang", "uses").mapInArrow(
        _compared, "lang string, source string, item string, value long")
    return lacking.unionByName(one).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def distinctive_terms(shares: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms with a larger share in the group than in its language, and their divergence.

    ``shares``: as above, with the language's ``total`` of the term, ``lang_n`` and ``v``."""
    q = _share("total", "lang_n", "v")
    return shares.withColumn("q", q).filter("p > q").select(
        "lang", "source", F.col("term").alias("item"), _divergence("p", "q").alias("value"))


def _by_rank(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: every group's divergence from each other source of its
    language, and its ``top`` distinctive terms."""
    kept = materialised(kept_terms(docs, min_docs), "kept-terms")
    groups = materialised(source_groups(docs, kept), "source-groups")
    uses = kept.select("lang", "term", "total", F.inline("uses")).withColumnRenamed("n", "used")
    shares = uses.join(groups, ["lang", "source"]).withColumn("p", _share("used", "n", "v"))
    terms = _by_rank(distinctive_terms(shares)).filter(F.col("rank") <= top)
    pairs = _by_rank(pair_divergence(shares, groups))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        terms.withColumn("part", F.lit("term")).select(*columns))
