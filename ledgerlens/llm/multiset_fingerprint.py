"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph (non-empty line) is hashed to one wide vector, and a text's fingerprint is the sum of
its paragraphs' vectors modulo powers of two. The sum ignores their order, and a paragraph is inserted
or deleted by adding or subtracting its vector (``combined``). The vector has two parts:

* ``lanes``: 16 lanes of 32 bits, the SHA-512 of the paragraph; they decide equality.
* ``counters``: over the paragraph's phrases (runs of words up to punctuation or a word's final a, e, o
  or y; the cut depends only on the text around it, so an edit moves no far cut), how often each of the
  63 low bits of the phrase's hash is set: three 21-bit fields in each of 21 numbers, modulo 2^62; and the
  number of phrases. ``2 * counter - phrases`` is a sum of random signs, so the scalar product of two
  texts' signed counters estimates how many phrases they share.

``likeness`` is 2 a.b / (a.a + b.b) of the signed counters, cut to 0..1: about the shared part of both
texts, with a standard error near 1/8; equal fingerprints have 1. Beyond 2^20 phrases a counter may carry
into its neighbour: equality still holds, the likeness gets rougher.

Defined cases: a NULL text is an empty one; an empty text has the zero vector, likeness 1 to another
empty one and 0 to any other; repeated rows and ids are ordered by (doc_id, text), NULL ids first; the
document after the last is the first, which for one document is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.text import text_or_empty

LANES, FIELDS, FIELD_BITS = 16, 3, 21
_LANE = 1 << 32
_SUM = (1 << 62) - 1
_FIELD = (1 << FIELD_BITS) - 1
_ONES = sum(1 << (FIELD_BITS * f) for f in range(FIELDS))
_PHRASE_END = r"[ \n](?<=[aeoy\p{Punct}][ \n]|\n)"


def _parts(text: Column) -> tuple[Column, Column, Column]:
    """Paragraph digests and phrase hashes of a text, and the struct (lanes, counters, phrases) made from them."""
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p != "")
    digests = F.transform(paragraphs, lambda p: F.sha2(p, 512))
    phrases = F.transform(F.filter(F.split(text, _PHRASE_END), lambda p: p != ""), lambda p: F.xxhash64(p))

    def lane(i):
        part = lambda h: F.conv(F.substr(h, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
        return F.aggregate(F.col("_digests"), F.lit(0).cast("long"), lambda a, h: (a + part(h)) % _LANE)

    def counter(j):
        return F.aggregate(F.col("_phrases"), F.lit(0).cast("long"),
                           lambda a, x: (a + F.call_function("shiftrightunsigned", x, j).bitwiseAND(F.lit(_ONES)))
                           .bitwiseAND(F.lit(_SUM)))

    # both inputs are used twice, so that the optimizer keeps them as columns instead of
    # computing them again for each lane
    made = F.struct(F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lane).alias("lanes"),
                    F.transform(F.sequence(F.lit(0), F.lit(FIELD_BITS - 1)), counter).alias("counters"),
                    F.size("_digests").cast("long").alias("paragraphs"),
                    F.size("_phrases").cast("long").alias("phrases"))
    return digests, phrases, made


def with_fingerprint(df: DataFrame, text: Column, out: str) -> DataFrame:
    digests, phrases, made = _parts(text)
    return df.withColumns({"_digests": digests, "_phrases": phrases}).withColumn(out, made).drop("_digests", "_phrases")


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the paragraphs of ``a`` with those of ``b`` inserted (``sign`` 1) or deleted (-1)."""
    return F.struct(
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: F.pmod(x + sign * y, F.lit(_LANE))).alias("lanes"),
        F.zip_with(a["counters"], b["counters"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(_SUM))).alias("counters"),
        *[(a[n] + sign * b[n]).alias(n) for n in ("paragraphs", "phrases")])


def as_text(fp: Column) -> Column:
    def wide(values, digits):
        return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), "")
    return F.concat_ws("-", wide(fp["lanes"], 8), wide(fp["counters"], 16), F.hex(fp["paragraphs"]), F.hex(fp["phrases"]))


def signed(fp: Column) -> Column:
    """The counters as sums of signs, an array of doubles."""
    field = lambda f: F.transform(
        fp["counters"],
        lambda c: (2 * F.shiftright(c, FIELD_BITS * f).bitwiseAND(F.lit(_FIELD)) - fp["phrases"]).cast("double"))
    return F.concat(*[field(f) for f in range(FIELDS)])


def likeness(a: Column, b: Column, signed_a: Column, signed_b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = dot(signed_a, signed_a) + dot(signed_b, signed_b)
    ratio = F.when(norms > 0, 2 * dot(signed_a, signed_b) / norms).otherwise(0.0)
    return F.when(a["lanes"] == b["lanes"], 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


def _below(bounds: list, x: Column) -> Column:
    """How many of the sorted ``bounds`` are below ``x`` (NULL: none), by binary search."""
    if not bounds:
        return F.lit(0)
    known = F.array(*map(F.lit, bounds))
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0),
                       lambda n, step: F.when(F.get(known, n + step - 1) < x, n + step).otherwise(n))


def with_successor(docs: DataFrame, payload: list[str], out: str, key: str = "doc_id") -> DataFrame:
    """Add ``out``: the struct of ``payload`` of the next row by (``key``, payload), after the last the first.

    The rows are shuffled once, by ranges of ``key`` whose bounds (as many as there are shuffle partitions) are
    taken from all ids; a bucket's last row gets the first one of the next bucket, a table of one row a bucket.
    What the driver holds is the bounds and one id a bucket.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    at = _below(sorted(set(bounds)), F.col(key))
    by_key = Window.partitionBy("_bucket").orderBy(key, *payload)
    # one lead for each column: a lead of a struct would be built, and shuffled, beside its columns
    rows = docs.withColumn("_bucket", at).withColumns(
        {f"_next_{c}": F.lead(c).over(by_key) for c in payload} | {"_inner": F.lead(F.lit(True)).over(by_key)})
    starts = docs.groupBy(at.alias("_bucket")).agg(F.min(key).alias("start")).orderBy("_bucket").collect()
    behind = dict(zip((r["_bucket"] for r in starts), [r["_bucket"] for r in starts[-1:] + starts[:-1]]))
    firsts = docs.filter(F.col(key).isNull() | F.col(key).isin([r["start"] for r in starts if r["start"] is not None]))
    firsts = firsts.groupBy(at.alias("_own")).agg(F.min(F.struct(key, *payload)).alias("_jump"))
    before = F.create_map(*[F.lit(x) for pair in behind.items() for x in pair]) if behind else F.lit(None)
    firsts = firsts.select((F.element_at(before, F.col("_own")) if behind else F.col("_own")).alias("_bucket"), "_jump")
    rows = rows.join(firsts, "_bucket", "left")
    following = F.struct(*[F.when(F.col("_inner"), F.col(f"_next_{c}")).otherwise(F.col("_jump")[c]).alias(c)
                           for c in payload])
    return rows.withColumn(out, following).drop("_bucket", "_inner", "_jump", *[f"_next_{c}" for c in payload])


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (last half replaced by the first half of the next one)."""
    texts = with_fingerprint(docs.select("doc_id", text_or_empty("text").alias("text")), F.col("text"), "fp")
    pairs = with_successor(texts, ["text", "fp"], "next")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.col("next.text"), half))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("fp_next"),
                         edited.alias("edited"))
    pairs = with_fingerprint(pairs, F.col("edited"), "fp_edited")
    signs = {f"s{name}": signed(F.col(f"fp{name}")) for name in ("", "_edited", "_next")}
    pairs = pairs.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited").withColumns(signs)
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("fp_edited")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fp_edited"), F.col("s"), F.col("s_edited")).alias("near_edited"),
        likeness(F.col("fp"), F.col("fp_next"), F.col("s"), F.col("s_next")).alias("near_next"))
