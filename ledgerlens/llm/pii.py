"""Personal data by candidate gradient boosting.

Per kind a strict base pattern with a validity rule marks sure spans, and a loose generator proposes
more, which may overlap them: addresses written with ``(at)``, ip addresses with bracketed or spelled dots, card
numbers with dots or several marks between their groups, phones without a country code, groups that miss a rule. Boosted trees (MLlib) score every proposal from its format and its context. They learn
from a bounded sample of each kind's distinct proposals: one that lies in a valid base span of its kind is positive,
any other negative. The features leave out the marks that only the base patterns know (``@``, ``+``, plain dots, single
separators), so a proposal without them can look like a positive one. A threshold per kind is calibrated on all proposals that are not in the
sample (at least about half of them): the score that ``RECALL`` of the kind's positive proposals reach, if at least ``PRECISION`` of all that
reach it are positive (the rest are unmarked spans or errors), else none. Proposals over it that overlap no
base span are added; base spans always stay.

Positions come from the pieces between the matches: a match starts after all earlier pieces and matches.
Runs of one character class are matched possessively and only from their start (``\\G`` allows the end of the
last match), so long runs take linear time and find the same matches as the plain patterns.

Defined cases: NULL text is an empty text without spans; repeated rows are separate documents; without
positive and negative proposals in the sample nothing is added; spans are code points, end exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.text import text_or_empty
from ledgerlens.operators.ranges import running_totals
from ledgerlens.session import materialised

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000          # proposals that the trees are fitted on, at most; an equal share for each kind
RECALL, PRECISION = 0.8, 0.8
TREES, DEPTH = 12, 4

# Base patterns of the four kinds, with possessive runs.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
_DOMAIN = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
BASE = {
    "email": _LOCAL + "@" + _DOMAIN,
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DOT = r"\x20?(?:[.,]|\[\.\]|\(\.\)|\[dot\]|\(dot\)|(?<=\x20)dot(?=\x20))\x20?"
# Loose generators; ip and card also propose what their own base rule rejects.
LOOSE = {
    "email": _LOCAL + r"\x20?(?:@|\(at\)|\[at\])\x20?" + _DOMAIN,
    "ip": r"(?<![0-9])[0-9]{1,3}(?:" + _DOT + r"[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,3}[0-9]){15,18}+(?![0-9])",
    "phone": r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{2,4}[\x20.-][0-9]{3,5}(?![0-9])",
}
# Per (kind, strict), what every match of the pattern holds: a text without it has none, and the pattern is not run.
MARKS = {("email", True): "@", ("email", False): r"@|\(at\)|\[at\]",
         ("ip", False): r"[0-9]\x20?[.,\[(d]", ("card", False): r"[0-9][\x20._/-]{0,3}[0-9]", ("phone", True): r"\+[0-9]", ("phone", False): "[0-9][0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_HINTS = {"email": "mail|contact|write", "ip": "ip|host|server|addr", "card": "card|visa|pay|account",
          "phone": "phone|tel|call|fax|mobile"}
FEATURES = ("kind", "length", "digits", "letters", "marks", "groups", "longest", "luhn", "octets", "hint",
            "before_letter", "after_letter", "before_digit", "after_digit")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def passes_luhn(c: Column) -> Column:
    """Luhn's check over the digits of ``c``; false without digits."""
    d = F.transform(F.split(F.reverse(_digits(c)), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return (F.length(_digits(c)) > 0) & (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0)


def is_valid(kind: Column, match: Column) -> Column:
    """Whether a base match keeps to its kind's rule."""
    n = F.length(_digits(match))
    return (F.when(kind == "email", F.lit(True))
            .when(kind == "ip", match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
            .when(kind == "card", n.between(16, 19) & passes_luhn(match))
            .otherwise(n.between(8, 15)))


def _matches(text: Column, kind: str, strict: bool, pattern: str) -> Column:
    """Matches with the length of the piece before each, 16 characters before and one after it."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    # computed only for texts with a match
    pieces = F.when(F.size(found) > 0, F.split(text, pattern))
    rows = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), F.slice(pieces, 2, F.size(pieces)), lambda a, b: F.struct(
        F.char_length(a).alias("gap"), F.right(a, F.lit(16)).alias("before"), F.left(b, F.lit(1)).alias("after")))
    rows = F.transform(F.arrays_zip(rows.alias("p"), found.alias("m")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), i.alias("i"), x["p"]["gap"].alias("gap"),
        x["p"]["before"].alias("before"), x["p"]["after"].alias("after"), x["m"].alias("match")))
    rows = F.when(F.size(found) > 0, rows)
    return F.when(text.rlike(MARKS[kind, strict]), rows) if (kind, strict) in MARKS else rows


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: row, doc_id) and (spans: row, doc, kind, strict, start, end, match, before, after); ``doc`` is
    a hash of doc_id."""
    text = F.col("_text")
    generators = [(k, True, p) for k, p in BASE.items()] + [(k, False, p) for k, p in LOOSE.items()]
    found = [F.coalesce(_matches(text, *g), F.array()) for g in generators]
    rows = docs.select("doc_id", text_or_empty("text").alias("_text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*found).alias("found"))
    rows = materialised(rows, "pii")
    each = rows.select("row", F.xxhash64("doc_id").alias("doc"), F.explode("found").alias("s")).select("row", "doc", "s.*")
    upto = Window.partitionBy("row", "kind", "strict").orderBy("i")
    width = F.char_length("match")
    end = F.sum(F.col("gap").cast("long") + width).over(upto)
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - width).drop("gap", "i")
    return rows.select("row", "doc_id"), spans


def with_features(spans: DataFrame) -> DataFrame:
    """Format and context features, as numbers; ``@``, ``(at)`` and ``+`` count as no character of the format, any dot of an
    ip address and any marks between the digits of a card as one."""
    of = F.col("kind")
    bare = (F.when(of == "ip", F.regexp_replace("match", "[^0-9]+", "."))
            .when(of == "card", F.regexp_replace("match", r"[\x20._/-]+", " "))
            .otherwise(F.regexp_replace("match", r"\x20?(?:@|\(at\)|\[at\])\x20?|\+", "")))
    count = lambda p: F.regexp_count(bare, F.lit(p))
    hint = F.lit(False)
    for kind, words in _HINTS.items():
        hint = F.when(F.col("kind") == kind, F.lower("before").rlike(words)).otherwise(hint)
    groups = F.split(bare, "[^0-9]+")
    made = {
        "kind": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "length": F.char_length(bare),
        "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "marks": count("[^0-9A-Za-z]"),
        "groups": F.size(groups), "longest": F.array_max(F.transform(groups, lambda g: F.length(g))),
        "luhn": (F.col("kind") == "card") & passes_luhn(F.col("match")),
        "octets": (F.col("kind") == "ip") & is_valid(F.lit("ip"), bare), "hint": hint,
        "before_letter": F.col("before").rlike("[A-Za-z]$"), "after_letter": F.col("after").rlike("[A-Za-z]"),
        "before_digit": F.col("before").rlike("[0-9]$"), "after_digit": F.col("after").rlike("[0-9]")}
    return spans.withColumns({f"f_{k}": v.cast("double") for k, v in made.items()})


def marked(spans: DataFrame) -> DataFrame:
    """Adds ``base`` (a valid strict span), ``proposal`` (loose, or rejected), ``inside`` (in a base span of its
    kind) and ``clear`` (overlaps no base span)."""
    spans = spans.withColumn("base", F.col("strict") & is_valid(F.col("kind"), F.col("match")))
    spans = spans.withColumns({
        "proposal": ~F.col("strict") | F.col("kind").isin("ip", "card"),
        "base_end": F.when(F.col("base"), F.col("end")), "base_start": F.when(F.col("base"), F.col("start"))})
    onward = Window.partitionBy("row").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    reach_kind = F.max("base_end").over(Window.partitionBy("row", "kind").orderBy("start")
                                        .rangeBetween(Window.unboundedPreceding, 0))
    reach = F.max("base_end").over(Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min("base_start").over(onward)
    return spans.withColumns({
        "inside": F.coalesce(reach_kind >= F.col("end"), F.lit(False)),
        "clear": F.coalesce(reach <= F.col("start"), F.lit(True)) & F.coalesce(ahead >= F.col("end"), F.lit(True))})


def _drawn(proposals: DataFrame, each: int) -> DataFrame:
    """Of every kind the ``each`` distinct proposals of smallest draw, among those of even draws. Copies count once."""
    content = ["kind", "inside", "match", "before", "after"]
    even = proposals.filter(F.pmod("draw", F.lit(2)) == 0)
    parts = [even.filter(F.col("kind") == kind).groupBy(*content).agg(F.min("draw").alias("draw"))
             .orderBy("draw", *content).limit(each) for kind in KINDS]
    return materialised(with_features(reduce(DataFrame.unionByName, parts)), "pii-sample")


def calibrated(scored: DataFrame) -> dict[str, float]:
    """{kind: threshold} from every row of ``scored`` (kind, score, inside): distinct scores with their counts, from the
    highest on."""
    counts = scored.groupBy("kind", "score").agg(F.count("kind").alias("n"), F.count_if("inside").alias("positive"))
    totals = running_totals(counts.withColumn("down", -F.col("score")), ["down"], ["n", "positive"], ["kind"])
    per = totals.groupBy("kind").agg(F.max("cum_positive").alias("all"))
    reached = totals.join(F.broadcast(per), "kind").filter(F.col("cum_positive") > F.floor(RECALL * (F.col("all") - 1)))
    first = reached.filter("all > 0").groupBy("kind").agg(F.max_by(F.struct("score", "cum_n", "cum_positive"), "score").alias("f"))
    found = first.filter(F.col("f.cum_positive") >= PRECISION * F.col("f.cum_n")).select("kind", "f.score").collect()
    return {r["kind"]: r["score"] for r in found}           # one row of each kind at most


def score_proposals(spans: DataFrame, sample: int = SAMPLE):
    """(the proposals of ``spans`` with draw, score and whether the trees were ``fitted`` on it, {kind: threshold}), or None
    if the sample lacks a label. The draw depends on the document, so that copies of a passage have different ones."""
    proposals = spans.filter("proposal").withColumn("draw", F.xxhash64("doc", "kind", "start", "match", "before"))
    drawn = _drawn(proposals, max(1, sample // len(KINDS)))
    if drawn.agg(F.count_distinct("inside")).first()[0] < 2:
        return None
    inputs = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features")
    learned = inputs.transform(drawn.withColumn("label", F.col("inside").cast("double")))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(learned.select("label", "features").repartition(2))
    fitted = F.lit(False)
    for r in drawn.groupBy("kind").agg(F.max("draw").alias("most")).collect():
        fitted = fitted | ((F.col("kind") == r["kind"]) & (F.pmod("draw", F.lit(2)) == 0) & (F.col("draw") <= r["most"]))
    scored = model.transform(inputs.transform(with_features(proposals)))
    scored = materialised(scored.select("row", "kind", "start", "end", "inside", "clear", "draw", fitted.alias("fitted"),
                                        vector_to_array("probability")[1].alias("score")), "pii-scores")
    return scored, calibrated(scored.filter("not fitted"))


def detect(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id and ``found``, the sorted spans (kind number, kind, start, end, base)."""
    rows, spans = find_spans(docs)
    spans = materialised(marked(spans), "pii-spans")
    made = score_proposals(spans, sample)
    chosen = spans.filter("base").select("row", "kind", "start", "end", "base")
    if made:
        scored, thresholds = made
        over = F.lit(False)
        for kind, least in thresholds.items():
            over = over | ((F.col("kind") == kind) & (F.col("score") >= least))
        added = scored.filter("clear").filter(over).select("row", "kind", "start", "end", F.lit(False).alias("base"))
        chosen = chosen.unionByName(added.distinct())
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    found = chosen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        number.alias("number"), "start", "end", "kind", "base"))).alias("found"))
    return rows.join(found, "row", "left").select("doc_id", F.coalesce("found", F.array()).alias("found"))


def digest_spans(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the hash of the base spans and all spans as text."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def redact(text: Column, found: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets (overlapping spans merge into the first)."""
    spans = F.array_sort(found, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    walked = F.aggregate(spans, start, lambda a, s: F.when(s["start"] < a["at"], F.struct(
        a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(F.struct(
            F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                     F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))))
    return F.concat(walked["out"], F.substr(text, (walked["at"] + 1).cast("int")))
