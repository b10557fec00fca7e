"""Quality rules against a plain count, and the divergence against its definition."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality_rules as Q


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def js(p, q):
    total = 0.0
    for k in p.keys() | q.keys():
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        total += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x > 0) / 2
    return math.sqrt(max(0.0, total))


def shares(counts):
    n = sum(counts.values())
    return {k: v / n for k, v in counts.items()} if n else {}


def classes(text):
    out = {name: len(re.findall(p, text)) for name, p in Q.CLASSES.items()}
    return Counter(out | {"lower": len(text) - sum(out.values())})


def distances(rows):
    """[(class distance, word distance)] of (text, lang), None without a reference."""
    def words(text):
        return re.findall(r"[^\W\d_]+", (text or "").lower())
    by = {}
    for text, lang in rows:
        if lang is not None:
            chars, counts = by.setdefault(lang, (Counter(), Counter()))
            chars.update(classes(text or ""))
            counts.update(words(text))
    out = []
    for text, lang in rows:
        if lang is None or sum(by[lang][1].values()) < Q.LEAST_REFERENCE:
            out.append((None, None))
            continue
        chars, counts = by[lang]
        common = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:Q.COMMON]

        def bins(c):
            kept = Counter({w: c[w] for w in common if c[w]})
            return shares(kept + Counter({None: sum(c.values()) - sum(kept.values())}))
        out.append((js(shares(classes(text or "")), shares(chars)), js(bins(Counter(words(text))), bins(counts))))
    return out


@pytest.fixture(scope="module")
def rows(odd_rows):
    """Documents of two invented languages, with junk among them, and the odd ones."""
    rnd = random.Random(3)
    vocabulary = {lang: ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(150)]
                  for lang, letters in (("aa", "abcdefghij"), ("bb", "klmnoprstué"))}
    out = [(k, t, lang) for k, t, lang, _, _ in odd_rows]
    for k in range(160):
        lang = ("aa", "bb")[k % 2]
        w = rnd.choices(vocabulary[lang], [1 / (i + 1) for i in range(150)], k=rnd.randint(60, 300))
        text = "\n".join(" ".join(w[i:i + 11]).capitalize() + "." for i in range(0, len(w), 11))
        if k % 20 == 4:                                       # the other language
            lang = ("aa", "bb")[(k + 1) % 2]
        if k % 20 == 7:
            text = " | ".join(f"{rnd.randint(0, 10**6)}" for _ in range(60))
        if k % 20 == 9:
            text += ("\n" + text.split("\n")[0]) * 9
        out.append((1000 + k, text, lang))
    return out + [(2000, " ".join(["word"] * 400), "aa"), (2001, None, None), (2002, "a\nb\na\n \n \nb", "aa"), (2003, "x " * 3000, "cc")]


def test_base_counts(spread, rows):
    docs = spread.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = {r.doc_id: r for r in Q.quality_report(docs).collect()}
    assert len(got) == len(rows)
    for k, text, _ in rows:
        r, want = got[k], base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert sum(base(t)[4] > 0 for _, t, _ in rows) > 5 and sum(base(t)[3] > 0 for _, t, _ in rows) > 5


def test_divergence(spread, rows):
    docs = spread.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = {r.doc_id: r for r in Q.quality_report(docs).collect()}
    for (k, text, _), (chars, words) in zip(rows, distances([(t, lang) for _, t, lang in rows])):
        r = got[k]
        if chars is None:
            assert r.class_distance is None and r.kept == (not r.base_failed)
            continue
        assert r.class_distance == pytest.approx(chars, abs=1e-7) and r.word_distance == pytest.approx(words, abs=1e-7)
        n, m = len(text or ""), len(re.findall(r"[^\W\d_]+", text or ""))
        far = (n >= Q.CLASS_LEAST and chars > Q.CLASS_BASE + Q.CLASS_NOISE / math.sqrt(n)) or (
            m >= Q.WORD_LEAST and words > Q.WORD_BASE + Q.WORD_NOISE / math.sqrt(m))
        assert r.kept == (not r.base_failed and not far)
    of = {k: got[1000 + k].kept for k in range(160)}
    clean = [k for k in of if k % 20 not in (4, 7, 9)]
    assert sum(of[k] for k in clean) >= 0.98 * len(clean)                       # clean documents stay
    assert not any(of[k] for k in of if k % 20 in (4, 7))                       # other language, numbers


def test_equal_hashes_of_other_windows(spark, monkeypatch):
    """Windows that only share their hash are not repeated."""
    monkeypatch.setattr(Q.F, "xxhash64", lambda *c: Q.F.length(Q.F.concat_ws("", *[x.cast("string") for x in c])).cast("long"))
    texts = ["aa bb cc dd ee ff gg hh", "a b c d e a b c d e", "p q r s t u v w x p q r s t"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("_words", F.split("text", " "))
    got = {r.text: r.n_repeat_words for r in Q.repeated_words(rows).collect()}
    assert got == {t: base(t)[4] for t in texts}


def test_odd_rows(spark, no_docs):
    assert Q.quality_report(no_docs).count() == 0 and Q.without_poor_documents(no_docs).count() == 0
    good = "every one of these eleven words is here only once today"
    rows = [(None, good, None), (None, good, None), (1, good, "aa"), (1, None, "aa"), (2, "too few", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {"kept": F.lit("mine"), "key": F.lit(1), "classes": F.lit(0), "_words": F.lit(5), "word": F.lit("w")})
    out = Q.without_poor_documents(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.filter(F.col("text") == good).collect()))
