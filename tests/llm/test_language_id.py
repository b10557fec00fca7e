"""Rank-order profiles against a plain implementation, held-out accuracy, and texts without letters."""

import collections
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm.language_id import Profiles, accepted, learn_profiles, ngram_codes, predict_languages
from ledgerlens.llm.text import table


def _plain_ngrams(text):
    counts = collections.Counter()
    runs = re.findall(r"[^\W\d_]+", text.lower())
    for run in runs:
        padded = f"\x01{run}\x01"
        counts.update(run)
        counts.update(padded[i:i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i:i + 3] for i in range(len(padded) - 2))
    return counts


def _code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_ngrams_equal_a_plain_count():
    for text in ["The cat, the hat.", "Ünï 12 çödé--x", "a", "日本 語", "\n. ,"]:
        codes, counts = np.unique(ngram_codes(text), return_counts=True)
        assert dict(zip(codes.tolist(), counts.tolist())) == {_code(g): n for g, n in _plain_ngrams(text).items()}


def test_out_of_place_distance_by_hand():
    p = Profiles({"x": np.array([_code("a"), _code("b")]), "y": np.array([_code("b"), _code("a")])}, most=2)
    # of "bb a": b is first and a second among the two most frequent
    assert p.nearest("bb bb a")[0] == "y"
    assert p.nearest("123") == ("und", 0.0) and p.nearest(None) == ("und", 0.0)


def test_accuracy_on_held_out_documents(spark, smoke_dir):
    docs = table(spark, smoke_dir, "documents", "doc_id", "text", "lang")
    found = predict_languages(docs).join(docs, "doc_id").filter("held_out")
    n, good = found.agg(F.count("doc_id"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 20 and good >= 0.95 * n


def test_odd_rows(odd_docs, no_docs):
    got = {(r.doc_id): r for r in predict_languages(odd_docs).collect()}
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert len(got) == len(texts)
    for k, r in got.items():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[k] or "")) and 0 <= r.score <= 1
    assert predict_languages(no_docs).count() == 0
    assert accepted(odd_docs, learn_profiles(odd_docs), 0.0).columns == odd_docs.columns
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in predict_languages(unlabelled).collect()} == {"und"}
