"""Filter audit against counting every order one document at a time."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from ledgerlens.llm.filter_audit import audit_filters, failing_ids, failures_after_sets, checked_documents

LABELS = "doc_id long, quality int, toxic int"


def failing(rows):
    """The letters of the filters that each (doc_id, text, source) fails."""
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": doc is not None and doc > first[text]}
        out.append({k for k, v in tests.items() if v})
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    fails = failing(rows)
    out, shapley = {}, Counter()
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                shapley[part, name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f for _, f in mine) - len(gone), sum(f == {name} for _, f in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    return {k: tuple(v) + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def table(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
             for r in rows}
    assert len(found) == len(rows)
    return found


def long_texts(odd_rows):
    rows = [(d, t, s) for d, t, _, s, _ in odd_rows]
    words = " ".join(f"w{k}" for k in range(250))
    return rows + [(200 + k, words + extra, f"s{k % 2}") for k, extra in enumerate(["", "", " #", " ABCDEFGHIJ" * 40, " x" * 400, " #" * 400, "", " %"])]


def test_equals_brute_force(spread, odd_rows):
    rows = long_texts(odd_rows)
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 210, 3)] + [(3, 1, 1), (6, None, None), (None, 1, 1)]
    docs = spread.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = table(audit_filters(docs, spread.createDataFrame(labels, LABELS)))
    want = brute(rows, labels)
    assert got == want
    assert {f for x in failing(rows) for f in x} == set("ABCDE") and min(map(len, failing(rows))) == 0


def test_relations(spread, odd_rows):
    """One id table per filter; a failure is listed with every set of other filters."""
    rows = long_texts(odd_rows)
    tested = checked_documents(spread.createDataFrame(rows, "doc_id long, text string, source string")).cache()
    relations = failing_ids(tested, "ABCDE")
    sizes = {f: r.count() for f, r in relations.items()}
    assert sizes == Counter(f for x in failing(rows) for f in x)
    failures = failures_after_sets(relations)
    assert failures.count() == 16 * sum(sizes.values()) == failures.select("id", "filter", "earlier").distinct().count()


def test_odd_rows(spark, no_docs):
    no_labels = spark.createDataFrame([], LABELS)
    assert audit_filters(no_docs, no_labels).count() == 0
    rows = [(None, "same", None), (None, "same", ""), (1, "same", None), (1, "same", None), (2, "same", None), (3, None, "a"), (4, "", "a")]
    labels = [(2, 1, 0), (2, 0, 1), (4, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {"id": F.lit(7), "part": F.lit("mine"), "fails": F.lit("x"), "key": F.lit("k"), "labels": F.lit(0)})
    assert table(audit_filters(docs, spark.createDataFrame(labels, LABELS))) == brute(rows, labels)
    # no labels at all, and none of the documents fails anything
    clean = [(k, " ".join(f"w{k}x{i}" for i in range(220)), "a") for k in range(3)]
    got = table(audit_filters(spark.createDataFrame(clean, "doc_id long, text string, source string"), no_labels))
    assert len(got) == 600 and set(got.values()) == {(3, 0, 0, 0, 0, 0, 0)}
