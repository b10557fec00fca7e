"""Three-line windows against a brute-force version."""

import hashlib
import re

from pyspark.sql import functions as F

from ledgerlens.llm.line_dedup import line_report, without_repeated_lines


def brute(rows):
    """{doc_id: (n_lines, kept text)} with unique ids."""
    first = {}
    windows = {}
    for doc, text in sorted(rows, key=lambda r: (r[0], hashlib.md5((r[1] or "").encode()).hexdigest())):
        lines = [x.strip(" ") for x in (text or "").split("\n")]
        windows[doc] = [tuple(lines[i:i + 3]) for i in range(len(lines) - 2)]
        for i, w in enumerate(windows[doc]):
            first.setdefault(w, (doc, i))
    out = {}
    for doc, text in rows:
        gone = set()
        for i, w in enumerate(windows[doc]):
            if re.search(r"[^\W_]", "".join(w)) and first[w] != (doc, i):
                gone |= {i, i + 1, i + 2}
        raw = (text or "").split("\n")
        out[doc] = (0 if text is None else len(raw), len(gone), "\n".join(x for i, x in enumerate(raw) if i not in gone))
    return out


def test_equals_brute_force(spread, odd_rows, odd_docs):
    want = brute([r[:2] for r in odd_rows])
    got = {r.doc_id: r for r in line_report(odd_docs).collect()}
    assert {k: (r.n_lines, r.n_removed) for k, r in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(got[k].kept_sha256 == hashlib.sha256(v[2].encode()).hexdigest() for k, v in want.items())
    assert sum(v[1] for v in want.values()) > 10


def test_odd_rows(spark, no_docs):
    text = "first line\nsecond line\nthird line\nfourth line"
    rows = [(None, text), (None, text), (1, text), (1, text), (2, text), (3, None), (4, "first line\nsecond line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"n_lines": F.lit(0), "covered": F.lit("mine"), "hash": F.lit(1)})
    out = without_repeated_lines(docs)
    assert set(out.columns) == {"doc_id", "text", "n_lines", "covered", "hash", "n_removed"}
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_lines, r.n_removed, r.text, r.covered) for r in out.collect()),
                 key=repr)
    # rows without doc_id come first in the order, so they keep the lines; both of them are one text
    assert got == sorted([(False, 0, 4, 0, text, "mine")] * 2 + [(True, 1, 4, 4, "", "mine")] * 2
                         + [(True, 2, 4, 4, "", "mine"), (True, 3, 0, 0, None, "mine"),
                            (True, 4, 2, 0, "first line\nsecond line", "mine")], key=repr)
    assert without_repeated_lines(no_docs).count() == 0
