"""Source divergence against a plain count."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import source_divergence
from ledgerlens.llm.source_divergence import audit_sources, collapsed_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    """{(lang, source, part, item, value, rank)} of (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)}
    return out


def rows_of(df):
    return [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()]


@pytest.fixture(scope="module")
def texts(odd_rows):
    rows = [(t, lang, source) for _, t, lang, source, _ in odd_rows]
    shared = "the same text is in many sources AND counted often Été été"
    rows += [(shared, "en", f"s{k % 5}") for k in range(40)] + [("lone words here", "xx", "a")] * 2
    return rows + [(f"{a} {b} common", lang, f"s{k}") for k in range(6) for lang in ("en", None)
                   for a, b in (("alpha", f"own{k}"), (f"own{k}", "beta"), (f"own{k}", "alpha"), ("gamma", "gamma"))]


@pytest.mark.parametrize("cells", [source_divergence._CELLS, 40])
def test_equals_brute_force(spread, texts, cells, monkeypatch):
    monkeypatch.setattr(source_divergence, "_CELLS", cells)
    monkeypatch.setattr(source_divergence, "_PENDING", 50 if cells == 40 else source_divergence._PENDING)
    got = rows_of(audit_sources(spread.createDataFrame(texts, "text string, lang string, source string").repartition(6)))
    want = brute(texts)
    assert len(got) == len(want) and set(got) == want
    assert len({x[3] for x in want if x[2] == "term"}) > 30


def test_blocks_of_a_block_are_summed():
    """Terms of many sources are compared in parts, with the sum of all pairs unchanged."""
    import numpy as np
    import pyarrow as pa
    rnd = np.random.default_rng(5)
    uses = [[{"source": f"s{s}", "p": int(rnd.integers(2, 10**9)), "absent": 1 + s} for s in range(n)] for n in (2, 30, 30, 7)]
    kind = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("absent", pa.int64())]))
    batch = pa.RecordBatch.from_pydict({"lang": pa.array(["en", "en", "de", "en"]), "uses": pa.array(uses, kind)})
    want = Counter()

    def d(a, b):
        return (a - b) ** 2 // b
    for lang, term in zip(batch["lang"].to_pylist(), uses):
        for x in term:
            for y in term:
                if x is not y:
                    want[lang, x["source"], y["source"]] += (d(x["p"], y["p"]) - d(x["p"], y["absent"])
                                                             - d(x["absent"], y["p"]) + d(x["absent"], y["absent"]))
    for part in (batch, batch.slice(1, 3)):
        got = Counter()
        for out in source_divergence._compared(iter([part])):
            for r in out.to_pylist():
                got[r["lang"], r["source"], r["item"]] += r["value"]
        if part is batch:
            assert got == want
        else:
            assert {k[0] for k in got} == {"en", "de"}


def test_copies_are_collapsed(spark, texts):
    docs = spark.createDataFrame(texts, "text string, lang string, source string").repartition(4)
    rows = collapsed_texts(docs).filter("text LIKE 'the same text%'").collect()
    assert len(rows) == 1 and {c["source"]: c["n"] for c in rows[0].copies} == {f"s{k}": 8 for k in range(5)}


def test_odd_rows(spark, no_docs):
    assert audit_sources(no_docs).count() == 0
    rows = [(None, None, None), ("", "en", "a"), ("12 34", "en", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns(
        {"term": F.lit("mine"), "key": F.lit(1), "n": F.lit(2), "value": F.lit(3)})
    assert sorted(rows_of(audit_sources(docs))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
