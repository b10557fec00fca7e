"""Windows of benchmark items against brute force, in one block and in many."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination
from ledgerlens.llm.decontamination import contamination

from .conftest import words


def _words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    wins = [(i, tuple(w[s:s + 10])) for i, t in items for w in [_words(t)] if w for s in range(max(len(w) - 9, 1))]
    out = {}
    for d, t in docs:
        w, hit, found = _words(t), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= {str(i)} - {"None"}
        out[d] = (len(w), len(hit), len(found), sorted(found), bool(hit))
    return out


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_equals_brute_force(spread, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    rnd = random.Random(12)
    items = [(i, words(rnd, rnd.randint(1, 40))) for i in range(12)]
    items += [(20, None), (21, "..."), (None, words(rnd, 12)), (22, "One"), (23, "ab ab ab"), (24, items[3][1]), (25, "ünï Ünï \x80x")]
    texts = [None, "", "one", "ab ab ab ab, ab", "ünï Ünï \x80X ünï ünï", "nothing here", items[0][1]]
    for i, t in items:
        w = (t or "").split()
        texts.append(words(rnd, 5) + "; " + ", ".join(w[2:14]).upper() + " " + words(rnd, 3))
        texts.append(" ".join(w[:9]) + " x " + " ".join(w[9:]))
    texts += ["ab " * 500 + "one"] * 2
    docs = list(enumerate(texts))
    made = contamination(spread.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("mine")),
                         spread.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in made.collect()}
    assert got == brute(docs, items)
    assert sum(v[4] for v in got.values()) > 10


def test_blocks_are_bounded_for_long_items_items_without_id_and_common_windows(spread, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 1000)
    rnd = random.Random(13)
    long, common = words(rnd, 400), words(rnd, 10)
    items = [(1, long)] + [(None, words(rnd, 12)) for _ in range(100)] + [(i, common) for i in range(2, 202)]
    windows = decontamination.item_windows(spread.createDataFrame(items, "item_id long, text string"))
    blocks = [[(r["item"], tuple(r["words"])) for r in b.collect()] for b in decontamination._blocks(windows)]
    sizes = [sum(len(w) for _, w in b) for b in blocks]
    assert max(sizes) <= 1500 and sum(sizes) == 10 * (391 + 300 + 200)
    assert sorted(map(repr, sum(blocks, []))) == sorted(repr((r["item"], tuple(r["words"]))) for r in windows.collect())
    docs = [(1, "x " + " ".join(long.split()[100:130])), (2, items[5][1] + " y"), (3, common), (4, "nothing")]
    made = contamination(spread.createDataFrame(docs, "doc_id long, text string"), spread.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in made.collect()} == brute(docs, items)


def test_odd_rows(spark, no_docs, odd_docs):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert contamination(no_docs, items).count() == 0
    assert {r.contaminated for r in contamination(odd_docs, items.limit(0)).collect()} == {False}
    rows = spark.createDataFrame([(None, "One"), (None, "One"), (2, None)], "doc_id long, text string")
    assert sorted(r.n_hit for r in contamination(rows, items).collect()) == [0, 1, 1]
