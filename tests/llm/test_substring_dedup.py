"""Repeated byte strings against brute force, over many partitions, with a passage that most documents share."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from ledgerlens.llm import substring_dedup
from ledgerlens.llm.substring_dedup import anchors, multikey_order, remove_repeated_strings

from .conftest import words


def brute(rows):
    """Per row (doc_id, text) its result; equal ids with different texts are ordered by md5."""
    key = lambda r: (r[0], hashlib.md5((r[1] or "").encode()).hexdigest())
    rank = {k: n for n, k in enumerate(sorted({key(r) for r in rows}))}
    least = {}
    for r in rows:
        b = (r[1] or "").encode()
        for s in range(len(b) - 49):
            least[b[s:s + 50]] = min(least.get(b[s:s + 50], 1 << 60), rank[key(r)])
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 49):
            if least[b[s:s + 50]] < rank[key(r)]:
                gone[s:s + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_equal_strings_have_equal_anchors():
    rnd = random.Random(5)
    shared = words(rnd, 40).encode()
    a, b = (np.frombuffer(words(rnd, n).encode() + shared + words(rnd, 9).encode(), np.uint8) for n in (3, 17))
    at = lambda raw: {bytes(raw[s:s + 50]): (h, s) for h, f, l in zip(*anchors(raw)) for s in range(f, l + 1)}  # noqa: E731,E741
    x, y = at(a), at(b)
    assert len(x) == len(a) - 49 and len(x.keys() & y.keys()) >= len(shared) - 49
    assert all(x[k][0] == y[k][0] for k in x.keys() & y.keys())


def test_multikey_quicksort_equals_a_full_sort():
    rng = np.random.default_rng(1)
    digits = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    order, starts = multikey_order(digits)
    rows = list(zip(*(d.tolist() for d in digits)))
    got = [rows[i] for i in order]
    assert got == sorted(rows)
    assert starts.tolist() == [i for i in range(len(got)) if i == 0 or got[i] != got[i - 1]]


def test_equals_brute_force(spread, odd_rows, odd_docs):
    got = sorted(tuple(r) for r in remove_repeated_strings(odd_docs).collect())
    assert got == brute([r[:2] for r in odd_rows])


def test_runs_are_sorted_whole(monkeypatch):
    """What is removed or left open does not depend on how many suffixes are sorted at once."""
    rnd = random.Random(9)
    hot = words(rnd, 12)
    texts = pa.RecordBatch.from_pylist([{"doc": i, "text": words(rnd, 3) + " " + hot + " " + words(rnd, 3)} for i in range(9)])
    rows = pa.Table.from_batches([
        b for t in range(9) for b in substring_dedup._strings_around([texts.slice(t, 1).append_column(
            "leads", pa.array([substring_dedup.anchors(np.frombuffer(texts["text"][t].as_py().encode(), np.uint8))[0]
                               .view(np.int64).tolist()]))])])
    batches = rows.sort_by([("lead", "ascending"), ("doc", "ascending")]).to_batches(max_chunksize=4)
    seen = []
    for runs in (1, 5, 20_000):
        monkeypatch.setattr(substring_dedup, "_RUNS", runs)
        found = [r for b in substring_dedup._compared(iter(batches)) for r in b.to_pylist()]
        least = {}
        for r in found:
            if r["string"] is not None:
                least[r["string"]] = min(least.get(r["string"], 99), r["doc"])
        gone = [r for r in found if r["string"] is None or r["doc"] > least[r["string"]]]
        seen.append({(r["doc"], k) for r in gone for k in range(r["begin"], r["end"])})
    assert seen[0] == seen[1] == seen[2] and seen[0]


def test_texts_are_searched_once_for_their_strings(spread, monkeypatch):
    """The second dealing takes its splitters from the written suffixes; strings over its cuts are compared without a join."""
    rnd = random.Random(10)
    hot = words(rnd, 25)
    rows = [(i, words(rnd, 4) + " " + hot + " " + words(rnd, 4)) for i in range(60)]
    written = []
    keep = lambda df, name="table", scratch=True, f=substring_dedup.materialised: written.append(
        (name, df._jdf.queryExecution().executedPlan().toString())) or f(df, name, scratch)
    monkeypatch.setattr(substring_dedup, "materialised", keep)
    got = remove_repeated_strings(spread.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    plans = dict(written)
    assert "rangepartitioning" not in plans["ranges"] and "MapInArrow" in plans["ranges"]
    assert "string#" in plans["cut"] and plans["cut"].count("Join") == 1 and "Window" in plans["cut"]


def test_splitters_cut_a_hot_lead_by_documents(spark):
    rnd = random.Random(12)
    line = words(rnd, 12)
    texts = [" ".join([line] * 9 if d % 2 else [words(rnd, 12)]) for d in range(80)]      # repeated within half of the texts
    leads = [sorted({*substring_dedup.anchors(np.frombuffer(t.encode(), np.uint8))[0].view(np.int64).tolist()}) for t in texts]
    living = spark.createDataFrame([(d, t, x) for d, (t, x) in enumerate(zip(texts, leads))], "doc long, text string, leads array<long>")
    cuts = substring_dedup.splitters(living, 16)
    assert cuts == sorted(set(cuts)) and len(cuts) > 10 and substring_dedup.splitters(living.limit(0), 16) == []
    batches = living.toArrow().to_batches()
    placed = pa.Table.from_batches(substring_dedup._placed(cuts)(iter(batches))).to_pylist()
    sizes = [sum(r["part"] == p for r in placed) for p in range(16)]
    assert sum(sizes) == len(placed) and max(sizes) < 3 * len(placed) / 16
    assert all(r["part"] == sum(c <= (r["lead"], r["doc"]) for c in cuts) for r in placed)


def test_hot_passage_over_many_partitions(spread):
    rnd = random.Random(8)
    hot = words(rnd, 25)
    rows = [(i, words(rnd, 6) + (" " + hot + " " if i % 3 else " ") + words(rnd, 6)) for i in range(150)]
    rows += [(200, rows[1][1]), (201, rows[1][1]), (202, "x" * 400), (203, "y" + "x" * 300)]
    got = remove_repeated_strings(spread.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_odd_rows(spark, no_docs):
    text = "a passage of well over fifty bytes, so that it can be found in other rows"
    rows = [(1, text), (1, text), (1, text + " more"), (2, None), (3, text[:49]), (4, "é" * 40), (5, "x" + "é" * 40)]
    got = remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    alone = remove_repeated_strings(spark.createDataFrame([(None, text), (7, text)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in alone] == [0, 0]
    assert remove_repeated_strings(no_docs).count() == 0
