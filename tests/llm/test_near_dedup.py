"""LSH forest and components against brute force, with a large group of near copies and odd rows."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import near_dedup
from ledgerlens.llm.components import components
from ledgerlens.llm.near_dedup import near_duplicates, shingles, signature

from .conftest import words


def plain_shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows, percent):
    """{doc_id: (n_shingles, component)} of rows with unique ids."""
    sets = {d: plain_shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def check(spark, rows, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, percent).collect()}
    want = brute(rows, percent)
    assert got == {d: (n, c, d == c) for d, (n, c) in want.items()}


def test_sets_and_signatures():
    for text in [None, "", "a", "A b\tC  d", "x " * 50, "one Two three four five six", "Ünï\xa0çödé a b c d e"]:
        assert len(shingles(text)) == len(plain_shingles(text))
    a, b = shingles("One two three four five six"), shingles("one TWO three four five  six")
    assert (a == b).all() and signature(a) == signature(b)
    rnd = random.Random(2)
    x = words(rnd, 400).split()
    y = x[:360] + words(rnd, 40).split()
    a, b = (shingles(" ".join(t)) for t in (x, y))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    s, t = (np.frombuffer(signature(v), ">u2") for v in (a, b))
    assert abs((s == t).mean() - true) < 0.13


def test_equals_brute_force(spread, odd_rows):
    check(spread, [(r[0], r[1]) for r in odd_rows], 85)


def test_large_group_of_near_copies(spread):
    rnd = random.Random(4)
    base = words(rnd, 150).split()
    rows = []
    for i in range(260):                      # many texts with similarities around the threshold
        copy = list(base)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(len(copy))] = f"new{rnd.randrange(9)}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    check(spread, rows, 85)
    check(spread, rows[::4], 80)


def test_dense_regions_descend_and_keep_the_links(spread, monkeypatch):
    """Texts that share a template and are not linked, among them pairs that are; regions descend from 40 texts on."""
    monkeypatch.setattr(near_dedup, "REGION", 40)
    rnd = random.Random(8)
    template = words(rnd, 100)
    rows = [(i, template + " " + words(rnd, 22)) for i in range(0, 600, 2)]
    rows += [(i + 1, t + f" tail{i}") for i, t in rows[::5]]
    check(spread, rows, 85)


def test_rare_shingles_meet_in_every_linked_pair():
    rnd = random.Random(11)
    base = [rnd.randrange(10**6) for _ in range(60)]
    sets = [np.unique(np.array([x if rnd.random() < p else rnd.randrange(10**6) for x in base], np.uint64))
            for p in (0.8, 0.9, 0.95, 1.0) for _ in range(12)] + [np.array([5], np.uint64)] * 2
    outside = np.array([i % 3 == 0 for i in range(len(sets))])
    for percent in (50, 80, 85, 100):
        meets = near_dedup._share_rare(sets, outside, percent)
        linked = {(x, y) for x in np.flatnonzero(outside) for y in np.flatnonzero(~outside) if near_dedup._linked(sets[x], sets[y], percent)}
        assert linked and all(meets[x, y] for x, y in linked)
    assert near_dedup._share_rare(sets, outside, 85).sum() < outside.sum() * (~outside).sum()


def test_region_depth_follows_density(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 3)
    path = lambda *h: bytearray(b"".join(bytes([0, x]) for x in h))
    paths = {1: path(1, 1, 1, 1, 1, 1, 1, 1), 2: path(1, 1, 1, 1, 1, 1, 1, 2), 3: path(1, 1, 1, 1, 2, 1, 1, 1), 4: path(1, 1, 1, 1, 2, 2, 2, 2),
             5: path(2, 1, 1, 1, 1, 1, 1, 1), 6: path(2, 1, 1, 1, 3, 1, 1, 1)}
    near = spark.createDataFrame([(0, a, paths[a], a + 1, paths[a + 1]) for a in (1, 2, 3, 5)],
                                 "tree int, a long, path_a binary, b long, path_b binary")
    got = {r.id: bytes(r.prefix)[1::2] for r in near_dedup.region_members(near).collect()}
    assert got == {1: b"\1" * 5, 2: b"\1" * 5, 3: b"\1\1\1\1\2", 4: b"\1\1\1\1\2", 5: b"\2\1\1\1", 6: b"\2\1\1\1"}


def test_blocks_find_a_link_between_any_two_components(spark):
    rnd = random.Random(6)
    base = words(rnd, 100)
    texts = {i: base if i < 40 else base + f" tail{i}" if i < 43 else words(rnd, 50) for i in range(46)}
    sets = spark.createDataFrame([(i, bytearray(shingles(t).tobytes())) for i, t in texts.items()], "id long, set binary")
    classes = spark.createDataFrame([(i, bytearray(signature(shingles(t)))) for i, t in texts.items()], "id long, sign binary")
    # one region, in which 0..39 are known as one component
    members = spark.createDataFrame([(0, bytearray(b"p"), i) for i in texts], "tree int, prefix binary, id long")
    known = spark.createDataFrame([(i, 0) for i in range(40)], "id long, component long")
    region = near_dedup.open_regions(members, known)
    links = near_dedup.completed(region, classes, sets, 85).collect()
    part = lambda i: 0 if i < 40 else i
    assert {frozenset((part(r.a), part(r.b))) for r in links} >= {frozenset((0, i)) for i in (40, 41, 42)}
    assert all(max(r.a, r.b) < 43 for r in links)


def test_components_of_a_chain_a_star_and_pairs(spread):
    links = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 560)] + [(9, 7), (7, 9), (8, 7), (3, 3)]
    got = {r.id: r.component for r in components(spread.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 500 for i in range(500, 560)}, 7: 7, 8: 7, 9: 7}
    assert components(spread.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, no_docs):
    text = "one two three four five six seven"
    rows = [(None, text), (5, text), (5, text), (4, text.upper()), (9, None), (10, ""), (11, "a b"), (12, "A  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "sign": F.lit(0), "component": F.lit(1)})
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 3, None, True), (5, 3, 4, False), (5, 3, 4, False), (4, 3, 4, True), (9, 0, 9, True),
                          (10, 0, 10, True), (11, 1, 11, True), (12, 1, 11, False)], key=repr)
    assert near_duplicates(no_docs).count() == 0
