"""MinHash near-duplicate detection with an LSH forest.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes) and a signature of ``TREES`` x ``DEEP``
   minimum hashes. Texts with equal sets form a class, represented by its smallest doc_id from here on.
2. Each tree is one sorted order of the signatures. Neighbours whose longest common prefix has at least ``SHALLOW`` hashes
   are candidates. The texts that share the first ``SHALLOW`` hashes of a tree are a region; a region of more than
   ``REGION`` texts descends to the next hash, and again, until its parts are small enough or ``DEEP`` is reached.
   At a similarity of 0.85 two texts share no region of the least depth with a probability of (1 - 0.85^4)^16 < 1e-5, and no
   region of the full depth, if all their regions are dense, with one of (1 - 0.85^8)^16 = 0.006.
3. Candidates whose signatures estimate less than ``threshold - SLACK`` (4 standard errors) are left out; the
   others are confirmed on the full sets, first the most similar one of each text, then those that still join
   different components.
4. A region of three or more texts that still holds several components is completed: its texts outside the
   region's largest component are compared with all its texts, in blocks of about ``BLOCK`` x ``BLOCK``, and one
   confirmed link between two components is returned. In a block only texts that share one of their rarest shingles can be
   linked, so texts that share a template are not compared pair by pair. No neighbour or region is capped: one that is
   still large at full depth is split into more blocks.

Defined cases: words are runs of characters that are not blank (space, tab to carriage return), A-Z
lower-cased; fewer than five words are one shingle; a text without words, or NULL, has an empty set and is linked
with nothing; a row without doc_id is linked with nothing and is kept; rows of one doc_id belong to one component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.components import components
from ledgerlens.llm.text import broadcast_if_few
from ledgerlens.operators.ranges import with_previous
from ledgerlens.session import materialised

WORDS = 5
TREES, DEEP, SHALLOW = 16, 8, 4
SLACK = 0.13
BLOCK, REGION = 256, 1024
_BYTES = 2                                    # kept of each minimum hash

_rng = np.random.default_rng(20240229)
_BYTE_HASH = _rng.integers(1, 2**63, 256, np.uint64)
_BYTE_HASH[65:91] = _BYTE_HASH[97:123]        # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SCALE = _rng.integers(1, 2**63, (TREES * DEEP, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 2**63, (TREES * DEEP, 1), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word of the text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate(([False], ~_BLANK[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    widths = ends - starts
    letters = raw[inside[1:-1]]
    firsts = np.concatenate(([0], np.cumsum(widths)[:-1]))
    place = np.arange(len(letters)) - np.repeat(firsts, widths)
    powers = np.multiply.accumulate(np.full(int(widths.max()), _STEP, np.uint64))
    return mixed(np.add.reduceat(_BYTE_HASH[letters] * powers[place], firsts))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of hashes of ``words`` consecutive words, or of all words if there are fewer."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = mixed(total * _STEP + h[k:len(h) - n + 1 + k])
    return np.unique(total)


def signature(found: np.ndarray) -> bytes:
    """The minimum hashes of a set, ``_BYTES`` of each, tree by tree."""
    least = np.full(TREES * DEEP, 2**64 - 1, np.uint64)
    for part in range(0, len(found), 4096):
        least = np.minimum(least, (_SCALE * found[part:part + 4096] + _SHIFT).min(axis=1))
    return (mixed(least) >> np.uint64(48)).astype(">u2").tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, signs = [], [], []
        for text in batch["text"].to_pylist():
            found = shingles(text)
            sizes.append(len(found))
            keys.append(hashlib.md5(found.tobytes()).digest())
            signs.append(signature(found))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())],
            ["doc_id", "n_shingles", "set_key", "sign"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch["id"], batch["text"].to_pylist()
        for k in range(0, len(texts), 500):
            found = [shingles(t).tobytes() for t in texts[k:k + 500]]
            yield pa.RecordBatch.from_arrays([ids.slice(k, 500), pa.array(found, pa.binary())], ["id", "set"])


def _numbers(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` whose full sets have 100 * intersection >= percent * union."""
    def check(batches):
        for batch in batches:
            sides = zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist())
            good = pa.array([_linked(_numbers(x), _numbers(y), percent) for x, y in sides], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(check, "a long, b long")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``likeness``: the share of equal minimum hashes."""
    def compare(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(len(batch), -1) for c in ("sign_a", "sign_b"))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array((x == y).mean(axis=1), pa.float64())],
                                             ["a", "b", "likeness"])

    left = classes.select(F.col("id").alias("a"), F.col("sign").alias("sign_a"))
    right = classes.select(F.col("id").alias("b"), F.col("sign").alias("sign_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sign_a", "sign_b").mapInArrow(
        compare, "a long, b long, likeness double")


def _prefix(path, hashes):
    return F.substring(path, F.lit(1), F.lit(_BYTES) * hashes)


def forest_neighbours(classes: DataFrame) -> DataFrame:
    """(tree, a, path_a, b, path_b, lcp): neighbours in the sorted order of each tree with a longest common prefix of at least
    ``SHALLOW`` hashes."""
    width = DEEP * _BYTES
    paths = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(
        t.alias("tree"), F.substring("sign", t * width + 1, F.lit(width)).alias("path")))
    rows = classes.select("id", F.explode(paths).alias("p")).select("id", "p.tree", "p.path")
    rows = rows.withColumn("here", F.struct("path", "id"))
    near = with_previous(rows, ["path", "id"], "here", "before", ["tree"]).filter("before IS NOT NULL")
    near = near.select("tree", F.col("before.id").alias("a"), F.col("before.path").alias("path_a"),
                       F.col("id").alias("b"), F.col("path").alias("path_b"))
    agree = [F.when(_prefix("path_a", F.lit(d)) == _prefix("path_b", F.lit(d)), d) for d in range(SHALLOW, DEEP + 1)]
    return near.withColumn("lcp", F.greatest(*agree)).filter("lcp IS NOT NULL")


def region_members(near: DataFrame) -> DataFrame:
    """(tree, prefix, id): the texts with a neighbour, each in the region of its tree whose depth fits its density."""
    side = lambda c: F.struct(F.col(c).alias("id"), F.col(f"path_{c}").alias("path"))
    members = materialised(near.select("tree", F.explode(F.array(side("a"), side("b"))).alias("m"))
                           .select("tree", "m.id", "m.path").distinct(), "members")
    # of each depth, the regions that are too large to stay: their parts are told from the others by a join on few rows
    depth = F.lit(SHALLOW)
    for d in range(SHALLOW, DEEP):
        large = (members.groupBy("tree", _prefix("path", F.lit(d)).alias("prefix")).agg(F.count("id").alias("n"))
                 .filter(F.col("n") > REGION).select(F.col("tree").alias(f"t{d}"), F.col("prefix").alias(f"p{d}")))
        members = members.join(large, (F.col("tree") == F.col(f"t{d}")) & (_prefix("path", F.lit(d)) == F.col(f"p{d}")), "left")
        depth = depth + F.col(f"p{d}").isNotNull().cast("int")
    return members.select("tree", _prefix("path", depth).alias("prefix"), "id")


def _component_of(rows: DataFrame, known: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` with the component of the vertex in ``key``, by default itself."""
    side = known.select(F.col("id").alias(key), F.col("component").alias(out))
    return rows.join(side, key, "left").withColumn(out, F.coalesce(out, key))


def open_regions(members: DataFrame, known: DataFrame) -> DataFrame:
    """(tree, prefix, id, component, core, n, k): the members of regions of three or more with several components;
    ``core`` is the region's largest component, ``k`` the number of members outside it."""
    rows = _component_of(members, known, "id", "component")
    parts = rows.groupBy("tree", "prefix", "component").agg(F.count("id").alias("n"))
    regions = parts.groupBy("tree", "prefix").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("core"))
    regions = regions.filter("n > 2 AND most < n").withColumn("k", F.col("n") - F.col("most")).drop("most")
    return rows.join(regions, ["tree", "prefix"])


def _share_rare(sets_of: list[np.ndarray], outside: np.ndarray, percent: int) -> np.ndarray:
    """Which texts outside (rows) and inside (columns) share one of their rarest shingles of the block. Linked texts do: each
    lacks at most ``size - ceil(percent * size / 100)`` shingles of the other, and the rarest one of both is among as many plus one."""
    sizes = np.array([len(x) for x in sets_of])
    owner = np.repeat(np.arange(len(sets_of)), sizes)
    _, which, counts = np.unique(np.concatenate(sets_of), return_inverse=True, return_counts=True)
    order = np.lexsort((which, counts[which], owner))            # text by text, rarest first
    which, owner = which[order], owner[order]
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = place <= (sizes - -(-percent * sizes // 100))[owner]
    which, owner = which[kept], owner[kept]
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    meets = np.zeros((len(sets_of), len(sets_of)), bool)
    for texts in np.split(owner, np.flatnonzero(which[1:] != which[:-1]) + 1):
        outer = outside[texts]
        if len(texts) > 1 and outer.any() and not outer.all():
            meets[np.ix_(texts[outer], texts[~outer])] = True
    return meets


def completed(region_rows: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components of one region, one for every two components in a block."""
    rows = region_rows.join(classes.select("id", "sign"), "id").join(sets, "id")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    common = ["tree", "prefix", "id", "component", "sign", "set"]
    every = rows.select(*common, F.lit(False).alias("outer"), own("n").alias("i"), spread("k").alias("j"))
    outer = rows.filter("component <> core").select(*common, F.lit(True).alias("outer"), own("k").alias("j"), spread("n").alias("i"))
    least = percent / 100 - SLACK

    def compare(group: pa.Table) -> pa.Table:
        outside = np.array(group["outer"].to_pylist(), bool)
        ids, parts, blobs = (group[c].to_pylist() for c in ("id", "component", "set"))
        sets_of = [_numbers(b) for b in blobs]
        signs = np.frombuffer(b"".join(group["sign"].to_pylist()), np.uint16).reshape(len(ids), -1)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        insiders = np.flatnonzero(~outside)
        meets = _share_rare(sets_of, outside, percent)
        for x in np.flatnonzero(outside):
            near = insiders[meets[x, insiders]]
            near = near[(signs[near] == signs[x]).mean(axis=1) >= least]
            for y in near:
                between = (min(parts[x], parts[y]), max(parts[x], parts[y]))
                if between[0] != between[1] and between not in found and _linked(sets_of[x], sets_of[y], percent):
                    found[between] = (ids[x], ids[y])
        return pa.table({"a": pa.array([p[0] for p in found.values()], pa.int64()),
                         "b": pa.array([p[1] for p in found.values()], pa.int64())})

    return every.unionByName(outer).groupBy("tree", "prefix", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicate_components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    sketches = materialised(docs.select("doc_id", "text").mapInArrow(
        _sketches, "doc_id long, n_shingles long, set_key binary, sign binary"), "sketches")
    linkable = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialised(linkable.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.max("sign").alias("sign")), "classes")
    near = materialised(forest_neighbours(classes), "neighbours")
    members = materialised(region_members(near), "regions-of")
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    pairs = materialised(_estimated(pairs, classes).filter(F.col("likeness") >= percent / 100 - SLACK), "pairs")
    # the texts with a neighbour
    needed = broadcast_if_few(members.select("id").distinct())
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(needed, "id", "left_semi")
    sets = materialised(texts.mapInArrow(_sets, "id long, set binary"), "sets")

    nearest = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.struct("likeness", -F.col("a"), -F.col("b")).alias("p"), "a", "b")
    nearest = nearest.groupBy("id").agg(F.max_by(F.struct("a", "b"), "p").alias("ab")).select("ab.*").distinct()
    links = materialised(confirmed(nearest, sets, percent), "links")
    known = components(links)
    rest = _component_of(_component_of(pairs, known, "a", "ca"), known, "b", "cb").filter("ca <> cb")
    links = links.union(materialised(confirmed(rest, sets, percent), "links"))
    known = components(links)
    regions = materialised(open_regions(members, known), "regions")
    links = links.union(materialised(completed(regions, classes, sets, percent), "links"))
    known = materialised(components(links), "components")

    by_class = _component_of(classes.select("set_key", "id"), known, "id", "component").select("set_key", "component")
    found = sketches.join(by_class, "set_key", "left")
    return found.select("doc_id", "n_shingles", F.when(
        (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        .otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and whether the document is kept."""
    found = near_duplicate_components(docs, percent)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
