"""Removal of repeated byte strings with a sparse, range-partitioned suffix array.

A byte of a document goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller doc_id. Sorting every suffix would move a text as many times as it has bytes, so only suffixes at
anchors are sorted: of the ``LENGTH - LEAD + 1`` places in a string where its first or a later ``LEAD``-gram starts,
the one with the smallest hash (the first of equals) is its anchor. Equal strings have their anchors at equal
places, so two documents that share a string share the suffix at its anchor; about one byte in 16 is an anchor.

1. Anchors are range-partitioned by (hash of their leading ``LEAD`` bytes, doc_id) with splitters that Spark samples, so an
   anchor that a third of all documents have is spread over many partitions. In the sorted partitions a suffix lives on
   if a neighbour of another document has the same lead; the rows at a partition's ends always do.
2. The living suffixes are range-partitioned again, now with the strings around them
   (all strings whose anchor they are, at most ``2 * LENGTH - LEAD`` bytes). The splitters come from a bounded number of
   the texts, so that all texts are not searched a second time for Spark's sample. A partition sorts its strings by
   multikey quicksort (8 bytes at a time, only what is still tied goes on) and removes those that are equal to one of a
   smaller document.
3. The first and the last lead of a partition may go on in its neighbours. What is left of their strings, each once in
   the smallest document of the partition, is compared across these boundaries with the smallest document of its string.

Only what is repeated is moved with its bytes. Copies of a whole text are found by their hash before all this; all but the
smallest doc_id lose everything (if they have ``LENGTH`` bytes) and take no further part.

Defined cases: a NULL text is empty; texts shorter than ``LENGTH`` bytes stay; a row without doc_id is compared with
nothing and stays; rows of one doc_id and text are copies of one document and all get its result; if rows of one doc_id have different
texts, they count as different documents in the order of their md5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.near_dedup import mixed
from ledgerlens.llm.text import broadcast_if_few, text_or_empty
from ledgerlens.operators.ranges import running_totals
from ledgerlens.session import materialised, release_shuffles

LENGTH = 50
LEAD = 20
_CHUNK = 1 << 20                      # places that one step looks at
BROADCAST_COPIES = 4_000_000          # ids of 8 bytes; more are joined by a shuffle
_RUNS = 20_000                        # suffixes that are sorted at once, at least
_BATCH = 1 << 22                      # bytes of strings that are handed on at once, at least
_SAMPLE = 100                         # living suffixes that are sampled for each partition's splitter, about

_BYTE_HASH = np.random.default_rng(50).integers(1, 2**63, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15


def _lead_hashes(raw: np.ndarray) -> np.ndarray:
    """The hash of the ``LEAD`` bytes from every place on, by doubling."""
    parts, have, power = _BYTE_HASH[raw], 1, _STEP
    total, done = None, 0
    while True:
        if LEAD & have:
            if total is None:
                total, done = parts, have
            else:
                n = len(raw) - done - have + 1
                total = total[:n] * np.uint64(power) + parts[done:done + n]
                done += have
        if 2 * have > LEAD:
            return mixed(total[:len(raw) - LEAD + 1])
        parts = parts[:-have] * np.uint64(power) + parts[have:]
        have, power = 2 * have, power * power % 2**64


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lead hashes, first, last): the anchors of a text's strings, and the range of the starts of their strings."""
    hashes, firsts, lasts = [], [], []
    width = LENGTH - LEAD + 1
    for base in range(0, max(len(raw) - LENGTH + 1, 0), _CHUNK - width):
        piece = raw[base:base + _CHUNK - width + LENGTH - 1]
        if len(piece) < LENGTH:
            break
        h = _lead_hashes(piece)
        # the place in the low bits makes the first of equal hashes the smallest
        packed = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)
        at = (_window_minimum(packed, width) & np.uint64(_CHUNK - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        hashes.append(h[at[new]])
        firsts.append(base + new)
        lasts.append(base + np.concatenate((new[1:], [len(at)])) - 1)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def _bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, doc): the distinct leads of every document's anchors."""
    for batch in batches:
        docs, texts = batch["doc"].to_numpy(zero_copy_only=False), batch["text"].to_pylist()
        for k in range(0, len(texts), 500):
            found = [np.unique(anchors(_bytes_of(t))[0]) for t in texts[k:k + 500]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(docs[k:k + 500], [len(x) for x in found]))],
                ["lead", "doc"])


def _living(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (lead, doc), those with a neighbour of the same lead, and the first and the last."""
    held, held_alive = None, True          # the last row so far, and whether it lives by what came before it
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        lead = rows["lead"].to_numpy()
        same = lead[1:] == lead[:-1]
        alive = np.concatenate(([held_alive], same))
        alive[:-1] |= same
        yield rows.slice(0, len(rows) - 1).filter(pa.array(alive[:-1]))
        held, held_alive = rows.slice(len(rows) - 1), bool(alive[-1])
    if held is not None:
        yield held


_AROUND = "lead long, doc long, first long, around binary"


def _strings_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, doc, first, around): for every living anchor the bytes from its first string to the end of its last."""
    for batch in batches:
        held, docs, strings, size = [], [], [], 0
        for doc, text, alive in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), batch["leads"].to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            lead, first, last = anchors(np.frombuffer(raw, np.uint8))
            keep = np.isin(lead.view(np.int64), np.array(alive, np.int64))
            lead, first, last = lead[keep].view(np.int64), first[keep], last[keep]
            if len(lead):
                held.append((lead, first))
                docs.append(np.full(len(lead), doc))
                strings += [raw[a:b] for a, b in zip(first.tolist(), (last + LENGTH).tolist())]
                size += int((last - first).sum()) + LENGTH * len(lead)
            if size >= _BATCH:
                yield _suffixes(held, docs, strings)
                held, docs, strings, size = [], [], [], 0
        if held:
            yield _suffixes(held, docs, strings)


def _suffixes(held: list[tuple[np.ndarray, np.ndarray]], docs: list[np.ndarray], strings: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([lead for lead, _ in held])), pa.array(np.concatenate(docs)),
         pa.array(np.concatenate([first for _, first in held])), pa.array(strings, pa.binary())],
        ["lead", "doc", "first", "around"])


def splitters(living: DataFrame, parts: int) -> list[tuple[int, int]]:
    """At most ``parts - 1`` sorted (lead, doc) that cut the living suffixes of ``living`` (doc, text, leads) into ranges of about
    one size. Some texts, picked by a hash, are searched, so that a lead counts as often as a text repeats it; of what they
    have, about ``_SAMPLE`` suffixes for each range are read."""
    wanted = parts * _SAMPLE
    total = living.agg(F.sum(F.size("leads"))).first()[0] or 0
    one_in = max(1, total // (3 * wanted))
    some = living.filter(F.pmod(F.xxhash64("doc"), F.lit(one_in)) == 0).mapInArrow(_strings_around, _AROUND)
    picked = some.filter(F.pmod(F.xxhash64("lead", "doc", "first"), F.lit(max(1, total // one_in // wanted))) == 0)
    sample = sorted((r.lead, r.doc) for r in picked.select("lead", "doc").collect())     # some hundred numbers for each partition
    return sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []


def _placed(cuts: list[tuple[int, int]]):
    """The strings around living anchors with ``part``, the number of ``cuts`` at or before their (lead, doc)."""
    leads, docs = (np.array([c[k] for c in cuts], np.int64) for k in (0, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _strings_around(batches):
            lead, doc = batch["lead"].to_numpy(), batch["doc"].to_numpy()
            part, upto = np.searchsorted(leads, lead, "left"), np.searchsorted(leads, lead, "right")
            for value in np.unique(lead[upto > part]):                 # leads that go on over a cut: few
                at = np.flatnonzero(lead == value)
                a, b = int(part[at[0]]), int(upto[at[0]])
                part[at] = a + np.searchsorted(docs[a:b], doc[at], "right")
            yield batch.append_column("part", pa.array(part.astype(np.int32)))
    return place


def multikey_order(digits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the rows sorted by all digits in turn, and where groups of equal rows start.

    A multikey quicksort on 64-bit digits: after each digit only rows that are still tied are sorted by the next one."""
    order = np.argsort(digits[0], kind="stable")
    sorted_digit = digits[0][order]
    new = np.concatenate(([True], sorted_digit[1:] != sorted_digit[:-1]))
    for digit in digits[1:]:
        group = np.cumsum(new)
        tied = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
        if not len(tied):
            break
        rows = order[tied]
        again = np.lexsort((digit[rows], group[tied]))
        order[tied] = rows[again]
        value, of = digit[rows][again], group[tied]
        split = np.concatenate(([True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])))
        new[tied] |= split
    return order, np.flatnonzero(new)


class _Strings:
    """All strings of a table of suffixes (lead, doc, first, around), as rows of 64-bit digits."""

    def __init__(self, table: pa.Table):
        around = table["around"].combine_chunks()
        offsets = np.frombuffer(around.buffers()[1], np.int32)[around.offset:around.offset + len(around) + 1].astype(np.int64)
        data = np.concatenate((np.frombuffer(around.buffers()[2], np.uint8), np.zeros(8, np.uint8)))
        counts = np.diff(offsets) - LENGTH + 1
        self.suffix = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(self.suffix)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = offsets[self.suffix] + within
        self.data = data
        self.doc = table["doc"].to_numpy()[self.suffix]
        self.start = table["first"].to_numpy()[self.suffix] + within

    def digits(self) -> list[np.ndarray]:
        wide = np.lib.stride_tricks.sliding_window_view(self.data, 8)
        # the last digit overlaps the one before instead of reading over the end
        return [np.ascontiguousarray(wide[self.at + k]).view(">u8").ravel().astype(np.uint64)
                for k in [*range(0, LENGTH - 7, 8), *([LENGTH - 8] if LENGTH % 8 else [])]]

    def repeated(self) -> np.ndarray:
        """Whether a smaller document has the string."""
        order, starts = multikey_order(self.digits())
        doc = self.doc[order]
        least = np.minimum.reduceat(doc, starts)
        out = np.empty(len(doc), bool)
        out[order] = doc > np.repeat(least, np.diff(np.concatenate((starts, [len(doc)]))))
        return out


_FOUND = "doc long, begin long, end long, string binary"


def _ranges(s: _Strings, gone: np.ndarray) -> pa.RecordBatch:
    """(doc, begin, end) of the strings that are ``gone``, neighbouring strings of a suffix in one."""
    edge = np.concatenate(([True], s.suffix[1:] != s.suffix[:-1]))
    opens = np.flatnonzero(gone & (edge | ~np.concatenate(([False], gone[:-1]))))
    closes = np.flatnonzero(gone & (np.concatenate((edge[1:], [True])) | ~np.concatenate((gone[1:], [False]))))
    return pa.RecordBatch.from_arrays(
        [pa.array(s.doc[opens]), pa.array(s.start[opens]), pa.array(s.start[closes] + LENGTH),
         pa.nulls(len(opens), pa.binary())], ["doc", "begin", "end", "string"])


def _closed(table: pa.Table) -> pa.RecordBatch:
    """What goes of the suffixes of whole leads."""
    s = _Strings(table)
    return _ranges(s, s.repeated())


def _open(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """What goes of the suffixes of a lead that may go on in another partition, and the strings that are still
    open: each once, in the smallest document that has it here."""
    for k in range(0, len(table), _RUNS):
        s = _Strings(table.slice(k, _RUNS).combine_chunks())
        gone = s.repeated()
        yield _ranges(s, gone)
        left = np.flatnonzero(~gone)
        strings = [s.data[a:a + LENGTH].tobytes() for a in s.at[left].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(s.doc[left]), pa.array(s.start[left]), pa.array(s.start[left] + LENGTH),
                                          pa.array(strings, pa.binary())], ["doc", "begin", "end", "string"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the strings of whole leads; the first and the last lead are given back as open strings."""
    held: list[pa.RecordBatch] = []
    first_lead = None
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        if first_lead is None:
            first_lead = batch["lead"][0].as_py()
        held.append(batch)
        rows += len(batch)
        if rows >= _RUNS:
            table = pa.Table.from_batches(held).combine_chunks()
            lead = table["lead"].to_numpy()
            after = int(np.searchsorted(lead, first_lead, "right"))
            upto = int(np.searchsorted(lead, lead[-1], "left"))
            if after:
                yield from _open(table.slice(0, min(after, len(table))))
            if upto > after:
                yield _closed(table.slice(after, upto - after).combine_chunks())
            rest = table.slice(max(after, upto))
            held, rows = rest.to_batches(), len(rest)
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        lead = table["lead"].to_numpy()
        after = int(np.searchsorted(lead, first_lead, "right"))
        upto = max(after, int(np.searchsorted(lead, lead[-1], "left")))
        if upto > after:
            yield _closed(table.slice(after, upto - after).combine_chunks())
        for part in (table.slice(0, after), table.slice(upto)):
            if len(part):
                yield from _open(part.combine_chunks())


def _cut_texts(texts: DataFrame) -> DataFrame:
    """(cut_doc, n_removed, n_spans, kept_sha256) of the documents of ``texts`` (doc, text) that lose bytes."""
    found = texts.mapInArrow(_leads, "lead long, doc long")
    sorted_leads = found.repartitionByRange("lead", "doc").sortWithinPartitions("lead", "doc")
    alive = sorted_leads.mapInArrow(_living, "lead long, doc long").groupBy("doc").agg(F.collect_list("lead").alias("leads"))
    alive = materialised(alive, "living")
    release_shuffles(texts.sparkSession)
    # the texts with a living suffix, once; what follows reads them from here
    living = materialised(texts.join(alive, "doc").dropDuplicates(["doc"]), "texts")
    release_shuffles(texts.sparkSession)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    around = living.mapInArrow(_placed(splitters(living, parts)), f"{_AROUND}, part int")
    spread = around.repartitionById(parts, "part").drop("part").sortWithinPartitions("lead", "doc")
    compared = materialised(spread.mapInArrow(_compared, _FOUND), "ranges")
    release_shuffles(texts.sparkSession)
    inside = compared.filter("string IS NULL").select("doc", "begin", "end")
    # a string is open once for each partition and run of it, so a window holds no more rows than there are of these
    least = F.min("doc").over(Window.partitionBy("string"))
    later = compared.filter("string IS NOT NULL").withColumn("least", least).filter("doc > least").select("doc", "begin", "end")
    ranges = inside.union(later).groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    cut = living.select("doc", "text").join(ranges, "doc").mapInArrow(_cut, "doc long, n_removed long, n_spans long, kept_sha256 string")
    return materialised(cut.withColumnRenamed("doc", "cut_doc"), "cut")


def _merged(begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(zip(begins, ends)):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, ranges in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), batch["ranges"].to_pylist()):
            raw, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
            spans = _merged([r["begin"] for r in ranges], [r["end"] for r in ranges])
            for begin, end in spans:
                kept.append(raw[at:begin])
                at = end
            kept.append(raw[at:])
            rows.append((doc, sum(e - b for b, e in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(("doc", "n_removed", "n_spans", "kept_sha256"), r)) for r in rows],
                                         pa.schema([("doc", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                                                    ("kept_sha256", pa.string())]))


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc): ``doc`` is the doc_id, or the rank of (doc_id, md5) if some doc_id has several texts."""
    twice = docs.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b")
    if twice.isEmpty():
        return docs.withColumn("doc", F.col("doc_id"))
    ranks = running_totals(docs.select("doc_id", "key").distinct().withColumn("one", F.lit(1)), ["doc_id", "key"], ["one"])
    return docs.join(ranks.select("doc_id", "key", F.col("cum_one").cast("long").alias("doc")), ["doc_id", "key"])


def remove_repeated_strings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).withColumn("key", F.md5("text"))
    known = _numbered(rows.filter("doc_id IS NOT NULL"))
    n, whole = F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")
    sizes = materialised(known.select("doc_id", "key", "doc", n, whole), "sizes")
    firsts = materialised(sizes.filter(F.col("n_bytes") >= LENGTH).groupBy("key").agg(F.min("doc").alias("first")), "firsts")
    # only the smallest document of each text takes part
    copies = sizes.join(firsts, "key").filter("doc > first").select("doc").distinct()
    texts = known.filter(F.octet_length("text") >= LENGTH).select("doc", "text")
    cut = _cut_texts(texts.join(broadcast_if_few(copies, BROADCAST_COPIES), "doc", "left_anti"))
    out = sizes.join(firsts, "key", "left").join(cut, F.col("doc") == F.col("cut_doc"), "left")
    copy = F.col("first") < F.col("doc")
    out = out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))
    zero = F.lit(0).cast("long")
    alone = rows.filter("doc_id IS NULL").select("doc_id", n, zero.alias("n_removed"), zero.alias("n_spans"),
                                                 whole.alias("kept_sha256"))
    return out.union(alone)
