"""Language identification by rank-order n-gram profiles.

A text's words (runs of letters, lower-cased) are padded with a boundary mark; its n-grams of 1 to 3
characters are ranked by frequency, ties by n-gram. A language's profile is the same ranking over all
texts of that language, cut to ``PROFILE`` n-grams. The out-of-place distance of a text to a language is
the sum over the text's ``PROFILE`` most frequent n-grams of the difference of the ranks; an n-gram
missing in the profile costs ``PROFILE``. The nearest language is predicted, of equally near ones the
smaller name; ``score`` is 1 - distance / largest possible distance of the text.

Counting runs in Arrow batches (numpy, one text at a time); the counts are summed by Spark, and a rank limit
per language is applied on both sides of the shuffle. The model is languages x ``PROFILE`` numbers.

Defined cases: a NULL text or one without a letter is ``und`` with score 0; rows without a language are
not learned from; without any learned language everything is ``und``; repeated rows count as often as they
occur; a NULL doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.text import packed, unpacked

PROFILE = 300
UNKNOWN = "und"
_BITS = 21                 # of a code point; three fit into 63 bits, and a boundary has code 1
_letters = None


def _is_letter() -> np.ndarray:
    """A flag for every code point; made once in each worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_codes(text: str) -> np.ndarray:
    """Codes of all n-grams of 1 to 3 characters of the text's words (boundary marks are no 1-grams)."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _is_letter()[c]
    if not letter.any():
        return np.empty(0, np.int64)
    # every run of other characters becomes one boundary, also at both ends
    c = np.concatenate(([1], np.where(letter, c, 1), [1]))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 1) | (c[:-1] != 1)
    c = c[keep]
    two = c[:-1] << _BITS | c[1:]
    three = (two[:-1] << _BITS | c[2:])[c[1:-1] != 1]    # a boundary inside joins two words
    return np.concatenate((c[c != 1], two, three))


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, best first, ties by code; ``codes`` ascend."""
    return codes[np.argsort(-counts, kind="stable")[:most]]


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """(codes, counts) pairs added up, codes ascending."""
    codes, counts = np.concatenate(parts, axis=1)
    codes, where = np.unique(codes, return_inverse=True)
    return np.stack((codes, np.bincount(where, counts, len(codes)).astype(np.int64)))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
            parts = by_lang.setdefault(lang, [])
            parts.append(np.stack(np.unique(ngram_codes(text), return_counts=True)))
            if len(parts) > 200:
                parts[:] = [_summed(parts)]
        for lang, parts in by_lang.items():
            codes, sums = _summed(parts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "code": codes, "n": sums})


def learn_profiles(docs: DataFrame, most: int = PROFILE) -> dict[str, np.ndarray]:
    """Profile of every language of ``docs`` (text, lang); both must not be NULL to be learned from."""
    known = docs.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = known.mapInArrow(_count_batches, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= most)
    profiles: dict[str, list] = {}
    for r in top.select("lang", "rank", "code").collect():     # languages x most rows
        profiles.setdefault(r["lang"], []).append((r["rank"], r["code"]))
    return {lang: np.array([code for _, code in sorted(v)], np.int64) for lang, v in sorted(profiles.items())}


class Profiles:
    """The profiles as one table: sorted codes, and the rank of each in each language."""

    def __init__(self, profiles: dict[str, np.ndarray], most: int = PROFILE):
        self.langs, self.most = sorted(profiles), most
        self.codes = np.unique(np.concatenate([np.empty(0, np.int64), *profiles.values()]))
        # one more row, for codes of no profile
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        codes = ngram_codes(text or "")
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        top = ranked(*np.unique(codes, return_counts=True), self.most)
        at = np.searchsorted(self.codes, top)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != top] = len(self.codes)
        ranks = self.ranks[at]
        off = np.where(ranks < 0, self.most, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(off))
        return self.langs[best], 1.0 - off[best] / (self.most * len(top))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], key: str, most: int = PROFILE) -> DataFrame:
    """(``key``, lang_pred, score) of every row of ``docs`` (``key``, text)."""
    model = Profiles(profiles, most)

    def predict(batches):
        for batch in batches:
            found = [model.nearest(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array([x[0] for x in found], pa.string()),
                                              pa.array([x[1] for x in found], pa.float64())], [key, "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(predict, f"`{key}` {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, profiles: dict[str, np.ndarray], least: float, most: int = PROFILE) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of at least ``least``, with all their columns."""
    model = Profiles(profiles, most)

    def keep(batches):
        for batch in batches:
            near = (model.nearest(t) for t in batch["_row"].field("text").to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in near], pa.bool_()))

    rows = packed(docs).select("_row")
    return unpacked(rows.mapInArrow(keep, rows.schema), docs.columns)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those that are not held out."""
    profiles = learn_profiles(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), profiles, "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
