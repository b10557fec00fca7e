"""Every stage on its own input against brute force, and the whole run."""

import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.text import table
from ledgerlens.session import materialised

from .conftest import DOCUMENT, words
from .test_decontamination import brute as brute_items
from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute as brute_near

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, smoke_dir):
    """[(name, input rows, output rows)] of the stages over the smallest tables."""
    docs, out = table(spark, smoke_dir, "documents", "*"), []
    for name, stage in corpus_pipeline.STAGES:
        made = materialised(stage(spark, docs, smoke_dir))
        out.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in made.collect()], made.columns))
        docs = made
    return {s[0]: s[1:] for s in out}


def test_columns_and_order(stages):
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "source_mix"]
    assert all(stages[n][2] == COLUMNS for n in list(stages)[:4])
    assert stages["source_mix"][2] == [*COLUMNS, "size", "source_size", "target", "taken", "mix_start"]


def test_language_stage_keeps_texts_with_words(stages):
    before, after, _ = stages["language_id"]
    assert [r["doc_id"] for r in after] == [r["doc_id"] for r in before if any(c.isalpha() for c in r["text"])]


def test_line_stage(stages):
    before, after, _ = stages["line_dedup"]
    want = {d: left for d, (n, gone, left) in brute_lines([(r["doc_id"], r["text"]) for r in before]).items() if not gone or left.strip(" ")}
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_stage_keeps_one_of_each_group(stages):
    before, after, _ = stages["near_dedup"]
    want = brute_near([(r["doc_id"], r["text"]) for r in before], corpus_pipeline.SIMILARITY)
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, (_, c) in want.items() if d == c)


def test_near_stage_keeps_unrelated_texts_of_one_id(spark, smoke_dir):
    rnd = random.Random(4)
    a, b, c, d = (words(rnd, 60) for _ in range(4))
    rows = [(5, a), (5, b), (5, None), (6, a + " x"), (7, "y " + b), (8, c), (8, c), (9, ""), (9, ""), (None, a), (None, a), (4, d), (10, c), (5, a + " z")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", 1) for k, (i, t) in enumerate(rows)], DOCUMENT).repartition(3)
    made = [corpus_pipeline.near_dedup(spark, x, smoke_dir) for x in (docs, docs.orderBy(F.desc("text")))]
    got, again = ([(r.doc_id, r.text, r.source) for r in m.collect()] for m in made)
    assert made[0].columns == COLUMNS and sorted(map(repr, got)) == sorted(map(repr, again))
    first = [t for i, t in rows if i == 5 and t and t.startswith(a)]
    kept = collections.Counter((i, "a" if t in first and i else t) for i, t, _ in got)
    assert kept == {(5, "a"): 1, (5, b): 1, (5, None): 1, (8, c): 1, (9, ""): 2, (None, a): 2, (4, d): 1}


def test_decontamination_stage(stages, spark, smoke_dir):
    before, after, _ = stages["decontamination"]
    items = [tuple(r) for r in table(spark, smoke_dir, "benchmark", "item_id", "text").collect()]
    want = brute_items([(r["doc_id"], r["text"]) for r in before], items)
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, v in want.items() if not v[4])


def test_mix_stage(stages):
    before, after, _ = stages["source_mix"]
    texts = {r["doc_id"]: r["text"] for r in before}
    taken, target = collections.Counter(), {}
    for r in after:
        assert r["text"] == texts[r["doc_id"]] and 0 < r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 1.001 for s in target)
    assert [r["mix_start"] for r in after] == sorted(r["mix_start"] for r in after)


def test_run_and_odd_rows(spark, smoke_dir, odd_docs, no_docs, stages):
    assert corpus_pipeline.run(spark, smoke_dir).count() == len(stages["source_mix"][1])
    twice = odd_docs.union(odd_docs.withColumn("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("doc_id"))))
    names = ["_md5", "_row", "_id", "_key", "_doc", "id", "key", "row", "words", "lead", "a.b"]
    twice = twice.withColumns({c: F.lit("mine") for c in names})
    for docs in (twice, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            made = materialised(stage(spark, docs, smoke_dir))
            assert name == "source_mix" or made.columns == docs.columns
            docs = made
        rows = docs.collect()
        assert all(r["taken"] > 0 and all(r[c] == "mine" for c in names) for r in rows) and bool(rows) == (docs.columns[5:6] == ["_md5"])
