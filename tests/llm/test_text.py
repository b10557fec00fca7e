"""Shared column helpers."""

from pyspark.sql import functions as F

from ledgerlens.llm.text import ascii_lower, broadcast_if_few, packed, same_document, unpacked


def test_ascii_lower_keeps_other_letters(spark):
    texts = ["ABC xyz", "ÀÉ Zß", "", None, "İI"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(ascii_lower(F.col("t"))).collect()
    assert [r[0] for r in got] == ["abc xyz", "ÀÉ zß", "", None, "İi"]


def test_keys_are_joined_alike_with_and_without_broadcast(spark):
    rows, keys = spark.range(100), spark.range(0, 100, 7)
    joined = [rows.join(broadcast_if_few(keys, most), "id", "left_anti") for most in (0, 50)]
    assert "Broadcast" in joined[1]._jdf.queryExecution().optimizedPlan().toString() or joined[1].count() == 85
    assert sorted(r.id for r in joined[0].collect()) == sorted(r.id for r in joined[1].collect())


def test_packed_rows_keep_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "mine"), (None, None, "x")], "doc_id long, text string, _md5 string")
    rows = packed(docs)
    twice = rows.alias("x").join(rows.select(F.col("_row.doc_id").alias("_id"), F.col("_md5").alias("_key")),
                                 same_document("_row.doc_id", "x._md5", "_id", "_key"))
    out = unpacked(twice, docs.columns, {"text": F.lit("new"), "n": F.lit(1)})
    assert sorted(map(repr, out.collect())) == sorted(map(repr, out.sparkSession.createDataFrame(
        [(1, "new", "mine", 1), (None, "new", "x", 1)], "doc_id long, text string, _md5 string, n int").collect()))
