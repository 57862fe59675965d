"""Edited fingerprints and rows without an id, against whole walks and plain order."""

import numpy as np
import odd
from pyspark.sql import functions as F

from abstain_eval.llm import edit_embedding


def test_resumed_walks_are_whole_walks():
    """Over several periods of steps and blocks of characters, and cuts of nothing."""
    draw = np.random.default_rng(0)
    texts = ["".join(draw.choice(list("abcdefgh é"), n)) for n in (0, 1, 3, 4, 100, 9_000, 70_000, 150_000)]
    for text in texts:
        for after in texts[::-1]:
            row = edit_embedding.compare_edited([(1, text, after)]).to_pylist()[0]
            edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
            assert [row["fingerprint"], row["edited_fingerprint"]] == edit_embedding.fingerprints([text, edited])


def following(spark, docs):
    """Every row's id, text and next text by plain order."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", edit_embedding.text_digest("text")).collect()
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["digest"], r["text"]) for r in rows)
    return [(r[1] if r[0] else None, r[3], n[3]) for r, n in zip(rows, rows[1:] + rows[:1], strict=True)]


def test_odd_rows_follow_each_other(spark):
    docs = odd.documents(spark)
    want = [(k, edit_embedding.compare_edited([(0, t, n)]).to_pylist()[0]["edited_sha256"]) for k, t, n in following(spark, docs)]
    found = edit_embedding.compared_with_edits(docs).select("doc_id", "edited_sha256").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found)


def test_rows_without_id_are_spread(spark):
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")
    )
    def plain(pairs):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"a": [p[1] for p in pairs], "b": [p[2] for p in pairs]})

    dealt = edit_embedding.with_next(docs, F.col("doc_id"), F.col("text"), "a string, b string", plain)
    found = dealt.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["a"], r["b"]) for r in found) == sorted((t, n) for _, t, n in following(spark, docs))
    nameless = [r["task"] for r in found if int(r["a"].split()[1]) % 3]
    assert max(map(nameless.count, set(nameless))) < len(nameless) / 2


def test_very_large_ids_follow_each_other(spark):
    docs = spark.range(500).select((F.lit(2**62) + F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))

    def plain(pairs):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"a": [p[1] for p in pairs], "b": [p[2] for p in pairs]})

    found = edit_embedding.with_next(docs, F.col("doc_id"), F.col("text"), "a string, b string", plain).collect()
    assert sorted((int(r["a"]), int(r["b"])) for r in found) == [(i, (i + 1) % 500) for i in range(500)]
