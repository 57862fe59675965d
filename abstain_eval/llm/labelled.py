"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abstain_eval.llm.common import crc_part, text_or_empty


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, label) of at most `per_class` documents of each label, and each label's share.

    Only documents whose crc32 of the id modulo `parts` is not 0 are looked at. Equal texts count
    once; which ones are taken depends on digests of the texts alone. Null labels, ids and
    texts, and empty texts, teach nothing; of conflicting labels of an id the lower one counts.
    Texts are not shuffled: ids are chosen first and then looked up in a second scan.
    """
    may = (crc_part(F.col("doc_id"), parts) > 0) & F.col(label).isin(0, 1)
    known = labels.filter(may).groupBy(F.col("doc_id").alias("id")).agg(F.min(label).cast("int").alias("label"))
    digests = docs.filter("text <> ''").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"))
    texts = digests.join(known, "id").groupBy("label", "digest").agg(F.min("id").alias("id")).cache()
    try:
        sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
        picked = {
            r["id"]: label
            for label in sizes  # two labels at most, `per_class` ids of each
            for r in texts.filter(F.col("label") == label).orderBy("digest").limit(per_class).select("id").collect()
        }
    finally:
        texts.unpersist()
    total = sum(sizes.values())
    ids = docs.sparkSession.createDataFrame(list(picked.items()), "id long, label int")
    found = docs.select(F.col("doc_id").alias("id"), text_or_empty("text").alias("text")).join(F.broadcast(ids), "id")
    sample = found.groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label")).drop("id")
    return sample, {label: n / total for label, n in sizes.items()}
