"""A training corpus from raw documents: five stages, each written and read again by the next.

quality       documents that the quality classifier rejects go
language      documents without a language go
near_dedup    one document of each group of near duplicates stays
source_mix    sources are replicated to their target weights
packing       token pieces packed into sequences

All stages but the last return the columns of the documents they get. Documents are taken by
rows: what a stage does with nulls, empty texts, repeated rows and extra columns is said in its
operator: rows equal in id and text are one document to near_dedup, and a null `lang` takes the
predicted language. Mixing repeats documents, so the packed pieces of a document come once for
each copy. An empty table of documents gives empty tables in every stage.

Texts go to Python in batches of at most `BATCH_ROWS` rows: whole texts make the default of 10,000
rows large, once in the executor and once in each of its workers. For the same reason the tokenizer
keeps fewer words, and none once a task has ended: the workers go on to other stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from abstain_eval.llm import language, mixing, packing, quality, simhash
from abstain_eval.llm.common import table
from abstain_eval.session import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

BATCH_ROWS = 2000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch size to BATCH_ROWS, unless it is lower."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def documents_in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.in_known_language(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.first_of_each(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select("row.*")


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, lean=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("language", documents_in_a_language),
    ("near_dedup", distinct_documents),
    ("source_mix", mixed_documents),
    ("packing", packed_documents),
]

#: Learned stages have no SQL form; tests compare the pipeline with its stages done by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
