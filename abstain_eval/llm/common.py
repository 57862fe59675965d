"""Pieces that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abstain_eval.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_part(key: Column, parts: int) -> Column:
    """crc32 of a key's decimal text, modulo `parts`; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % parts, F.lit(-1))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def tasks(df: DataFrame) -> int:
    """Partitions of a shuffle that this job sizes itself."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again.

    Unlike after a checkpoint Spark then knows how large they are, so that it broadcasts a side of
    a join only if it is small, and does so without shuffling the other side first.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(texts: list[str], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` characters each; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space (space, \\t \\n \\v \\f \\r) in UTF-8, with A-Z in lower case."""
    return text.encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word that does not depend on the process."""
    import pandas as pd

    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def mixed(keys: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit keys, so that close keys land apart."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
