"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. A letter triple is the product of its letters'
vectors, the first turned by two places and the second by one; a text is the sum of its triples
and a language the sum of its training texts, each at unit length. A text gets the language
whose prototype has the largest cosine with it, and half of one plus that cosine's lead over
the prototypes' mean as its score.

Texts are learned from at a rate that gives each language about `PER_LANGUAGE` of them; which
ones depends on digests of their ids. Sums are exact integers, so a model does not depend on the
order of rows. All texts are scored whole.

A text that is null or has no letter is `und` with score 0, as is every text if there is
nothing to learn from. Null ids and null languages teach nothing; equal cosines go to the first
language by name; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abstain_eval.llm.common import chunks, crc_part, text_or_empty, written

SIGNS = 1024
PER_LANGUAGE = 4000
HELD_OUT, HELD_PARTS = 2, 4
SEED = 3
UNIT = 1_000_000
UNKNOWN = "und"
TRIPLE_BLOCK = 4096
TEXT_BLOCK = 256  # texts whose vectors are held at a time


@cache
def letter_table() -> np.ndarray:
    """The lower-case letter of every code point, 0 for what is no letter."""
    table = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        if chr(point).isalpha():
            lower = chr(point).lower()
            table[point] = ord(lower) if len(lower) == 1 else point
    return table


@cache
def letter_vector(point: int) -> np.ndarray:
    return (np.random.default_rng((SEED, point)).integers(0, 2, SIGNS, dtype=np.int8) * 2 - 1).astype(np.int8)


def triples(text: str) -> np.ndarray:
    """Codes of all letter triples; a run of other characters counts as one blank."""
    letters = letter_table()[np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)]
    keep = letters > 0
    keep[1:] |= letters[:-1] > 0  # a blank stays where a letter stands before it
    keep[0] = True
    if not (letters > 0).any():
        return np.zeros(0, np.int64)
    letters = letters[keep].astype(np.int64)
    return (letters[:-2] << 42) | (letters[1:-1] << 21) | letters[2:]


def triple_vectors(codes: np.ndarray) -> np.ndarray:
    """The vector of signs of each triple."""
    out = np.ones((len(codes), SIGNS), np.int8)
    for shift, turn in ((42, 2), (21, 1), (0, 0)):
        points, back = np.unique((codes >> shift) & 0x1FFFFF, return_inverse=True)
        out *= np.roll(np.stack([letter_vector(int(p)) for p in points]), turn, axis=1)[back]
    return out


def text_vectors(texts: list[str]) -> np.ndarray:
    """The sum of each text's triple vectors."""
    out = np.zeros((len(texts), SIGNS), np.float32)
    for a, b in chunks(texts, 1_000_000):
        found = [np.unique(triples(t), return_counts=True) for t in texts[a:b]]
        codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        counts = np.concatenate([n for _, n in found]).astype(np.float32)
        rows = np.repeat(np.arange(b - a), [len(c) for c, _ in found])
        for start in range(0, len(codes), TRIPLE_BLOCK):
            part = (back >= start) & (back < start + TRIPLE_BLOCK)
            dense = np.zeros((b - a, min(TRIPLE_BLOCK, len(codes) - start)), np.float32)
            dense[rows[part], back[part] - start] = counts[part]
            out[a:b] += dense @ triple_vectors(codes[start : start + TRIPLE_BLOCK]).astype(np.float32)
    return out


def at_unit_length(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


class Profiles:
    """Language names in order and their prototypes."""

    def __init__(self, names: list[str], prototypes: np.ndarray):
        self.names = names
        self.prototypes = at_unit_length(prototypes.astype(np.float64))
        self.mean = self.prototypes.mean(0) if names else np.zeros(SIGNS)

    def __call__(self, texts: list[str]) -> pd.DataFrame:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        own = self.prototypes - self.mean  # what all languages share is taken off, so that cosines tell them apart
        own = at_unit_length(own)
        for start in range(0, len(texts) if self.names else 0, TEXT_BLOCK):
            vectors = text_vectors(texts[start : start + TEXT_BLOCK])
            some = np.flatnonzero(np.abs(vectors).max(1, initial=0) > 0)
            unit = at_unit_length(at_unit_length(vectors[some].astype(np.float64)) - self.mean)
            cosine = unit @ own.T
            for i, k, c in zip(some + start, cosine.argmax(1), cosine.max(1), strict=True):
                names[i], scores[i] = self.names[k], (1 + c) / 2
        return pd.DataFrame({"lang_pred": names, "score": np.clip(scores, 0, 1)})


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Profiles:
    may = (crc_part(F.col("doc_id"), HELD_PARTS) != HELD_OUT) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
    known = docs.filter(may).select("doc_id", "lang", text_or_empty("text").alias("text"))
    rates = known.groupBy("lang").agg(F.count("*").alias("n")).select(
        F.col("lang").alias("of"), F.least(F.lit(1.0), per_language / F.col("n")).alias("rate")
    )
    rates = written(rates, "language-rates")
    chance = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.join(rates, F.col("lang") == F.col("of")).filter(chance < F.col("rate"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start in range(0, len(texts), TEXT_BLOCK):
                units = np.rint(at_unit_length(text_vectors(texts[start : start + TEXT_BLOCK])) * UNIT).astype(np.int64)
                for lang, unit in zip(langs[start : start + TEXT_BLOCK], units, strict=True):
                    sums[lang] = sums.get(lang, 0) + unit
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(list(sums), SIGNS)), pa.array(np.tile(np.arange(SIGNS, dtype=np.int32), len(sums))), pa.array(np.concatenate(list(sums.values())))],
                names=["lang", "place", "total"],
            )

    parts = chosen.select("lang", "text").mapInArrow(bundle, "lang string, place int, total long")
    totals = parts.groupBy("lang", "place").agg(F.sum("total").alias("total"))
    rows = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "total"))).alias("all")).orderBy("lang").collect()
    return Profiles([r["lang"] for r in rows], np.array([[x["total"] for x in r["all"]] for r in rows], float).reshape(len(rows), SIGNS))


def language_column(model: Profiles, docs: DataFrame, text: Column) -> Column:
    """struct(lang_pred, score)"""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield held.value([t or "" for t in batch])

    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return F.pandas_udf(predict, kind)(text)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    found = docs.select("doc_id", language_column(fit(docs), docs, F.col("text")).alias("p"))
    held = crc_part(F.col("doc_id"), HELD_PARTS) == HELD_OUT
    return found.select("doc_id", held.alias("held_out"), "p.lang_pred", "p.score")


def in_known_language(docs: DataFrame, languages: list[str] | None = None, least_score: float = 0.0) -> DataFrame:
    """The rows of `docs` in a language, with all their columns; a null `lang` takes what was found.

    Texts without letters go, and those whose predicted language is not among `languages` (all, if
    none are given) or scores below `least_score`.
    """
    found = docs.select(F.struct("*").alias("row"), language_column(fit(docs), docs, F.col("text")).alias("p"))
    kept = (F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least_score)
    if languages is not None:
        kept &= F.col("p.lang_pred").isin(languages)
    return found.filter(kept).select(F.col("row").withField("lang", F.coalesce("row.lang", "p.lang_pred")).alias("row")).select("row.*")
