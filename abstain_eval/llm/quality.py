"""Document quality by votes of the nearest labelled documents in a latent space.

A document is a vector of counts: pairs and hashed triples of character shapes (letters,
capitals, digits, each sign), hashed words in lower case, and terms for words that repeat. Counts are damped, weighted by
inverse document frequency and projected on the leading singular directions of the labelled
documents. The labelled vectors are broadcast, each document meets all of them in one blocked
product, and its nearest ones vote with weights that grow with their cosine.

`SAMPLE` labelled documents of each class at most are fitted on, chosen by digests of their
texts with equal texts once; votes are weighed back to the share of each class among all
labelled texts. Everything else, scoring included, covers all rows and whole texts.

Null and empty texts have no direction: they get the share of good documents among the labelled
ones, as does every document if no label can be learned from (then 0.5). Labels that are null
or rows with a null id teach nothing; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abstain_eval.llm.common import crc_part, word_hashes, words_of
from abstain_eval.llm.labelled import labelled_sample

SAMPLE = 1500  # labelled documents of a class that are fitted on
DIRECTIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8.0  # power of a cosine in its vote
ACCEPT = 0.3
HELD_OUT = 5
SEED = 7

SHAPES = 37  # letter, capital, digit, blank, line end, 32 signs
PAIRS = SHAPES * SHAPES
TRIPLES = 2039
EXTRAS = 4
WORDS = 2048
WIDTH = PAIRS + TRIPLES + WORDS + EXTRAS
BLOCK = 256

_SHAPE = np.full(256, 255, np.uint8)  # 255: inside a character, left out
_SHAPE[0:32] = 3
_SHAPE[32] = 3
_SHAPE[10] = 4
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_SHAPE[_SIGNS] = np.arange(5, 5 + len(_SIGNS))
_SHAPE[[*range(97, 123), *range(0xC2, 0xF5)]] = 0
_SHAPE[65:91] = 1
_SHAPE[48:58] = 2


def counts(texts: list[str]) -> np.ndarray:
    """Term counts of each text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        shape = _SHAPE[np.frombuffer(text.encode(), np.uint8)]
        shape = shape[shape != 255].astype(np.int32)
        two = shape[:-1] * SHAPES + shape[1:]
        row[:PAIRS] = np.bincount(two, minlength=PAIRS)
        row[PAIRS : PAIRS + TRIPLES] = np.bincount((two[:-1] * SHAPES + shape[2:]) % TRIPLES, minlength=TRIPLES)
        words = text.split()
        if words:
            places = word_hashes(words_of(text)) % np.uint64(WORDS)
            row[PAIRS + TRIPLES : -EXTRAS] = np.bincount(places.astype(np.int64), minlength=WORDS)
            again = sum(map(eq, words, words[1:]))
            row[-4] = again
            row[-3] = len(words) - again
            row[-2] = len(words) - len(set(words))
            row[-1] = len(set(words))
    return out


def damped(found: np.ndarray) -> np.ndarray:
    """Square roots of term shares; long and short texts become alike."""
    out = np.empty(found.shape, np.float32)
    bounds = [0, PAIRS, PAIRS + TRIPLES, WIDTH - EXTRAS, WIDTH - 2, WIDTH]
    for a, b in zip(bounds, bounds[1:], strict=False):
        part = found[:, a:b]
        np.divide(part, np.maximum(part.sum(1, keepdims=True), 1), out=out[:, a:b])
    return np.sqrt(out, out=out)


class NearestVotes:
    """Fitted weights, directions and labelled vectors."""

    def __init__(self, found: np.ndarray, labels: np.ndarray, class_share: dict[int, float]):
        """`found`: counts of the labelled documents; `class_share`: of all labelled ones."""
        self.prior = class_share.get(1, 0.0) if class_share else 0.5
        self.usable = len(found) > 0
        if not self.usable:
            return
        self.inverse = (np.log((1 + len(found)) / (1 + (found > 0).sum(0))) + 0.3).astype(np.float32)
        self.inverse[-EXTRAS:] = 2.0
        weighted = damped(found)
        weighted *= self.inverse
        self.centre = weighted.mean(0)
        weighted -= self.centre
        rng = np.random.default_rng(SEED)
        k = min(DIRECTIONS, *weighted.shape)
        span = weighted @ rng.standard_normal((WIDTH, min(k + 8, WIDTH))).astype(np.float32)
        for _ in range(3):
            span, _ = np.linalg.qr(weighted @ (weighted.T @ span))
        _, _, rows = np.linalg.svd(span.T @ weighted, full_matrices=False)
        self.directions = np.ascontiguousarray(rows[:k].T.astype(np.float32))
        self.vectors = self._unit(weighted @ self.directions)
        self.labels = labels.astype(np.float32)
        share = {c: float((labels == c).mean()) for c in (0, 1)}
        self.weight = np.array([class_share.get(int(c), 0) / share[int(c)] for c in labels], np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not self.usable:
            return out
        near = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(texts), BLOCK):
            block = texts[a : a + BLOCK]
            vectors = self._unit((damped(counts(block)) * self.inverse - self.centre) @ self.directions)
            cosine = vectors @ self.vectors.T
            best = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
            vote = np.maximum(np.take_along_axis(cosine, best, 1), 0) ** SHARPNESS * self.weight[best]
            total = vote.sum(1)
            good = (vote * self.labels[best]).sum(1)
            some = np.array([bool(t) and s > 1e-12 for t, s in zip(block, total, strict=True)])
            out[a : a + BLOCK][some] = (good / np.maximum(total, 1e-12))[some]
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE) -> NearestVotes:
    """Fitted on a bounded sample; the driver receives packed counts, not texts."""
    sample, shares = labelled_sample(docs, labels, label, HELD_OUT, per_class)

    @F.pandas_udf(T.BinaryType())
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([counts([t])[0].tobytes() for t in texts], dtype=object)

    rows = sample.select(packed("text").alias("counts"), "label").collect()
    found = np.frombuffer(b"".join(r["counts"] for r in rows), np.float32).reshape(len(rows), WIDTH)
    return NearestVotes(found, np.array([r["label"] for r in rows], int), shares)


def score_column(model: NearestVotes, docs: DataFrame, text: Column) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(held.value([t or "" for t in batch]))

    return F.pandas_udf(score, T.DoubleType())(text)


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)
    scored = docs.select("doc_id", score_column(model, docs, F.col("text")).alias("score"))
    return scored.select(
        "doc_id", (crc_part(F.col("doc_id"), HELD_OUT) == 0).alias("held_out"), "score",
        (F.col("score") >= accept).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of `docs` whose score reaches `accept`, with all their columns."""
    model = fit(docs, labels)
    scored = docs.select(F.struct("*").alias("row"), score_column(model, docs, F.col("text")).alias("score"))
    return scored.filter(F.col("score") >= accept).select("row.*")
