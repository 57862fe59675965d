"""Toxicity by class models that are discounted towards counts shared by both classes.

Words and word pairs are counted in toxic and in ordinary documents. Each class's counts are
discounted towards what the shared counts of both classes would give it, and what is discounted
goes back to that shared distribution: an expression that is rare, or that both classes use
alike, has the same probability in each and says nothing. The discount keeps the share
1 - `DEVIATIONS` / G of the difference from the expected counts, where G, the root of twice the
log-likelihood ratio, is how many standard deviations the split between the classes is off. So
the same evidence counts alike whatever the classes' sizes: an expression of toxic documents
alone speaks from 7 occurrences between equal classes, from 3 where a tenth is toxic. Discounts
from counts of counts, interpolated as Kneser and Ney do, leave the chance gaps of many middling
words, which drown the few telling ones; README has figures for both. A document's score is the logistic of its gap of
log-likelihoods per word, measured from the gap that splits the classes best on a part of the
sample that was not counted.

`SAMPLE` labelled documents of each class at most are learned from, chosen by digests of their
texts with equal texts once. Counts are made by Spark; the model holds the `ENTRIES` most
frequent expressions at most, whose size is therefore bounded, and is broadcast. All documents
are scored whole.

Null and empty texts, texts without words, and all texts if one class has no sample, get the
share of toxic documents among the labelled ones, below 0.5 at most 0.49. Rows with a null id
or label teach nothing; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abstain_eval.llm.common import chunks, crc_part, mixed, word_hashes
from abstain_eval.llm.labelled import labelled_sample

SAMPLE = 8000  # labelled documents of a class that are learned from
ENTRIES = 1_000_000
DEVIATIONS = 3.0  # a split between the classes that is off by no more says nothing
RARE = 3  # expressions seen less often over both classes are left to the backoff
ACCEPT = 0.5
HELD_OUT = 5

EXPRESSIONS = "code long, label int, n long"


def word_list(text: str) -> list[bytes]:
    """Lower-case words without the signs around them."""
    return [w.strip(b".,;:!?\"'()[]{}*#%&$|<>-_").lower() for w in text.encode().lower().split()]


def expressions(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every text's words and word pairs, and how many each text has."""
    words = [word_list(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    single = word_hashes([w for ws in words for w in ws])
    first = np.zeros(len(single), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    before = np.roll(single, 1)
    before[first] = 0
    pairs = mixed(before * np.uint64(3) + single)
    both = np.empty(2 * len(single), np.uint64)
    both[0::2], both[1::2] = mixed(single), pairs
    return both.view(np.int64), 2 * sizes


def counted(sample: DataFrame) -> DataFrame:
    """(code, label, n) of all expressions of (text, label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
            for a, b in chunks(texts, 3_000_000):
                codes, sizes = expressions(texts[a:b])
                of = np.repeat(labels[a:b], sizes)
                for label in (0, 1):
                    code, n = np.unique(codes[of == label], return_counts=True)
                    kind = np.full(len(code), label, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(kind), pa.array(n, pa.int64())], names=["code", "label", "n"])

    return sample.select("text", "label").mapInArrow(count, EXPRESSIONS)


class ClassModels:
    """Sorted codes with the log-likelihood gap (toxic minus ordinary) of each expression."""

    def __init__(self, codes: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, totals: tuple[int, int], prior: float):
        """Counts of frequent expressions; `totals`: all counted expressions (toxic, ordinary)."""
        self.prior = min(prior, 0.49)
        self.centre, self.slope = 0.0, 1.0
        self.usable = len(codes) > 0 and min(totals) > 0
        if not self.usable:
            return
        order = np.argsort(codes)
        self.codes = codes[order]
        pair = [toxic[order].astype(float), ordinary[order].astype(float)]
        shared = (pair[0] + pair[1]) / sum(totals)
        expected = [total * shared for total in totals]
        ratio = sum(n * np.log(np.maximum(n, 1) / e) for n, e in zip(pair, expected, strict=True))
        part = np.maximum(1 - DEVIATIONS / np.sqrt(np.maximum(2 * ratio, 1e-12)), 0)
        logs = [np.log((e + (n - e) * part) / e) for n, e in zip(pair, expected, strict=True)]
        self.gap = (logs[0] - logs[1]).astype(np.float32)

    def gaps(self, texts: list[str]) -> np.ndarray:
        """Mean gap per word of each text; nan for a text without words."""
        out = np.full(len(texts), np.nan)
        for a, b in chunks(texts, 4_000_000):
            codes, sizes = expressions(texts[a:b])
            if not len(codes):
                continue
            seen, back = np.unique(codes, return_inverse=True)
            at = np.minimum(np.searchsorted(self.codes, seen), len(self.codes) - 1)
            gap = np.where(self.codes[at] == seen, self.gap[at], 0.0)[back]
            total = np.concatenate([[0.0], np.cumsum(gap)])
            end = np.cumsum(sizes)
            some = sizes > 0
            out[a:b][some] = ((total[end] - total[end - sizes]) / np.maximum(sizes / 2, 1))[some]
        return out

    def calibrate(self, gaps: np.ndarray, labels: np.ndarray, share: float) -> None:
        """Centre with the fewest errors at that share of toxic texts; slope from the classes' distance."""
        known = ~np.isnan(gaps)
        toxic, ordinary = np.sort(gaps[known & (labels == 1)]), np.sort(gaps[known & (labels == 0)])
        if not len(toxic) or not len(ordinary):
            return
        cuts = np.unique(np.concatenate([toxic, ordinary]))
        cuts = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, cuts[-1:] + 1e-6])
        missed = np.searchsorted(toxic, cuts) / len(toxic)
        false = 1 - np.searchsorted(ordinary, cuts) / len(ordinary)
        wrong = missed * share + false * (1 - share)
        self.centre = float(np.median(cuts[wrong <= wrong.min() + 1e-12]))
        self.slope = 8 / max(float(np.median(toxic) - np.median(ordinary)), 1e-3)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if not self.usable:
            return np.full(len(texts), self.prior)
        gaps = self.gaps(texts)
        score = 1 / (1 + np.exp(-np.clip(self.slope * (gaps - self.centre), -50, 50)))
        return np.where(np.isnan(gaps), self.prior, score)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> ClassModels:
    """Three quarters of the sample are counted, the rest calibrates the score."""
    sample, shares = labelled_sample(docs, labels, "toxic", HELD_OUT, per_class)
    sample = sample.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(4))).cache()
    n = {c: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(c) for c, k in (("toxic", 1), ("ordinary", 0))}
    by_code = counted(sample.filter("part > 0")).groupBy("code").agg(*n.values()).cache()
    both = F.col("toxic") + F.col("ordinary")
    try:
        totals = by_code.select(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in n)).first()
        top = by_code.filter(both >= RARE).orderBy(F.desc(both), "code").limit(ENTRIES).toArrow()
        codes, toxic, ordinary = (top[c].to_numpy() for c in ("code", "toxic", "ordinary"))
        model = ClassModels(codes, toxic, ordinary, (totals["toxic"], totals["ordinary"]), shares.get(1, 0.0))
        if model.usable:
            held = docs.sparkSession.sparkContext.broadcast(model)

            @F.pandas_udf(T.DoubleType())
            def gap(texts: pd.Series) -> pd.Series:
                return pd.Series(held.value.gaps(list(texts)))

            rest = sample.filter("part = 0").select(gap("text").alias("gap"), "label").collect()
            found = np.array([(np.nan if r["gap"] is None else r["gap"], r["label"]) for r in rest], float).reshape(-1, 2)
            model.calibrate(found[:, 0], found[:, 1], shares.get(1, 0.0))
    finally:
        by_code.unpersist()
        sample.unpersist()
    return model


def score_column(model: ClassModels, docs: DataFrame, text: Column) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(held.value([t or "" for t in batch]))

    return F.pandas_udf(score, T.DoubleType())(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)
    scored = docs.select("doc_id", score_column(model, docs, F.col("text")).alias("score"))
    return scored.select(
        "doc_id", (crc_part(F.col("doc_id"), HELD_OUT) == 0).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )
