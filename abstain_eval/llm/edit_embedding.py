"""Document fingerprints by randomised edit embedding.

All texts are walked with the same random bits: at step j the walk writes the character it
stands on and moves on if the bit of (j, character) is set. An edit lets two walks part only
until chance brings them together again, so edit distance becomes Hamming distance of what was
written. A text is one walk from its first to its last character, so an insertion or deletion
costs one search for the alignment; as the method has it, k characters take about k * k steps.
Bits repeat after `STEPS` steps. A walk goes from character to character by a table of how many
steps it stands there, so its time is in proportion to the text.

A fingerprint samples the written characters at positions that all texts share, as many from
every octave of positions: [0, 64), [64, 128), [128, 256) and so on. A sample is one hex digit,
0 where nothing was written. The likeness of two fingerprints is the share of equal samples
among those that one of them has, each weighted by the width of its octave, which estimates the
share of equal characters in the embeddings. Near pairs are found by bands of sampled digits
and verified by likeness.

Null and empty texts have an empty fingerprint; two empty fingerprints have likeness 1. Equal
texts have equal fingerprints. The whole text counts, however long it is. Rows with a null id
come before all others; rows with equal ids follow each other by a digest of their texts, and
repeated rows stay, each with its own result. An empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abstain_eval.llm.common import tasks, text_or_empty

SEED = 20_011
STEPS = 8192  # a power of two
BLOCK = 65_536  # characters of a walk that are held at a time
PER_OCTAVE = 64
SAME = 0.8  # likeness from which two documents count as near
BANDS, BAND_DIGITS = 24, 6
CLASSES = 1024
BUCKET_LIMIT = 4000

_RNG = np.random.default_rng(SEED)
#: Whether a walk moves on at a step from a character of a class, and the digit a class writes.
MOVES = _RNG.integers(0, 2, (STEPS, CLASSES), dtype=np.int8)
DIGITS = _RNG.integers(1, 16, CLASSES, dtype=np.uint8)

def _waits() -> bytes:
    """By step and class: after how many steps a walk leaves a character that it reached then."""
    out = np.zeros((2 * STEPS + 1, CLASSES), np.uint8)
    for step in range(2 * STEPS - 1, -1, -1):
        out[step] = np.where(MOVES[step % STEPS], 1, out[step + 1] + 1)
    return out[:STEPS].tobytes()


WAITS = _waits()
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


@cache
def sampled(periods: int) -> np.ndarray:
    """The sampled steps of walks of up to so many times `STEPS` steps, in ascending order."""
    reach, low = periods * STEPS, PER_OCTAVE
    picked = list(range(PER_OCTAVE))
    while low < reach:
        drawn = np.random.default_rng((SEED, low)).choice(low, PER_OCTAVE, replace=False)
        picked += (low + np.sort(drawn)).tolist()
        low *= 2
    return np.array([position for position in picked if position < reach], np.int64)


def classes_of(text: str) -> np.ndarray:
    """The class of every code point."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return ((points * np.uint32(2_654_435_761) >> np.uint32(12)) % np.uint32(CLASSES)).astype(np.int16)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    return [walked(t, 0)[0] for t in texts]


def walked(text: str, step: int) -> tuple[str, int]:
    """Digits at the sampled steps of a walk that enters ``text`` at a step, and the step at which it leaves.

    A walk over two texts, one after the other, is the walk over both: samples of a step are the
    same however far a walk goes.
    """
    wait, mask = WAITS, STEPS - 1
    digits: list[bytes] = []
    for start in range(0, len(text), BLOCK):
        codes = classes_of(text[start : start + BLOCK])
        first, left = step, []  # when the walk leaves each character
        for code in codes.tolist():
            step += wait[(step & mask) * CLASSES + code]
            left.append(step)
        periods = 1 << (-(-step // STEPS) - 1).bit_length()
        steps = sampled(periods)
        steps = steps[np.searchsorted(steps, first) : np.searchsorted(steps, step)]
        digits.append(HEX[DIGITS[codes[np.searchsorted(np.array(left), steps, side="right")]]].tobytes())
    return b"".join(digits).decode(), step


def digits_of(prints: list[str], width: int) -> np.ndarray:
    """Digits of each fingerprint as a matrix, 0 behind its end."""
    raw = np.frombuffer("".join(p.ljust(width, "0") for p in prints).encode(), np.uint8).reshape(len(prints), width)
    return np.where(raw > 57, raw - 87, raw - 48)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness of each pair of fingerprints, from 0 to 1."""
    width = max(map(len, [*left, *right]), default=0)
    if not width:
        return np.ones(len(left))
    a, b = digits_of(left, width), digits_of(right, width)
    octave = np.maximum(np.arange(width) // PER_OCTAVE - 1, 0)
    weight = np.exp2(octave.astype(float))
    either = ((a > 0) | (b > 0)) @ weight
    return np.where(either > 0, ((a == b) & (a > 0)) @ weight / np.maximum(either, 1), 1.0)


@F.pandas_udf(T.StringType())
def fingerprint_column(texts: pd.Series) -> pd.Series:
    return pd.Series(fingerprints([t or "" for t in texts]), dtype=object)


@F.pandas_udf(T.DoubleType())
def likeness_column(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(likeness(list(left), list(right)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def band_column(prints: pd.Series) -> pd.Series:
    """Keys of the bands of a fingerprint: digits sampled from its last octaves.

    A fingerprint is banded as one of its own length in octaves and as one an octave shorter,
    so that texts of nearly equal length meet on either side of a bound.
    """
    out = []
    for p in prints:
        top = -(-len(p) // PER_OCTAVE)
        keys = []
        for octaves in {max(top, 1), max(top - 1, 1)}:
            rng = np.random.default_rng((SEED, octaves))
            low = max(0, octaves - 4) * PER_OCTAVE
            text = p.ljust(octaves * PER_OCTAVE, "0")
            for band in range(BANDS):
                at = rng.choice(octaves * PER_OCTAVE - low, BAND_DIGITS, replace=False) + low
                key = "".join(text[i] for i in at)
                if key.strip("0"):
                    keys.append(f"{octaves}:{band}:{key}")
        out.append(keys)
    return pd.Series(out, dtype=object)


def near_pairs(docs: DataFrame, same: float = SAME, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pairs a < b of distinct fingerprints that share a band and are alike by `same` or more.

    Returns fingerprint_a, fingerprint_b, id_a, id_b (each class's least id), likeness. Copies are
    one class; `class_members` gives its rows.
    """
    classes = class_members(docs, id_column, text_column).groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    banded = classes.select("fingerprint", "least_id", F.explode(band_column("fingerprint")).alias("band"))
    left = banded.select("band", F.col("fingerprint").alias("fingerprint_a"), F.col("least_id").alias("id_a"))
    right = banded.select("band", F.col("fingerprint").alias("fingerprint_b"), F.col("least_id").alias("id_b"))
    met = left.join(right, "band").filter("fingerprint_a < fingerprint_b").drop("band").distinct()
    return met.withColumn("likeness", likeness_column("fingerprint_a", "fingerprint_b")).filter(F.col("likeness") >= same)


def class_members(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's doc_id and fingerprint."""
    return docs.select(F.col(id_column).alias("doc_id"), fingerprint_column(text_or_empty(text_column)).alias("fingerprint"))


LEAST = -(2**63)


def text_digest(text: str) -> Column:
    """52 bits of a digest of a text."""
    return F.shiftrightunsigned(F.xxhash64(text), 12)


def places(orders: np.ndarray, digests: np.ndarray) -> np.ndarray:
    out = np.empty(len(orders), [("order", np.int64), ("digest", np.int64)])
    out["order"], out["digest"] = orders, digests
    return out


def range_starts(rows: DataFrame, ranges: int) -> np.ndarray:
    """First places (order, digest) of about ``ranges`` ranges; a key with many rows is cut by their digests."""
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.select(F.min("order"), F.percentile_approx("order", F.lit(shares), F.lit(10_000))).first()
    # Percentiles are found in floating point, which holds whole numbers up to 2 ** 53.
    keys, times = np.unique(np.array([k for k in [found[0], *(found[1] or [])] if k is not None], np.int64), return_counts=True)
    if (np.abs(keys[keys != LEAST].astype(float)) >= 2.0**53).any():
        bounds = keys.copy()

        @F.pandas_udf("int")
        def between(orders: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(bounds, orders.to_numpy(), side="right").astype(np.int32))

        there = rows.groupBy(between("order").alias("at")).agg(F.min("order").alias("least")).collect()
        keys = np.array(sorted(r["least"] for r in there), np.int64)
        times = np.ones(len(keys), int)
    hot = {int(k): int(n) for k, n in zip(keys, times, strict=True) if n > 2}  # at most a third of the ranges
    starts = {(int(k), LEAST) for k in keys if int(k) not in hot}
    if hot:  # every range begins with a row that is there
        digest = (F.min("digest"), F.percentile_approx("digest", F.lit(shares), F.lit(10_000)))
        for key, least, digests in rows.filter(F.col("order").isin(list(hot))).groupBy("order").agg(*digest).collect():
            step = max(1, len(digests) // hot[key])
            starts |= {(key, d) for d in (least, *digests[step - 1 :: step])}
    ordered = sorted(starts)
    return places(np.array([k for k, _ in ordered], np.int64), np.array([d for _, d in ordered], np.int64))


def with_next(docs: DataFrame, key: Column, text: Column, schema: str, function) -> DataFrame:
    """`function` over streams of (doc_id, text, next text), the next in ascending order of `key`.

    Rows without a key come first, and rows of one key are ordered by a digest of their text. Rows go
    to ranges of both by a shuffle; the first row of a range also goes to the range before it, and
    the first of all to the last range, so no row of a range waits for another.
    """
    keyed = docs.select(key.cast("long").alias("doc_id"), text.alias("text"))
    placed = keyed.withColumns({"order": F.coalesce("doc_id", F.lit(-(2**63))), "digest": text_digest("text")})
    firsts = range_starts(placed.select("order", "digest"), min(4 * tasks(docs), BUCKET_LIMIT))

    @F.pandas_udf("range int, first boolean")
    def range_of(orders: pd.Series, digests: pd.Series) -> pd.DataFrame:
        rows = places(orders.to_numpy(), digests.to_numpy())
        at = np.maximum(np.searchsorted(firsts, rows, side="right") - 1, 0)
        start = firsts[at]
        first = (start["order"] == rows["order"]) & ((start["digest"] == rows["digest"]) | (start["digest"] == LEAST))
        return pd.DataFrame({"range": at.astype(np.int32), "first": first})

    before = F.when(F.col("r.range") > 0, F.col("r.range") - 1).otherwise(F.lit(len(firsts) - 1))
    own = F.struct(F.col("r.range").alias("range"), F.lit(False).alias("extra"))
    copy = F.struct(before.alias("range"), F.lit(True).alias("extra"))
    placed = placed.withColumn("r", range_of("order", "digest"))
    dealt = placed.select("doc_id", "text", "order", "digest", F.inline(F.when(F.col("r.first"), F.array(own, copy)).otherwise(F.array(own))))
    shuffled = dealt.repartition(tasks(docs), "range").sortWithinPartitions("range", "extra", "order", "digest", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row of a batch waits for the next one
        for batch in batches:
            rows = held + list(zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "range", "extra")), strict=True))
            pairs = [(a[0], a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False) if not a[3] and a[2] == b[2]]
            held = rows[-1:]
            del rows
            if pairs:
                yield function(pairs)

    return shuffled.mapInArrow(stream, schema)


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_edited(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    """Fingerprints of texts, of their edited forms, and of the texts that follow them.

    An edited text begins as its text does, so its walk goes on from where that beginning ends.
    """
    own, other, edited = [], [], []
    known: dict[str, tuple[str, int, str]] = {}  # the beginning's digits and last step, and the rest's digits
    ends: dict[tuple[str, str], str] = {}
    for _, text, following in rows:
        cut = len(text) // 4
        if text not in known:
            head, step = walked(text[: len(text) - cut], 0)
            known[text] = head, step, walked(text[len(text) - cut :], step)[0]
        head, step, tail = known[text]
        if (text, following[:cut]) not in ends:
            ends[text, following[:cut]] = walked(following[:cut], step)[0]
        own.append(head + tail)
        other.append(head + ends[text, following[:cut]])
        edited.append(hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest())
    after = ["".join(known[n][::2]) if n in known else fingerprints([n])[0] for _, _, n in rows]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([k for k, _, _ in rows], pa.int64()),
            "n_chars": pa.array([len(t) for _, t, _ in rows], pa.int64()),
            "edited_sha256": edited,
            "fingerprint": own,
            "edited_fingerprint": other,
            "near_edited": likeness(own, other),
            "near_next": likeness(own, after),
        }
    )


def compared_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document."""
    return with_next(docs, F.col("doc_id"), text_or_empty("text"), COMPARED, compare_edited)
