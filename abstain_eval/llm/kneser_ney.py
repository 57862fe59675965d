"""Language-model scoring by an interpolated modified Kneser-Ney model of word pairs.

Spark counts words and word pairs of the training texts: tasks make sorted partial counts,
a shuffle brings equal keys together, and each bucket becomes a pair of sorted arrays (hashes,
counts) in the shared folder. A second, smaller shuffle sums what pairs say about single words:
how many pairs a word begins, by their counts, and how many different words it follows. Workers
map these files into memory and look up each batch's distinct keys in order, so a worker holds
the pages that it touches, however large the model is. Files are written under another name
first and then renamed, so a task that is repeated leaves the same file.

Words are keyed by 64-bit hashes, pairs by two 32-bit ones. Every text starts in a start
context and ends with an end token. Discounts come from the counts of counts of each order; the
lower order is made of continuation counts and backs off to an even share over all known words
and one unknown word.

Null and empty texts are the end token alone. Rows with a null id are trained on. Repeated rows
count as often as they occur and score alike. Without training texts all words are unknown.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abstain_eval.llm.common import chunks, crc_part, mixed, text_or_empty, word_hashes, words_of
from abstain_eval.session import fresh_path

HELD_OUT, HELD_PARTS = 2, 7
END, START = b" end", b" start"  # no word holds a blank
FLUSH = 6_000_000  # tokens that a task counts before it hands them on
BUCKET_BYTES = 16_000_000  # text behind each bucket of the model
WORDS, PAIRS, BEGUN, FOLLOWED = 0, 1, 2, 3
LOW = np.uint64(0xFFFFFFFF)
BITS = np.uint64(32)


def local_path(path: str) -> str:
    """The mounted path of the shared folder; memory maps need one."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the model folder must be mounted on every machine, not {parts.scheme}:")
    return parts.path if parts.scheme else path


def token_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word keys of all texts with their ends, pair keys, and the number of tokens of each text."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    flat = [w for ws in words for w in (*ws, END)]
    keys = word_hashes(flat)
    before = np.roll(keys, 1)
    before[np.cumsum(sizes) - sizes] = word_hashes([START])[0]
    return keys, (before >> BITS << BITS) | (keys >> BITS), sizes


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(keys) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def planes(keys: np.ndarray) -> bytes:
    """Differences of sorted keys, byte by byte, which compresses well."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def parts(kind: int, keys: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple]:
    """Rows (kind, bucket, keys, values) of sorted keys and their columns of 32-bit counts."""
    of = bucket_of(keys, buckets)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(buckets + 1))
    rows = []
    for bucket in range(buckets):
        at = order[edges[bucket] : edges[bucket + 1]]
        if len(at):
            rows.append((kind, bucket, planes(keys[at]), np.ascontiguousarray(values[at].T.astype("<u4")).tobytes()))
    return rows


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their rows of values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(values[order], first, axis=0) if len(keys) else values


PARTS = "kind int, bucket int, keys binary, counts binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], schema=SCHEMA)


def partial_counts(texts: DataFrame, buckets: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (WORDS, PAIRS):
                keys, n = np.unique(np.concatenate([h[kind] for h in held]), return_counts=True)
                yield batch_of(parts(kind, keys, n[:, None], buckets))
            held.clear()

        for batch in batches:
            found = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in chunks(found, 8_000_000):
                words, pairs, _ = token_keys(found[a:b])
                held.append((words, pairs))
                size += len(words)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return texts.mapInArrow(count, PARTS)


def merged(table: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray]:
    keys = [from_planes(k) for k in table["keys"].to_pylist()]
    counts = [np.frombuffer(c, "<u4").reshape(columns, -1).T for c in table["counts"].to_pylist()]
    return summed(np.concatenate(keys), np.concatenate(counts).astype(np.int64))


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Written whole under another name first: a repeated task can't leave half a file."""
    path = f"{folder}/{name}.npy"
    draft = f"{path}.{os.getpid()}-{os.urandom(4).hex()}.npy"
    np.save(draft, array)
    os.replace(draft, path)


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


TOTALS = "kind int, bucket int, types long, tokens long, n1 long, n2 long, n3 long, n4 long"


def totals_of(kind: int, bucket: int, counts: np.ndarray) -> dict[str, list[int]]:
    row = [kind, bucket, len(counts), int(counts.sum()), *counts_of_counts(counts)]
    return {f.split()[0]: [v] for f, v in zip(TOTALS.split(", "), row, strict=True)}


class Model:
    """Folder, buckets and totals of a model; what workers need to score."""

    def __init__(self, folder: str, buckets: int, words: dict, pairs: dict, follows: dict):
        self.folder, self.buckets = folder, buckets
        self.train_tokens, self.types = words["tokens"], words["types"]
        self.pair_discounts = discounts(pairs)
        self.word_discounts = discounts(follows)
        self.follow_types, self.follow_tokens = follows["types"], follows["tokens"]
        n = [follows["n1"], follows["n2"]]
        more = self.follow_types - sum(n)
        given = self.word_discounts[0] * n[0] + self.word_discounts[1] * n[1] + self.word_discounts[2] * more
        self.even = (given / self.follow_tokens if self.follow_tokens else 1.0) / (self.types + 1)


def discounts(n: dict) -> list[float]:
    """Discounts of counts 1, 2 and above, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (n[f"n{i}"] for i in range(1, 5))
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return [min(max(d, 0.1), i + 0.9) for i, d in enumerate(found)]


def train(texts: DataFrame, folder: str | None = None) -> Model:
    """Count the texts (one column) and write the model's files."""
    spark = texts.sparkSession
    texts = texts.toDF("text")
    folder = folder or fresh_path(spark, "kneser-ney")
    place = local_path(folder)
    size = texts.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(4, -(-size // BUCKET_BYTES))
    os.makedirs(place, exist_ok=True)

    def first(key: tuple, table: pa.Table) -> pa.Table:
        kind, bucket = (x.as_py() for x in key)
        keys, counts = merged(table, 1)
        counts = counts[:, 0]
        save(place, f"{kind}-{bucket}-keys", keys)
        save(place, f"{kind}-{bucket}-counts", counts.astype("<u4" if counts.max() < 2**32 else "<u8"))
        total = totals_of(kind, bucket, counts)
        rows = []
        if kind == PAIRS:
            begun = np.stack([(counts == 1), (counts == 2), (counts > 2), counts], axis=1).astype(np.int64)
            rows += parts(BEGUN, *summed(keys >> BITS, begun), buckets)
            rows += parts(FOLLOWED, *summed(keys & LOW, np.ones((len(keys), 1), np.int64)), buckets)
        blank = [None] * (len(rows) + 1)
        parts_table = [pa.array([r[i] for r in rows] + [None], t) for i, t in ((1, pa.int32()), (2, pa.binary()), (3, pa.binary()))]
        part_kind = pa.array([r[0] for r in rows] + [None], pa.int32())
        pad = {k: pa.array(blank[:-1] + v, pa.int32() if k in ("kind", "bucket") else pa.int64()) for k, v in total.items()}
        return pa.table({"part_kind": part_kind, "part_bucket": parts_table[0], "keys": parts_table[1], "counts": parts_table[2], **pad})

    counted = partial_counts(texts, buckets).groupBy("kind", "bucket").applyInArrow(
        first, "part_kind int, part_bucket int, keys binary, counts binary, " + TOTALS
    )
    table = f"{folder}/parts"
    counted.write.parquet(table)
    written = spark.read.parquet(table)

    def second(key: tuple, rows: pa.Table) -> pa.Table:
        kind, bucket = (x.as_py() for x in key)
        keys, counts = merged(rows, 4 if kind == BEGUN else 1)
        save(place, f"{kind}-{bucket}-keys", keys)
        save(place, f"{kind}-{bucket}-counts", counts if kind == BEGUN else counts[:, 0])
        total = totals_of(kind, bucket, counts[:, -1])
        return pa.table({k: pa.array(v, pa.int32() if k in ("kind", "bucket") else pa.int64()) for k, v in total.items()})

    halves = written.filter("part_kind is not null").select(F.col("part_kind").alias("kind"), F.col("part_bucket").alias("bucket"), "keys", "counts")
    lower = halves.groupBy("kind", "bucket").applyInArrow(second, TOTALS)
    names = [f.split()[0] for f in TOTALS.split(", ")]
    both = written.filter("kind is not null").select(*names).union(lower.select(*names))
    sums = {r["kind"]: r.asDict() for r in both.groupBy("kind").agg(*(F.sum(n).alias(n) for n in names[2:])).collect()}
    none = dict.fromkeys(names[2:], 0)
    return Model(place, buckets, *(sums.get(k, none) for k in (WORDS, PAIRS, FOLLOWED)))


@lru_cache(maxsize=4096)
def mapped(path: str) -> np.ndarray | None:
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def look_up(model: Model, kind: int, keys: np.ndarray) -> np.ndarray:
    """Rows of counts of sorted distinct keys, 0 where a key is not in the model."""
    out = np.zeros((len(keys), 4 if kind == BEGUN else 1))
    of = bucket_of(keys, model.buckets)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(model.buckets + 1))
    for bucket in np.unique(of):
        known = mapped(f"{model.folder}/{kind}-{bucket}-keys.npy")
        if known is None or not len(known):
            continue
        counts = mapped(f"{model.folder}/{kind}-{bucket}-counts.npy")
        at = order[edges[bucket] : edges[bucket + 1]]
        place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
        hit = known[place] == keys[at]
        out[at[hit]] = counts[place[hit]].reshape(int(hit.sum()), -1)
    return out


def scored(model: Model, texts: list[str]) -> dict[str, np.ndarray]:
    """Tokens, known tokens, the base score and the model's log10 probability of each text."""
    words, pairs, sizes = token_keys(texts)
    starts = np.cumsum(sizes) - sizes
    word, of_word = np.unique(words, return_inverse=True)
    count = look_up(model, WORDS, word)[:, 0]
    base = np.log10((count + 1) / (model.train_tokens + model.types + 1))
    half, of_half = np.unique(word >> BITS, return_inverse=True)
    follows = look_up(model, FOLLOWED, half)[:, 0]
    cut = np.array([0.0, *model.word_discounts])[np.minimum(follows, 3).astype(int)]
    lower = np.maximum(follows - cut, 0) / max(model.follow_tokens, 1) + model.even
    pair, of_pair = np.unique(pairs, return_inverse=True)
    n = look_up(model, PAIRS, pair)[:, 0]
    before, of_before = np.unique(pair >> BITS, return_inverse=True)
    begun = look_up(model, BEGUN, before)[of_before]
    after = lower[np.searchsorted(half, pair & LOW)]
    d = model.pair_discounts
    kept = np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3).astype(int)], 0)
    given = begun[:, 0] * d[0] + begun[:, 1] * d[1] + begun[:, 2] * d[2]
    total = np.maximum(begun[:, 3], 1)
    chance = np.where(begun[:, 3] > 0, kept / total + given / total * after, after)
    return {
        "n_tokens": sizes,
        "n_known": np.add.reduceat((count > 0)[of_word].astype(np.int64), starts),
        "base_score": np.add.reduceat(base[of_word], starts),
        "score": np.add.reduceat(np.log10(chance)[of_pair], starts),
    }


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(rows: DataFrame, model: Model) -> DataFrame:
    """SCORES for rows of (doc_id, held_out, text)."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in chunks(texts, 8_000_000):
                found = scored(held.value, texts[a:b])
                found["train_tokens"] = np.full(b - a, held.value.train_tokens)
                keys = {"doc_id": batch.column(0).slice(a, b - a), "held_out": batch.column(1).slice(a, b - a)}
                values = {k: pa.array(v) for k, v in found.items()}
                names = [f.split()[0] for f in SCORES.split(", ")]
                yield pa.RecordBatch.from_arrays([(keys | values)[n] for n in names], names=names)

    return rows.select("doc_id", "held_out", "text").mapInArrow(score, SCORES)


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Every document scored by a model of those outside the held-out part."""
    held: Column = crc_part(F.col("doc_id"), HELD_PARTS) == HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_or_empty("text").alias("text"))
    return score_texts(rows, train(rows.filter(~F.col("held_out")).select("text")))
