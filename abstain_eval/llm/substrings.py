"""Removal of word windows that occur more than once, found behind a count-min prefilter.

A window is `WINDOW` consecutive words of one document. Three passes read the texts:

1. Every task sketches its windows: a window is counted under its minimizer, the least hash among
   its runs of `GRAM` words. Equal windows have equal minimizers at equal places, and a place is
   counted once for all windows that share it, so the sketch counts about one key in fourteen
   windows and still never less than a window's occurrences. The partial sketches (cells with
   counts that saturate at 2) are added up by block in a shuffle; what is left of them is one bit
   for each cell: counted twice or more.
2. Only windows whose minimizer has all its bits set are handed on, under 128 bits of hash, and
   counted exactly; copies within a task are added up before the shuffle. The result is the list
   of the sketch's mistakes: windows that were let through and occur once. Each has one place, so
   no window however frequent meets in one task.
3. Every text takes the windows that its sketch lets through, without those mistakes, and loses
   the words that they cover.

No repeated window can be lost: the sketch only overestimates, and the second pass is exact. The
sketch has `DEPTH` lines of at least one cell for 16 characters of the corpus, two to six cells
for each key. It is the only thing that all workers hold, so it ends at 2 ** `MOST_BITS` cells a
line (128 MB of bits in all, enough for about 40 GB of text); beyond that it lets more windows
through to the exact count, and results stay the same.

Windows are judged on the input. Null and empty texts, and texts of white space, have no words;
texts with fewer words than a window keep all of theirs. Repeated rows are documents of their own,
so each loses what it shares with the other. Rows with a null id are treated like any other.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abstain_eval.llm.common import chunks, mixed, tasks, text_or_empty, word_hashes, written

WINDOW = 35
GRAM = 8
DEPTH = 2
LEAST_BITS, MOST_BITS = 16, 29
CHARS_PER_CELL = 16
BLOCK_BITS = 20
FLUSH = 1_000_000  # keys that a task holds before it hands their cells on
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LINES = (0x165667B19E3779F9, 0x27D4EB2F165667C5)
ALL = (1 << 64) - 1


def sequence_hashes(keys: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of every `length` consecutive keys, from hashes of runs of 1, 2, 4, ... keys."""
    n = len(keys) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    runs, size, power, done = keys, 1, base, 0
    total = np.zeros(n, np.uint64)
    while size <= length:
        if length & size:
            total = total * np.uint64(power) + runs[done : done + n]
            done += size
        runs = runs[:-size] * np.uint64(power) + runs[size:]
        size, power = size * 2, power * power & ALL
    return mixed(total)


def sliding(values: np.ndarray, length: int, of: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every `length` consecutive values."""
    size = 1
    while size * 2 <= length:
        values = of(values[:-size], values[size:])
        size *= 2
    rest = length - size
    return of(values[: len(values) - rest], values[rest:]) if rest else values


class Windows:
    """Words and windows of some texts, laid end to end; windows never span two texts."""

    def __init__(self, texts: list[str], window: int):
        self.words = [text.encode().split() for text in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.keys = mixed(word_hashes([w for words in self.words for w in words]))
        self.window = window
        n = len(self.keys) - window + 1
        gram = min(GRAM, window)
        self.grams = sequence_hashes(self.keys, gram, BASES[0]) | np.uint64(1)
        if n <= 0:
            self.starts, self.least = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            self.inside = np.zeros(0, bool)
            return
        end_of = np.repeat(self.ends, self.sizes)[:n]
        self.inside = np.arange(n) + window <= end_of
        self.starts = np.flatnonzero(self.inside)
        self.span = window - gram + 1
        self.all_least = sliding(self.grams, self.span, np.minimum)
        self.least = self.all_least[self.starts]

    def sketch_keys(self) -> np.ndarray:
        """Every place of a gram that is the least of some window, once."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        least = np.where(self.inside, self.all_least, np.uint64(0))
        pad = np.zeros(self.span - 1, np.uint64)
        most = sliding(np.concatenate([pad, least, pad]), self.span, np.maximum)
        return self.grams[most == self.grams]

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(sequence_hashes(self.keys, self.window, base)[at] for base in BASES)


def cells(keys: np.ndarray, line: int, bits: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64(LINES[line])) >> np.uint64(64 - bits)).astype(np.int64)


def let_through(keys: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    """Whether all cells of a key were counted twice or more."""
    found = np.ones(len(keys), bool)
    for line in range(DEPTH):
        at = cells(keys, line, bits)
        found &= (sketch[line][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def sketch_bits(n_chars: int) -> int:
    """Cells a line, as a power of two, for so many characters."""
    return int(np.clip((max(n_chars, 1) // CHARS_PER_CELL).bit_length(), LEAST_BITS, MOST_BITS))


PARTIAL = "line int, block int, cells binary, counts binary"


def partial_sketches(texts: DataFrame, window: int, bits: int) -> DataFrame:
    block_bits = min(BLOCK_BITS, bits)

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        out = []
        for line in range(DEPTH):
            found, n = np.unique(cells(keys, line, bits), return_counts=True)
            edges = np.searchsorted(found, np.arange(0, (1 << bits) + 1, 1 << block_bits))
            for block in np.flatnonzero(np.diff(edges)):
                part = slice(edges[block], edges[block + 1])
                inner = (found[part] & ((1 << block_bits) - 1)).astype("<u4")
                out.append((line, int(block), inner.tobytes(), np.minimum(n[part], 2).astype(np.uint8).tobytes()))
        columns = list(zip(*out, strict=True))
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["line", "block", "cells", "counts"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            found = batch.column(0).to_pylist()
            for a, b in chunks(found):
                keys = Windows(found[a:b], window).sketch_keys()
                if len(keys):
                    held.append(keys)
                    size += len(keys)
                if size >= FLUSH:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return texts.select("text").mapInArrow(sketch, PARTIAL)


def merged_sketch(partial: DataFrame, bits: int) -> np.ndarray:
    """Bits of cells counted twice or more, a line of bytes for each line of the sketch."""
    size = 1 << min(BLOCK_BITS, bits)

    def bits_of(key: tuple, counts: np.ndarray) -> pa.RecordBatch:
        packed = np.packbits(counts >= 2, bitorder="little").tobytes()
        columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([packed], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["line", "block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, counts = None, None  # rows come sorted: one block is held at a time
        for batch in batches:
            for row in batch.to_pylist():
                key = row["line"], row["block"]
                if key != open_key:
                    if open_key is not None:
                        yield bits_of(open_key, counts)
                    open_key, counts = key, np.zeros(size, np.uint8)
                at = np.frombuffer(row["cells"], "<u4")
                counts[at] = np.minimum(counts[at] + np.frombuffer(row["counts"], np.uint8), 2)
        if open_key is not None:
            yield bits_of(open_key, counts)

    blocks = DEPTH << max(0, bits - BLOCK_BITS)
    spread = partial.repartition(min(blocks, tasks(partial)), "line", "block").sortWithinPartitions("line", "block")
    sketch = np.zeros((DEPTH, (1 << bits) // 8), np.uint8)
    # At most DEPTH * 2 ** MOST_BITS bits, 128 MB.
    for row in spread.mapInArrow(merge, "line int, block int, bits binary").toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)
        sketch[row["line"], row["block"] * len(part) : (row["block"] + 1) * len(part)] = part
    return sketch


def passed_windows(texts: DataFrame, window: int, sketch, bits: int) -> DataFrame:
    """Windows that the sketch lets through (h1, h2), their number up to 2, and one place of each: text d1, d2, word `at`."""
    names = ["h1", "h2", "n", "d1", "d2", "at"]

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, *digests = (batch.column(i) for i in range(3))
            found, digests = found.to_pylist(), [d.to_numpy() for d in digests]
            for a, b in chunks(found):
                seen = Windows(found[a:b], window)
                at = seen.starts[let_through(seen.least, sketch.value, bits)]
                if not len(at):
                    continue
                h1, h2 = seen.hashes(at)
                order = np.lexsort((h2, h1))
                h1, h2, at = h1[order], h2[order], at[order]
                first = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
                n = np.minimum(np.diff(first, append=len(at)), 2)
                h1, h2, at = h1[first], h2[first], at[first]
                text = np.searchsorted(seen.ends, at, side="right")
                word = at - (seen.ends - seen.sizes)[text]
                columns = (h1.view(np.int64), h2.view(np.int64), n, digests[0][a + text], digests[1][a + text], word)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    return texts.select("text", "d1", "d2").mapInArrow(hand_on, ", ".join(f"{c} long" for c in names))


KEPT = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept string"


def kept_words(texts: DataFrame, window: int, sketch, bits: int) -> DataFrame:
    """What stays of every text; `once` holds its windows that the sketch lets through by mistake."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
         ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.string())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, once = (batch.column(c) for c in ("doc_id", "text", "once"))
            found = found.to_pylist()
            for a, b in chunks(found):
                seen = Windows(found[a:b], window)
                begins = seen.ends - seen.sizes
                passed = np.zeros(len(seen.keys), bool)
                passed[seen.starts[let_through(seen.least, sketch.value, bits)]] = True
                for i, places in enumerate(once.slice(a, b - a).to_pylist()):
                    if places:
                        passed[begins[i] + np.array(places)] = False
                steps = np.zeros(len(passed) + window, np.int32)
                at = np.flatnonzero(passed)
                steps[at] += 1
                np.subtract.at(steps, at + window, 1)
                gone = np.cumsum(steps)[: len(passed)] > 0
                out = []
                for i, words in enumerate(seen.words):
                    lost = gone[begins[i] : seen.ends[i]]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.view(np.int8), [0]]))).reshape(-1, 2).tolist()
                    kept, place = [], 0
                    for start, stop in edges:
                        kept += words[place:start]
                        place = stop
                    kept += words[place:]
                    spans = [{"start": s, "stop": e} for s, e in edges]
                    out.append((len(words), len(words) - len(kept), spans, b" ".join(kept).decode()))
                columns = [ids.slice(a, b - a), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return texts.select("doc_id", "text", "once").mapInArrow(cut, KEPT)


def text_digests(text: Column) -> tuple[Column, Column]:
    """128 bits that name a text."""
    return F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2")


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """Each row's doc_id, n_words, n_removed, the removed spans of words and the `kept` text.

    `kept` is what stays of the words, joined by single spaces.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    n_chars = plain.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = sketch_bits(n_chars)
    texts = plain.select("doc_id", "text", *text_digests(F.col("text")))
    sketch = spark.sparkContext.broadcast(merged_sketch(partial_sketches(plain, window, bits), bits))
    passed = passed_windows(texts, window, sketch, bits)
    # A window that occurs once is one row, so the greatest values are its own.
    counted = passed.groupBy("h1", "h2").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("d1", "d2", "at")))
    # A text with copies has no window that occurs once: no key of this table is that of several rows.
    mistakes = counted.filter("n = 1").groupBy("d1", "d2").agg(F.collect_list("at").alias("once"))
    return kept_words(texts.join(written(mistakes, "once"), ["d1", "d2"], "left"), window, sketch, bits)
