"""Best-fit packing of token pieces into fixed sequences by exact-complement hashing.

Texts are tokenized whole, closed with an end id, and cut into pieces of at most `capacity`
ids. How pieces fill sequences depends only on how many pieces have each length, so the plan is
made from that table of at most `capacity` counts: a sequence starts with the longest length
left, and its gap is closed exactly by one, two or three lengths found in an index of lengths
and of pair sums; where no such combination is left the longest fitting length goes in and the
smaller gap is tried again. A combination is used as often as its lengths last, so the plan has
few distinct patterns. Pieces are then numbered within their length and read their sequence and
offset off the plan: a piece moves through one shuffle of small rows, texts through none.

Null and empty texts hold the end id alone. Repeated rows and null ids are pieces like any
other. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abstain_eval.llm.common import chunks
from abstain_eval.session import cut_lineage

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
NUMBERING_BUCKETS = 64
CACHED_WORDS = 450_000  # of each worker, about 90 MB
BATCH_CHARACTERS = 8_000_000
LEAN_WORDS = 100_000  # the same where other stages run in the same workers
LEAN_CHARACTERS = 1_500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Token ids of texts, looked up per word: the tokenizer never merges over white space.

    Words of plain letters and signs are cut by the tokenizer's own pattern and only pieces not
    met before go through its merges; any other word, and one that holds a marker such as
    <|endoftext|>, goes through the tokenizer whole.
    """

    #: The split pattern of the vocabulary file. Fixed value.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.most = CACHED_WORDS
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.find = regex.compile(self.PATTERN).findall
        # Markers have ids of their own wherever they stand, also inside a word.
        self.markers = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # Characters that normalisation leaves alone but for their case.
        self.plain = regex.compile(r"[\x21-\x7eÀ-įı-ňŊ-ž]+").fullmatch
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            spelled = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
            tokens = self.model.tokenize(spelled)
            ids = self.keep(piece, pack_ids(f"<{len(tokens)}I", *[t.id for t in tokens]))
        return ids

    def word(self, word: str) -> bytes:
        """Ids of a word that is not kept yet."""
        if not word:
            return b""
        if not self.plain(word) or any(m in word for m in self.markers):
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        lower = word.lower()
        if lower.isalpha():
            return self.piece(lower)
        return self.keep(word, b"".join([self.piece(p) for p in self.find(lower)]))

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text. Repeated words of the batch are looked up once."""
        import pandas as pd

        split = [t.replace("\n", " ").split(" ") for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        codes, words = pd.factorize(np.array([w for s in split for w in s], dtype=object))
        found = [self.word(w) if ids is None else ids for w, ids in zip(words, map(self.known.get, words), strict=True)]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        starts = np.cumsum(counts) - counts
        ends = np.cumsum(sizes)
        for a, b in zip(ends - sizes, ends, strict=True):
            use = codes[a:b]
            n = counts[use]
            place = np.arange(int(n.sum())) + np.repeat(starts[use] - (np.cumsum(n) - n), n)
            yield flat[place]


_TOKENIZERS: dict[tuple[str, bool], WordTokenizer] = {}


def word_tokenizer(path: str, keeps: bool = False) -> WordTokenizer:
    """A worker's tokenizer; one that ``keeps`` its words from task to task is another one."""
    if (path, keeps) not in _TOKENIZERS:
        _TOKENIZERS[path, keeps] = WordTokenizer(path)
    return _TOKENIZERS[path, keeps]


def forget_words(path: str) -> None:
    """Drop all words that this worker holds, those of earlier tasks too."""
    for keeps in (False, True):
        if (path, keeps) in _TOKENIZERS:
            _TOKENIZERS[path, keeps].known = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, lean: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Each machine finds its own tokenizer file.

    With ``lean`` workers keep fewer words, none of them after a task, and take fewer characters at once.
    """
    most, at_once = (LEAN_WORDS, LEAN_CHARACTERS) if lean else (CACHED_WORDS, BATCH_CHARACTERS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(tokenizer)
        encode = word_tokenizer(path, keeps=not lean)
        encode.most = most
        yield from cut_with(encode, batches)
        if lean:
            forget_words(path)

    def cut_with(encode: WordTokenizer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for a, b in chunks(texts, at_once):
                for key, ids in zip(keys[a:b], encode(texts[a:b]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for n, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((key, n, start, len(part), zlib.crc32(part.tobytes())))
            if rows:
                key, n, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(lengths of one sequence with their number, how many such sequences) until no piece is left."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(capacity + 1)
    # The index of sums: false once the lengths left have no such pair or triple. Counts only fall.
    pair_sum = np.ones(capacity + 1, bool)
    triple_sum = np.ones(capacity + 1, bool)

    def pair(free: np.ndarray, gap: int) -> tuple[int, int] | None:
        if gap < 2 or not pair_sum[gap]:
            return None
        low = lengths[1 : gap // 2 + 1]
        high = gap - low
        both = low[(left[low] > 0) & (left[high] > 0)]
        both = both[left[both] > (both == gap - both)]
        if not len(both):
            pair_sum[gap] = False
            return None
        both = both[(free[both] > 0) & (free[gap - both] > (both == gap - both))]
        return (int(both[0]), gap - int(both[0])) if len(both) else None

    def triple(free: np.ndarray, gap: int) -> tuple[int, int, int] | None:
        if gap < 3 or not triple_sum[gap]:
            return None
        first = lengths[1 : gap - 1]
        first = first[(left[first] > 0) & pair_sum[gap - first]][::-1]
        for a in first[free[first] > 0]:
            free[a] -= 1
            two = pair(free, gap - int(a))
            free[a] += 1
            if two:
                return int(a), *two
        triple_sum[gap] = bool(((left[first] > 0) & pair_sum[gap - first]).any())
        return None

    patterns = []
    while left.any():
        longest = int(lengths[left > 0][-1])
        used: dict[int, int] = {longest: 1}
        free = left.copy()
        free[longest] -= 1
        gap = capacity - longest
        while gap > 0:
            closing = (gap,) if free[gap] > 0 else pair(free, gap) or triple(free, gap)
            if not closing:
                fitting = lengths[1 : gap + 1][free[1 : gap + 1] > 0]
                if not len(fitting):
                    break
                closing = (int(fitting[-1]),)
            for x in closing:
                used[x] = used.get(x, 0) + 1
                free[x] -= 1
            gap -= sum(closing)
        times = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
        patterns.append((used, times))
    return patterns


def plan_runs(patterns: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: runs (first rank, sequences' first id, copies in a sequence, first offset)."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for used, times in patterns:
        offset = 0
        for length, copies in used.items():
            first = taken.get(length, 0)
            runs.setdefault(length, []).append((first, sequence, copies, offset))
            taken[length] = first + copies * times
            offset += length * copies
        sequence += times
    return runs


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` with `rank`, from 0 within each length. A frequent length is numbered in many buckets."""
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(NUMBERING_BUCKETS)).cast("int"))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucketed.withColumn("place", F.row_number().over(within) - 1)
    return ranked.join(firsts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("place"))


def pack(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, lean: bool = False
) -> DataFrame:
    """One row per piece with sequence_id and offset; every sequence is gapless from 0."""
    spark: SparkSession = docs.sparkSession
    rows = cut_lineage(pieces(docs, capacity, tokenizer, end_id, lean))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = [(length, *run) for length, of in plan_runs(plan_patterns(counts, capacity)).items() for run in of]
    schema = "length long, run_first long, sequence long, copies long, run_offset long"
    plan = spark.createDataFrame(runs, schema).groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("run_first", "sequence", "copies", "run_offset"))).alias("runs")
    )
    # At most `capacity` lengths, and few runs of each: the plan is small whatever the corpus.
    placed = numbered(rows).join(F.broadcast(plan), "length")
    run = F.element_at(F.filter("runs", lambda r: r["run_first"] <= F.col("rank")), -1)
    placed = placed.withColumn("run", run)
    within = F.col("rank") - F.col("run.run_first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.sequence") + F.floor(within / F.col("run.copies"))).cast("long").alias("sequence_id"),
        (F.col("run.run_offset") + (within % F.col("run.copies")) * F.col("length")).cast("long").alias("offset"),
    )
